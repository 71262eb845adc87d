"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item
(an item of fewer words is one window). A block of two words (one, for patterns of
one word) at the end of the search position looks up how far the search may jump;
where the jump is 0, the bucket of the block and of the pattern's first block
lists patterns, and a direct comparison of all their words confirms.
Patterns are grouped by length so that a short item doesn't shorten the jumps of
the long windows.

Words are numbers in an exact vocabulary of the benchmark, so the tables are plain
arrays: some tens of bytes for each benchmark word. The benchmark is worked off in
blocks of a fixed size. A benchmark of one block is searched in a single pass,
without a shuffle. A larger one is a pass for each block, one after the other:
each writes the hits of the texts that have any to the shared folder and frees its
tables, and the hits meet the documents in the end. So memory follows the block,
never the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import BROADCAST_BYTES, free_name, settle
from furrow.llm.words import folded_words

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20

HITS = "struct<n_words: long, n_hit: long, spans: array<long>, items: array<string>, nameless: boolean>"
ARROW_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
        ("nameless", pa.bool_()),
    ]
)


class WuManber:
    """Patterns flat[start : start + length], of at least ``least`` words: shifts and buckets by block of words."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.flat, self.vocabulary = flat, vocabulary
        self.least = int(lengths.min())
        self.block = min(2, self.least)
        self.default = self.least - self.block + 1
        blocks = self._blocks(flat)
        codes, jumps = np.empty(0, np.int64), np.empty(0, np.int64)
        for jump in range(self.default):
            new = np.setdiff1d(blocks[starts + (self.least - self.block - jump)], codes)
            codes, jumps = np.concatenate([codes, new]), np.concatenate([jumps, np.full(len(new), jump)])
        order = np.argsort(codes, kind="stable")
        self.codes, self.jumps = codes[order], jumps[order]
        bucket = self._bucket(*np.searchsorted(self.codes, (blocks[starts + self.least - self.block], blocks[starts])))
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.starts, self.lengths, self.pattern = bucket[order], starts[order], lengths[order], order

    def _blocks(self, words: np.ndarray) -> np.ndarray:
        """A number for the block that begins at each word; negative where a word is unknown."""
        if self.block == 1:
            return words.astype(np.int64)
        a, b = words[:-1].astype(np.int64), words[1:].astype(np.int64)
        return np.where((a < 0) | (b < 0), -1, a * self.vocabulary + b)

    def _bucket(self, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return last.astype(np.int64) * len(self.codes) + first

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, pattern) of each occurrence."""
        blocks = self._blocks(words)
        at = np.searchsorted(self.codes, blocks)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == blocks if len(blocks) else np.empty(0, bool)
        # The position of the last block decides how far the search jumps.
        jumps, last, stops = np.where(known, self.jumps[at], self.default).tolist(), self.least - self.block, []
        n = len(jumps)
        while last < n:
            if jump := jumps[last]:
                last += jump
            else:
                stops.append(last)
                last += 1
        ends = np.array(stops, np.int64)
        begins = ends - (self.least - self.block)
        ends, begins = ends[known[begins]], begins[known[begins]]
        bucket = self._bucket(at[ends], at[begins])
        lo, hi = np.searchsorted(self.bucket, bucket, "left"), np.searchsorted(self.bucket, bucket, "right")
        some = hi - lo
        listed = np.repeat(lo - np.cumsum(some) + some, some) + np.arange(some.sum())
        begins = np.repeat(begins, some)
        fits = begins + self.lengths[listed] <= len(words)
        listed, begins = listed[fits], begins[fits]
        for word in range(int(self.lengths.max())):
            if not len(listed):
                break
            inside = self.lengths[listed] > word
            same = ~inside
            same[inside] = self.flat[self.starts[listed[inside]] + word] == words[begins[inside] + word]
            listed, begins = listed[same], begins[same]
        return begins, begins + self.lengths[listed], self.pattern[listed]


class Matcher:
    """All patterns of one block of the benchmark: (item_id, text) rows, the id null or not."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.word_id: dict[bytes, int] = {}
        self.names = [item_id for item_id, _ in items]
        ids = [np.array([self.word_id.setdefault(w, len(self.word_id)) for w in folded_words(text)], np.int32) for _, text in items]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat, offsets = np.concatenate([*ids, np.empty(0, np.int32)]), np.cumsum(sizes) - sizes
        counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        owner = np.repeat(np.arange(len(ids)), counts)
        starts = np.repeat(offsets - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        lengths = np.minimum(sizes, window)[owner]
        #: Searches with, for each of their patterns, the items that have it: owners[first[p] : first[p + 1]].
        self.searches: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        kinds = np.where(lengths < window, 1 << np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64), window)
        for kind in np.unique(kinds):
            mine = np.flatnonzero(kinds == kind)
            width = int(lengths[mine].max())
            place = np.minimum(starts[mine, None] + np.arange(width), len(flat) - 1)
            rows = np.where(np.arange(width) < lengths[mine, None], flat[place], -1)
            _, one, which = np.unique(np.ascontiguousarray(rows).view(f"V{rows.itemsize * width}").ravel(), return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(one) + 1))
            search = WuManber(flat, starts[mine][one], lengths[mine][one], max(1, len(self.word_id)))
            self.searches.append((search, first, owner[mine][order]))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of hit words, and the ids of the items that hit them."""
        ids = np.fromiter(map(self.word_id.get, words, repeat(-1)), np.int32, len(words))
        spans, items = [], set()
        for search, first, owners in self.searches:
            if len(ids) >= search.least:
                begins, ends, patterns = search.search(ids)
                spans += zip(begins.tolist(), ends.tolist(), strict=True)
                for p in np.unique(patterns).tolist():
                    items.update(self.names[i] for i in owners[first[p] : first[p + 1]].tolist())
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _row(n_words: int, spans: list[tuple[int, int]], items: set[str | None]) -> dict:
    spans = merged(spans)
    return {
        "n_words": n_words, "n_hit": sum(b - a for a, b in spans), "spans": [x for s in spans for x in s],
        "items": sorted(i for i in items if i is not None), "nameless": None in items,
    }


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's rows in blocks of about block_bytes; the driver holds one row set of known size at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:
        rows = settle(rows)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        block = rows if n == 1 else rows.where(part == k)
        yield [(r[0], r[1]) for r in block.collect()]


def _searched(docs: DataFrame, text: str, items: list[tuple[str | None, str | None]], window: int):
    """(column of HITS for docs' texts, what frees the executors' tables)."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, window))

    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        matcher, found = shared.value, []
        for t in texts:
            words = folded_words(t.as_py())
            found.append(_row(len(words), *matcher.hits(words)))
        return pa.array(found, ARROW_HITS)

    return search(F.col(text)), shared.destroy


def _together(several: pa.Array) -> pa.Array:
    """One row of hits from those of several blocks."""
    found = []
    for rows in several.to_pylist():
        spans = [(a, b) for r in rows for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)]
        items = {i for r in rows for i in (*r["items"], *([None] if r["nameless"] else []))}
        found.append(_row(rows[0]["n_words"], spans, items))
    return pa.array(found, ARROW_HITS)


def _passes(docs: DataFrame, blocks: Iterable, window: int, text: str, state: str) -> DataFrame:
    """docs with HITS in ``state``: a pass for each block that writes the hits of each different text once, then one join."""
    texts, found = docs.where(F.col(text).isNotNull()).select(text), []
    for items in blocks:
        hits, free = _searched(texts, text, items, window)
        found.append(settle(texts.select(F.md5(text).alias("key"), hits.alias("h")).where("h.n_hit > 0").dropDuplicates(["key"])))
        free()
    hits = settle(reduce(DataFrame.unionByName, found).groupBy("key").agg(F.collect_list("h").alias("h")).select("key", F.arrow_udf(_together, HITS)(F.col("h")).alias("h")))
    size = hits.agg(F.sum(64 + 8 * F.size("h.spans") + F.octet_length(F.array_join("h.items", ",")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        hits = F.broadcast(hits)
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    key, row = free_name(docs, "key"), free_name(docs, "found_hits")
    met = docs.join(hits.select(F.struct("key", "h").alias(row)).withColumn(key, F.col(f"{row}.key")), F.md5(text) == F.col(key), "left")
    none = F.array().cast("array<string>")
    return met.withColumn(
        state,
        F.struct(
            n_words.alias("n_words"), F.coalesce(f"{row}.h.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.col(f"{row}.h.spans").alias("spans"),
            F.coalesce(f"{row}.h.items", none).alias("items"), F.coalesce(f"{row}.h.nameless", F.lit(False)).alias("nameless"),
        ),
    ).drop(key, row)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    out: str = "contamination",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with a struct column ``out``: n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated.

    A null or empty text has no words, no hits and isn't contaminated. Texts of any
    length are searched whole. Repeated items count once; an item without words
    matches nothing; items with a null id count as one item together, which has no
    id to list. An empty benchmark hits nothing. Repeated documents are judged
    alike. Other columns of docs pass through, whatever their names; a column
    called ``out`` is replaced.
    """
    state = free_name(docs, "hits_so_far")
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        df = docs.withColumn(state, _searched(docs, text, first, window)[0])
    else:
        df = _passes(docs, chain((first, second), blocks), window, text, state)

    def of(name: str) -> Column:
        return F.col(f"{state}.{name}")

    return df.withColumn(
        out,
        F.struct(
            of("n_words").alias("n_words"),
            of("n_hit").alias("n_hit"),
            (F.size(of("items")) + of("nameless").cast("int")).cast("long").alias("n_items"),
            of("items").alias("items"),
            F.sha2(F.array_join(of("items"), ","), 256).alias("items_sha256"),
            ((of("n_hit") > 0) & (ONE_IN * of("n_hit") >= of("n_words"))).alias("contaminated"),
        ),
    ).drop(*[state] if state != out else [])
