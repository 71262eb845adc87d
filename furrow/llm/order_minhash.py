"""Near-duplicate documents by Order MinHash, with candidates verified by banded alignment.

A text's k-mers are its runs of five words, labelled with their occurrence (first,
second, ...). Each of ``SKETCHES`` sketches takes the ``TAKE`` labelled k-mers with
the smallest hashes and keeps them in text order, so that two texts share a
sketch only if they share these k-mers in the same order. Two texts are linked if
their aligned k-mers (the longest common subsequence within the band that a
similarity of 0.8 allows) are at least 0.8 of the union of both. At 0.8, a sketch
is shared with a chance of about one half. Only texts that share ``SHARED``
sketches are compared, so a link between texts stays unproposed with a chance of
about 2e-5.

Exact copies (equal words) collapse into one unit before anything else. Candidates
come from sketch buckets, without making all pairs of a bucket that has found
itself to be one group:

1. each unit is compared with the unit that is the least one in most of its
   buckets: one comparison for each unit;
2. links make components; a bucket whose units are all in one component is done;
3. in each other bucket, units outside its largest component are held against
   the units of other components, in blocks of bounded size: first their sketches,
   then, for units that share enough of them with another, their k-mers (counted
   for all rows of the block at once by an inverted index, then aligned). A pair is
   skipped only where it is connected already, so no link is lost. Work within a
   block is quadratic where many units share sketches and yet aren't linked.

What is shuffled: for all texts their sketches, and the texts themselves once, by
row, to pick the candidates' (an equal row key is all that picks them); for
candidates, their k-mers once in step 1, and in step 3 those with enough shared
sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.components import components
from furrow.llm.shared import BROADCAST_BYTES, free_name, settle
from furrow.llm.words import mix64, occurrence_labelled, shingle_hashes, utf8, word_hashes

K = 5
SIMILARITY = 0.8
SKETCHES = 20
TAKE = 3
#: Sketches that two units have to share.
SHARED = 2
#: K-mers in a block of step 3, on average: 8 bytes each.
BLOCK_KMERS = 500_000

_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

#: Bytes of a row of step 3 without sketches and k-mers, at most.
CLOSE_BYTES = 100

SKETCHED = "struct<unit: binary, n: long, buckets: array<long>>"


def unit_of(text: str | None, words: np.ndarray) -> bytes | None:
    """128 bits that equal texts share: of the words, or of the text itself where it has none. Null for null."""
    if text is None:
        return None
    data = words.tobytes() if len(words) else b"\x00" + utf8(text)
    return hashlib.blake2b(data, digest_size=16).digest()


def sketch_hashes(kmers: np.ndarray, take: int = TAKE) -> list[int]:
    """One 64-bit bucket for each sketch; a text of few k-mers has all of them in each sketch, and so one bucket."""
    if not len(kmers):
        return []
    labelled = occurrence_labelled(kmers)
    if len(labelled) <= take:
        chosen = labelled[None, :]
    else:
        order = labelled[None, :] * _SEEDS[:, None]
        at = np.sort(np.argpartition(order, take - 1, axis=1)[:, :take], axis=1)
        chosen = labelled[at]
    out = np.arange(1, len(chosen) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(chosen.shape[1]):
        out = mix64(out + chosen[:, j])
    return out.view(np.int64).tolist()


def sketched(texts: pa.Array) -> pa.Array:
    units, sizes, buckets = [], [], []
    for t in texts:
        text = t.as_py()
        words = word_hashes(text)
        kmers = shingle_hashes(words, K)
        units.append(unit_of(text, words))
        sizes.append(len(kmers))
        buckets.append(sketch_hashes(kmers))
    return pa.StructArray.from_arrays(
        [pa.array(units, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
        ["unit", "n", "buckets"],
    )


def kmers_of(texts: pa.Array) -> pa.Array:
    found = [shingle_hashes(word_hashes(t.as_py()), K).view(np.int64) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    values = np.concatenate(found) if found else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int64()))


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of a and b that stays within band of the diagonal.

    Bit-parallel: the bits of a window of the row stand for the steps of the
    classic table, and the window slides along with the diagonal.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, low, n = full, -band, 0
    for i, x in enumerate(a):
        if i:
            n += not row & 1
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        match = 0
        for j in places.get(x, ()):
            if low <= j < low + width:
                match |= 1 << (j - low)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return head + tail + n + width - row.bit_count()


def most_apart(n: int, m: int) -> float:
    """K-mers left over on both sides if the similarity is just enough."""
    return (n + m) * (1 - SIMILARITY) / (1 + SIMILARITY)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the aligned k-mers are enough of the union."""
    n, m = len(a), len(b)
    if min(n, m) < SIMILARITY * max(n, m):
        return False
    shared = len(np.intersect1d(occurrence_labelled(a), occurrence_labelled(b), assume_unique=True))
    if not enough(shared, n, m):
        return False
    return enough(aligned(a.tolist(), b.tolist(), int(most_apart(n, m)) + 1), n, m)


def enough(shared: int, n: int, m: int) -> bool:
    return shared >= SIMILARITY * (n + m - shared) - 1e-9


def verified(a: pa.Array, b: pa.Array) -> pa.Array:
    def hashes(kmers: pa.ListScalar) -> np.ndarray:
        return kmers.values.to_numpy().view(np.uint64)

    return pa.array([linked(hashes(x), hashes(y)) for x, y in zip(a, b, strict=True)], pa.bool_())


def close_ones(block: pd.DataFrame) -> pd.DataFrame:
    """The units of one block that share SHARED sketches with a unit of another component, where one of the two asks."""
    # A unit that asks may be in the block as one that is asked too.
    block = block.sort_values("asks", ascending=False, kind="stable").drop_duplicates("unit", ignore_index=True)
    sketches = np.zeros((len(block), SKETCHES), np.int64)
    for i, x in enumerate(block["buckets"]):
        sketches[i, : len(x)] = x
    component, asks = pd.factorize(block["component"])[0], block["asks"].to_numpy(bool)
    close = np.zeros(len(block), bool)
    for x in np.flatnonzero(asks):
        near = ((sketches == sketches[x]) & (sketches[x] != 0)).sum(1) >= SHARED
        near &= component != component[x]
        close |= near
        close[x] |= near.any()
    return block.loc[close, ["bucket", "i", "j", "unit", "component", "asks"]]


def links_between(block: pd.DataFrame) -> pd.DataFrame:
    """Links of the units of one block: of each unit that asks, with units of other components.

    Connected pairs are skipped, also those that a link of this block connects.
    """
    block = block.drop_duplicates("unit").sort_values("unit", ignore_index=True)
    plain = [np.asarray(x, np.int64).view(np.uint64) for x in block["kmers"]]
    kmers = [occurrence_labelled(x) for x in plain]
    sizes = np.array([len(x) for x in kmers])
    owner = np.repeat(np.arange(len(kmers)), sizes)
    flat = np.concatenate(kmers)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root = {c: c for c in block["component"]}

    def top(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    components_, found = block["component"].tolist(), []
    for x in np.flatnonzero(block["asks"].to_numpy()):
        lo, hi = np.searchsorted(flat, kmers[x], "left"), np.searchsorted(flat, kmers[x], "right")
        spans = [owner[p:q] for p, q in zip(lo, hi, strict=True) if q > p + 1]
        if not spans:
            continue
        shared = np.bincount(np.concatenate(spans), minlength=len(kmers))
        close = np.flatnonzero(shared >= SIMILARITY * (sizes + sizes[x] - shared) - 1e-9)
        for y in close[np.argsort(-shared[close], kind="stable")]:
            if top(components_[x]) != top(components_[y]) and linked(plain[x], plain[y]):
                root[top(components_[x])] = top(components_[y])
                found.append((block["unit"][x], block["unit"][y]))
    return pd.DataFrame(found, columns=["a", "b"])


def copy_of(text: str, doc_id: str) -> Column:
    """128 bits that rows share if both id and text are equal."""
    return F.md5(F.to_json(F.struct(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"))))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, copy, class_id, class_size): one row for each row of docs; rows of one class are near-duplicates of each other, directly or in a chain.

    ``copy`` is an MD5 of id and text: rows that share it are equal. class_id is the
    least doc_id of the class (null if all are null). A null text is a class of
    its own id, an empty text joins equal texts only. Texts are compared whole,
    however long. Repeated rows are in one class. An empty table gives an empty
    result. Other columns of docs, whatever their names, are left out.
    """
    copy = copy_of(text, doc_id)
    seen = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"), copy.alias("copy"), F.arrow_udf(sketched, SKETCHED)(F.col(text)).alias("s")
        ).select("doc_id", "copy", F.coalesce("s.unit", F.encode("copy", "utf-8")).alias("unit"), "s.n", "s.buckets")
    )
    units = settle(seen.groupBy("unit").agg(F.first("buckets").alias("buckets"), F.min("copy").alias("copy"), F.first("n").alias("n")))
    keys = units.select(F.explode("buckets").alias("bucket"), "unit")
    # Buckets of equal members would only repeat the same comparisons: two hashes of the set tell them apart.
    counted = settle(
        keys.groupBy("bucket").agg(
            F.min("unit").alias("least"), F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("unit")).alias("set_a"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("set_b"),
        ).where("size > 1").groupBy("size", "set_a", "set_b", "least").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
        .select("bucket", "least", "times")
    )
    members = settle(keys.join(counted, "bucket").select("bucket", "unit", "least", "times"))
    # What a unit is compared with first: the unit that, beside itself, is the least one of most of its buckets.
    votes = members.where("unit != least").groupBy("unit", "least").agg(F.sum("times").alias("times"))
    most = votes.groupBy("unit").agg(F.max_by("least", F.struct("times", "least")).alias("first"), F.max("times").alias("times"))
    firsts = settle(most.where(F.col("times") >= SHARED).select("unit", "first"))
    heads = firsts.select(F.col("first").alias("unit"), F.lit(True).alias("head")).distinct()
    one = units.select("unit", F.col("copy").alias("one")).join(members.select("unit").distinct(), "unit").join(firsts, "unit", "left").join(heads, "unit", "left")
    # The join's own partitioning by row key serves the grouping too: equal rows of one unit are one.
    candidates = settle(
        docs.select(F.col(text).alias("text"), copy.alias("one")).join(settle(one), "one")
        .groupBy("one").agg(*(F.first(c).alias(c) for c in ("unit", "first", "head", "text")))
        .select("unit", "first", "head", F.arrow_udf(kmers_of, "array<long>")(F.col("text")).alias("kmers"))
    )
    check = F.arrow_udf(verified, "boolean")(F.col("others"), F.col("kmers"))
    head = candidates.where("head").select(F.col("unit").alias("first"), F.col("kmers").alias("others"))
    pairs = candidates.where("first IS NOT NULL").select("unit", "first", "kmers").join(head, "first")
    links = settle(pairs.where(check).select(F.col("first").alias("a"), F.col("unit").alias("b")))

    links = links.unionByName(settle(_rest(members, units, candidates, components(links))))
    found = components(links).withColumnsRenamed({"node": "unit", "component": "class"})
    joined = seen.select("doc_id", "copy", "unit").join(found, "unit", "left")
    joined = settle(joined.select("doc_id", "copy", F.coalesce("class", "unit").alias("class")))
    each = settle(joined.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return joined.join(each, "class").select("doc_id", "copy", "class_id", "class_size", "class")


def _rest(members: DataFrame, units: DataFrame, kmers: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) of step 3. Sums by bucket are written before they are joined, so that Spark can split a large bucket's rows."""
    named = found.withColumnsRenamed({"node": "unit"})
    placed = settle(members.select("bucket", "unit").join(named, "unit", "left").withColumn("component", F.coalesce("component", "unit")))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = settle(
        parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").drop("parts")
    )
    sized = settle(
        placed.join(_hinted(mixed), "bucket").withColumn("asks", F.col("component") != F.col("main")).drop("main")
        .join(units.select("unit", F.col("n").alias("k"), "buckets"), "unit")
    )
    blocks = settle(
        sized.groupBy("bucket").agg(
            F.ceil(F.sum(F.when(F.col("asks"), F.col("k")).otherwise(0)) / BLOCK_KMERS).alias("ask_blocks"),
            F.ceil(F.sum("k") / BLOCK_KMERS).alias("all_blocks"),
        )
    )
    at = sized.join(_hinted(blocks), "bucket")
    spot, row = F.xxhash64("unit"), ["bucket", "unit", "component", "buckets"]
    asking = at.where("asks").select(
        *row, "asks", F.pmod(spot, "ask_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)).alias("j"),
    )
    asked = at.select(
        *row, F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_blocks") - 1)).alias("i"), F.pmod(spot, "all_blocks").alias("j"),
    )
    kind = "bucket long, i long, j long, unit binary, component binary, asks boolean"
    # Dealt out by block: a join by bucket alone would satisfy the grouping and leave all blocks of a large bucket to one task.
    # The number is given, as these rows are few bytes for much work and would be put together into few tasks.
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asking.unionByName(asked).repartition(n, "bucket", "i", "j")
    close = settle(dealt.groupBy("bucket", "i", "j").applyInPandas(close_ones, kind))
    return (
        _hinted(close).join(kmers.select("unit", "kmers"), "unit")
        .groupBy("bucket", "i", "j")
        .applyInPandas(links_between, "a binary, b binary")
        .distinct()
    )


def _hinted(rows: DataFrame) -> DataFrame:
    """Broadcast if the written rows, of known width, are counted to be few bytes."""
    return F.broadcast(rows) if rows.count() * CLOSE_BYTES <= BROADCAST_BYTES else rows


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without near-duplicates: one row of each class stays, one with its least id.

    Rows that share id and text count as copies: one of them stays.
    """
    found = settle(classes(docs, text, doc_id))
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy"))["copy"].alias("best"))
    counted = found.groupBy("class", "copy").agg(F.count("*").alias("copies"))
    stay = free_name(docs, "stay")
    chosen = settle(
        counted.join(best, "class").where(F.col("copy") == F.col("best")).select(F.struct("copy", "copies").alias(stay))
    )
    left = docs.join(chosen, copy_of(text, doc_id) == F.col(f"{stay}.copy"))
    single = left.where(F.col(f"{stay}.copies") == 1).drop(stay)
    several = left.where(F.col(f"{stay}.copies") > 1).dropDuplicates([stay]).drop(stay)
    return single.unionByName(several)
