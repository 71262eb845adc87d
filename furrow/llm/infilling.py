"""Fill-in-middle documents, cut with a sparse checkpoint index.

A text's units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, found from left
to right: a word with the white space before it, or the white space at the end.
While the units are counted, the index records the byte and the code-point offset
of every ``EVERY``-th unit's end. A cut after any unit is then found by binary
search among these checkpoints and a rescan of fewer than ``EVERY`` units.

Everything works on UTF-8: white space is ASCII, so units can be told apart without
decoding, and code points are the bytes that don't continue another one.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import free_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
EVERY = 64
#: Bytes that are counted at a time, so that memory stays small beside a long text.
PIECE = 1 << 20
#: Percent of texts that are rearranged, and of these, percent with the suffix first.
REARRANGED, SUFFIX_FIRST = 50, 80

MADE = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Checkpoints:
    """Offsets of every EVERY-th unit of a UTF-8 text; ``n`` is the number of its units."""

    def __init__(self, data: bytes, every: int = EVERY, piece: int = PIECE):
        self.data, self.n, self.units, self.bytes, self.points = data, 0, [0], [0], [0]
        points = 0
        for at in range(0, len(data), piece):
            here = np.frombuffer(data, np.uint8, min(piece, len(data) - at), at)
            blank = _BLANK[here]
            # A unit ends where white space, or nothing, follows something else; white space at the very end is one more.
            follows = _BLANK[data[at + piece]] if at + piece < len(data) else True
            ends = np.flatnonzero(~blank & np.append(blank[1:], follows)) + 1
            chosen = ends[(every - 1 - self.n) % every :: every]
            before = np.cumsum((here & 0xC0) != 0x80)
            self.units += range(self.n + (every - 1 - self.n) % every + 1, self.n + len(ends) + 1, every)
            self.bytes += (at + chosen).tolist()
            self.points += (points + before[chosen - 1]).tolist()
            self.n += len(ends)
            points += int(before[-1])
        self.n += bool(data) and bool(_BLANK[data[-1]])

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the end of that many units."""
        k = bisect_right(self.units, unit) - 1
        start = end = self.bytes[k]
        for found in itertools.islice(_UNIT.finditer(self.data, start), unit - self.units[k]):
            end = found.end()
        passed = np.frombuffer(self.data, np.uint8, end - start, start)
        return end, self.points[k] + int(((passed & 0xC0) != 0x80).sum())


def rearranged(data: bytes, first: int, second: int, suffix_first: bool, keep: bool) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text; the cuts are two draws, taken modulo units + 1."""
    index = Checkpoints(data)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if keep or not data or any(m in data for m in marks):
        return index.n, "plain", None, None, data
    one, two = sorted((first % (index.n + 1), second % (index.n + 1)))
    (a, points_a), (b, points_b) = index.cut(one), index.cut(two)
    p, s, m = marks
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    parts = (s, suffix, p, prefix, m, middle) if suffix_first else (p, prefix, s, suffix, m, middle)
    return index.n, "spm" if suffix_first else "psm", points_a, points_b - points_a, b"".join(parts)


def _transformed(texts: pa.Array, first: pa.Array, second: pa.Array, suffix_first: pa.Array, keep: pa.Array) -> pa.Array:
    raw = texts.cast(pa.large_binary())
    rows = [
        rearranged(t.as_py() or b"", *rest)
        for t, *rest in zip(raw, *(x.to_pylist() for x in (first, second, suffix_first, keep)), strict=True)
    ]
    n, form, before, inside, out = zip(*rows, strict=True) if rows else [[]] * 5
    # 32-bit offsets, as Spark asks for them: a batch that needs more would have failed on the way in.
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def draw(seed: int, doc_id: str, group: int) -> Column:
    """The group-th 8 hex digits (from 0) of SHA-256 of ``seed:doc_id``, as a number; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "infilling", seed: int = 42) -> DataFrame:
    """docs with a struct ``out``: n (units), form, prefix_chars, middle_chars and output.

    The form is plain (the text as it is; no cuts) for empty texts, for texts that
    hold a mark, and for those not drawn; otherwise psm
    (``<P>``prefix``<S>``suffix``<M>``middle) or spm (``<S>``suffix``<P>``prefix``<M>``middle). The
    cuts are drawn from the id, so reruns and repeated rows agree, and ties of two cuts
    leave the middle empty. A null text counts as empty and gives an empty output, a
    null id draws as an empty one. Texts may be of any length. An empty table stays
    empty. Columns of docs stay, whatever their names; one called ``out`` is replaced.
    """
    drawn = free_name(docs, "_drawn")
    h = [draw(seed, doc_id, k) for k in range(4)]
    draws = F.struct(
        h[0].alias("first"), h[1].alias("second"), (h[3] % 100 < SUFFIX_FIRST).alias("suffix_first"), (h[2] % 100 >= REARRANGED).alias("keep")
    )
    made = F.arrow_udf(_transformed, MADE)(F.col(text), *(F.col(f"{drawn}.{c}") for c in ("first", "second", "suffix_first", "keep")))
    return docs.withColumn(drawn, draws).withColumn(out, made).drop(drawn)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from output and form alone, in SQL functions: the marks stand in it once each."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
