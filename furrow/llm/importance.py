"""Importance resampling towards a target distribution, with n-gram hashes by CRC algebra.

A text's features are its runs of 1 to ``most`` consecutive words, joined by one
space; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. No
such run is ever written out. Each different word's CRC is computed once; the CRC
of a followed by b is a's CRC, shifted by the length of b, plus b's CRC, where plus
is exclusive or and a shift by n bytes is a 32 x 32 matrix over GF(2): the n-th
power of the matrix of one zero byte. So a run of k words follows from that of
k - 1 words and one word more.

The gain of a bucket is the logarithm of its smoothed share in the target over that
in the documents; a document's weight is its features' mean gain. Adding Gumbel
noise, drawn from the id, to the weights and taking the highest scores draws
without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.infilling import draw
from furrow.llm.shared import free_name, settle
from furrow.llm.words import FOLD, utf8

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: CRC-32 with reflected bits, as in zlib: a fixed value.
POLYNOMIAL = 0xEDB88320
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

_BITS = np.arange(32, dtype=np.uint32)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of b, then a; a matrix is the images of the 32 single bits."""
    return np.array([np.bitwise_xor.reduce(a[(column >> _BITS) & 1 == 1]) if column else 0 for column in b], np.uint32)


@lru_cache(None)
def _doubled(k: int) -> np.ndarray:
    """The shift by 2**k zero bytes."""
    if k:
        return _product(_doubled(k - 1), _doubled(k - 1))
    bit = np.array([POLYNOMIAL, *(1 << np.arange(31, dtype=np.uint64))], np.uint32)
    two = _product(bit, bit)
    four = _product(two, two)
    return _product(four, four)


@lru_cache(4096)
def shift_table(n: int) -> np.ndarray:
    """The shift by n zero bytes, as a table for each byte of the CRC: (4, 256)."""
    matrix = np.uint32(1) << _BITS
    for k in range(n.bit_length()):
        if n >> k & 1:
            matrix = _product(_doubled(k), matrix)
    bytes_ = np.arange(256)
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        table[bit // 8] ^= np.where(bytes_ >> bit % 8 & 1, matrix[bit], 0).astype(np.uint32)
    return table


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC as it is after that many zero bytes, without the final complement: what combining needs."""
    known, at = np.unique(lengths, return_inverse=True)
    out = np.zeros(len(crc), np.uint32)
    # One length after the other, as texts have few different lengths of words.
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(known) + 1))
    for k, n in enumerate(known):
        mine = order[bounds[k] : bounds[k + 1]]
        table, c = shift_table(int(n)), crc[mine]
        out[mine] = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
    return out


class WordCrcs:
    """CRC and length of each different word, computed once for each task."""

    #: Different words kept; beyond, the memory is emptied and filled anew.
    MOST = 1 << 18

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint32)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w)
            return np.array([known[w] for w in words], np.uint32)


def features(words: list[bytes], crcs: WordCrcs, most: int = 1) -> Iterator[np.ndarray]:
    """The CRCs of all runs of 1, 2, ... ``most`` words, one array for each number of words."""
    single = crcs.of(words)
    yield single
    if most == 1 or len(words) < 2:
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # A blank before each word: the blank's CRC shifted by the word, plus the word's.
    spaced = shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), lengths) ^ single
    run = single
    for k in range(2, min(most, len(words)) + 1):
        run = shifted(run[:-1], lengths[k - 1 :] + 1) ^ spaced[k - 1 :]
        yield run


def text_buckets(text: str | None, crcs: WordCrcs, most: int = 1, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of a text, in pieces cut between words, each with the words before it that runs across the cut need."""
    data, at, carried = utf8(text).translate(FOLD), 0, []
    while at < len(data):
        end = data.find(b" ", at + piece) if at + piece < len(data) else -1
        end = len(data) if end < 0 else end
        words, at = data[at:end].split(), end
        if words:
            n, here = len(carried), carried + words
            # A run counts where it ends: those within the carried words were counted before.
            found = [run[max(n - k, 0) :] for k, run in enumerate(features(here, crcs, most))]
            yield len(words), np.concatenate(found) % BUCKETS
            carried = here[len(here) - min(most - 1, len(here)) :]


def bucket_sums(rows: DataFrame, text: str, most: int) -> DataFrame:
    """(bucket, n) over all texts: each task adds up its own, so at most BUCKETS rows leave it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, crcs = np.zeros(BUCKETS, np.int64), WordCrcs()
        for batch in batches:
            for t in batch.column(0):
                for _, found in text_buckets(t.as_py(), crcs, most):
                    total += np.bincount(found, minlength=BUCKETS)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], ["bucket", "n"])

    parts = rows.select(F.col(text)).mapInArrow(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", most: int = 1) -> list[int]:
    """One whole number for each bucket: 1000 times the logarithm of its smoothed share in the target over that in docs, rounded down."""
    spark = docs.sparkSession
    s = bucket_sums(docs, text, most).withColumnRenamed("n", "s")
    t = bucket_sums(target, target_text, most).withColumnRenamed("n", "t")
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = {r["bucket"]: (r["s"], r["t"]) for r in every.collect()}  # BUCKETS rows, whatever the texts
    sums = np.array([rows[b] for b in range(BUCKETS)], np.float64)
    all_s, all_t = sums.sum(0)
    ratio = (sums[:, 1] + 1) * (all_s + BUCKETS) / ((sums[:, 0] + 1) * (all_t + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weigh(docs: DataFrame, gains_: list[int], text: str = "text", out: str = "weighed", most: int = 1) -> DataFrame:
    """docs with a struct ``out``: n_words, n_features and weight, the mean gain of the features, rounded down (0 without any)."""

    def weighed(texts: pa.Array) -> pa.Array:
        gain, crcs, rows = np.array(gains_, np.int64), WordCrcs(), []
        for t in texts:
            n = words = total = 0
            for more, found in text_buckets(t.as_py(), crcs, most):
                words += more
                n += len(found)
                total += int(gain[found].sum())
            rows.append((words, n, total // n if n else 0))
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return docs.withColumn(out, F.arrow_udf(weighed, "struct<n_words: long, n_features: long, weight: long>")(F.col(text)))


#: Scores that share a block in the ranking's sums.
_BLOCK = 256


def ranked(scored: DataFrame, eligible: str, take: int, out: str = "rank") -> DataFrame:
    """scored (doc_id, score, ...) with ``out``: 1, 2, 3, ... for the ``take`` eligible rows of highest score, ties to the smaller doc_id; null for all others.

    Nothing is sorted as a whole: scores are whole numbers of a bounded range, so rows are
    counted by score, the score is found at which ``take`` are reached, and only rows
    of that score or more are numbered, each score by itself.
    """
    counts = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / _BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("all"))
    # At most the range of scores by _BLOCK rows, some hundreds.
    down = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(down), F.lit(0)).alias("above"))
    inside = Window.partitionBy("block").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(F.broadcast(blocks), "block").select("score", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("_before"))
    # One row for each score that is reached: bounded by the range of scores.
    before = F.broadcast(settle(before.where(F.col("_before") < take)))
    met = scored.join(before.withColumn("_reached", F.lit(True)), "score", "left")
    drawn = met.where(F.expr(f"{eligible} AND coalesce(_reached, false)"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    some = drawn.withColumn(out, F.when(place <= take, place))
    rest = met.where(F.expr(f"NOT ({eligible} AND coalesce(_reached, false))")).withColumn(out, F.lit(None).cast("long"))
    return some.unionByName(rest).drop("_before", "_reached")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", most: int = 1, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row for each row of docs.

    Drawn are ``percent`` in 100 of the documents with at least MIN_WORDS words, rounded
    down: rank counts them from the highest score on, ties to the smaller id; it is null
    for all others. A null or empty text has no features and weight 0. Rows with a
    null id share one draw and come last in ties; repeated rows tie and get ranks one
    after the other. Texts are taken whole, however long. Without documents there are
    no rows; without target texts each bucket has one smoothed count there. Other
    columns of docs, whatever their names, are left out.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gain = gains(whole, target, "text", target_text, most)
    u = (draw(seed, "doc_id", 0) + F.lit(0.5)) / F.lit(4294967296.0)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    found = free_name(whole, "weighed")
    scored = settle(
        weigh(whole, gain, "text", found, most)
        .select("doc_id", f"{found}.*")
        .withColumn("score", F.col("weight") + gumbel)
    )
    n = scored.where(F.col("n_words") >= MIN_WORDS).count()
    return ranked(scored, f"n_words >= {MIN_WORDS}", n * percent // 100).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
