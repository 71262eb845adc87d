"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself), so a misspelling nobody has
seen shares most of its vectors with the word it stands for. A window of words is
the average of its words' vectors, a linear softmax turns it into a probability, and
a text is as toxic as its most toxic window: a few insults in a very long text
weigh as much as in a short one. Training repeats this: in each pass the window
that scores highest in each text gives the gradient, for the embeddings and the
softmax together.

The sample to learn from is bounded (``PER_CLASS`` texts of each label in the order
of a hash, without the longest where they are over ``SAMPLE_BYTES``), the model's size is fixed, and it is broadcast.
Scoring reads each text whole, by itself, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.words import folded_words, mix64

#: Bounds of the training sample.
PER_CLASS = 1500
SAMPLE_BYTES = 48 << 20
FOLDS = 5
#: The model: n-gram lengths, hash buckets, embedding width, words in a window.
NGRAMS = (3, 4, 5)
BITS = 16
BUCKETS = 1 << BITS
GRAM = np.uint64(0x100000001B3)
WIDTH = 8
WINDOW = 12
#: Training: passes over the sample, step of Adam, weight of the prior against one text of the rarer label.
PASSES = 120
STEP = 0.05
PRIOR = 0.05
#: Weight of all toxic texts of the sample together, out of 1. Under one half, so that a model that learned nothing rejects nothing.
TOXIC_WEIGHT = 0.45
#: N-grams in a block of training, and words that a worker remembers the score of.
BLOCK = 500_000
REMEMBERED = 200_000
#: Words of texts that are scored together.
TOGETHER = 200_000


def subwords(words: Sequence[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words in ``<`` and ``>``, laid end to end.

    (For each length, and last for the words themselves, a bucket at each character where one
    begins and -1 elsewhere; where each word begins; how many buckets it has.)
    """
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes) - np.arange(len(letters))
    rolled, found = np.zeros(len(letters), np.uint64), []
    for n in range(1, max(NGRAMS) + 1):
        rolled = rolled[: len(letters) - n + 1] * GRAM + letters[n - 1 :]
        if n in NGRAMS:
            at = np.full(len(letters), -1, np.int64)
            at[: len(rolled)] = np.where(left[: len(rolled)] >= n, (mix64(rolled + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), -1)
            found.append(at)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()) - 1, GRAM)]), dtype=np.uint64)
    whole = np.full(len(letters), -1, np.int64)
    whole[begins] = (mix64(np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(begins, sizes)], begins)) >> np.uint64(64 - BITS)).astype(np.int64)
    n_grams = 1 + sum(np.maximum(0, sizes - n + 1) for n in NGRAMS)
    return [*found, whole], begins, n_grams


def word_scores(words: Sequence[bytes], bucket_scores: np.ndarray) -> np.ndarray:
    """The average score of each word's subwords."""
    found, begins, n_grams = subwords(words)
    padded = np.append(bucket_scores, 0.0)
    return np.add.reduceat(sum(padded[at] for at in found), begins) / n_grams


def distinct_words(text: str | None) -> list[bytes]:
    """A text's words in the order in which they first occur: a word said a hundred times is said once."""
    return list(dict.fromkeys(folded_words(text)))


def all_windows(n: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half-overlapping windows that cover each text of n words, the texts laid end to end: (begins, ends, first window of each text, text of each window).

    Without a window's size, each text is one window.
    """
    step = max(1, (window or 0) // 2)
    some = np.ones(len(n), np.int64) if window is None else np.maximum(1, -(-(n - step) // step))
    first, text = np.cumsum(some) - some, np.repeat(np.arange(len(n)), some)
    offsets = np.cumsum(n) - n
    begins = offsets[text] + (np.arange(len(text)) - first[text]) * step
    ends = (offsets + n)[text]
    return begins, ends if window is None else np.minimum(begins + window, ends), first, text


class Model:
    """The trained softmax over embeddings, folded into one number for each bucket."""

    def __init__(self, bucket_scores: np.ndarray, bias: float, base: float, window: int | None = WINDOW):
        self.bucket_scores, self.bias, self.base, self.window = bucket_scores, bias, base, window
        self.known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probabilities of label 1; a text without words has the base rate. Texts are worked off together, up to a bounded number of words."""
        found, batch, n = [], [], 0
        for t in texts:
            batch.append(distinct_words(t))
            n += len(batch[-1])
            if n >= TOGETHER:
                found.append(self._scores(batch))
                batch, n = [], 0
        return np.concatenate([*found, self._scores(batch)])

    def _scores(self, texts: list[list[bytes]]) -> np.ndarray:
        n = np.array([len(words) for words in texts], np.int64)
        out, has = np.full(len(n), self.base), n > 0
        if has.any():
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({w for words in texts for w in words if w not in self.known})
            if new:
                self.known.update(zip(new, word_scores(new, self.bucket_scores).tolist(), strict=True))
            flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), float, int(n.sum()))
            lo, hi, doc_starts, _ = all_windows(n[has], self.window)
            sums = np.concatenate([[0.0], np.cumsum(flat)])
            logits = self.bias + np.maximum.reduceat((sums[hi] - sums[lo]) / (hi - lo), doc_starts)
            out[has] = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(texts: list[str | None], labels: list[int], base: float | None = None, seed: int = 7, window: int | None = WINDOW) -> Model:
    """Learns embeddings and softmax from whole texts. With no text or one label alone, the base rate is all it knows.

    ``base`` is the share of label 1 (by default that of the given labels). With
    ``window`` None a text is one bag, the average of all its words.
    """
    y = np.asarray(labels, float)
    base = float((y.sum() + 0.5) / (len(y) + 1)) if base is None else base
    vocabulary: dict[bytes, int] = {}
    at: list[np.ndarray] = []
    for t in texts:
        at.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in distinct_words(t)], np.int64))
    keep = [i for i, a in enumerate(at) if len(a)]
    if not keep or len(set(y[keep])) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(base / (1 - base))), base, window)
    listed = list(vocabulary)
    del vocabulary
    parts = []
    for a in range(0, len(listed), BLOCK // 10):
        found, begins, counts = subwords(listed[a : a + BLOCK // 10])
        each = np.stack(found, axis=1)  # n-grams by character, so that a word's stand together
        parts.append((each[each >= 0].astype(np.int32), counts))
    gram_of, n_grams = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    gram_ends = np.cumsum(n_grams)
    # Words are worked off in blocks, so that temporaries stay small beside the n-grams themselves.
    cuts = [0, *np.searchsorted(gram_ends, np.arange(BLOCK, gram_ends[-1], BLOCK)).tolist(), len(n_grams)]
    blocks = [(a, b, int(gram_ends[a] - n_grams[a]), int(gram_ends[b - 1])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    # Windows of all texts, as ranges over the texts' words laid end to end.
    flat = np.concatenate([at[i] for i in keep]).astype(np.int32)
    lo, hi, doc_starts, doc_of = all_windows(np.array([len(at[i]) for i in keep]), window)
    y = y[keep]
    weight = np.where(y == 1, TOXIC_WEIGHT / (y == 1).sum(), (1 - TOXIC_WEIGHT) / (y == 0).sum())

    decay = PRIOR / min((y == 1).sum(), (y == 0).sum())
    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 1.0, WIDTH), np.array([-1.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, PASSES + 1):
        embeddings, softmax, bias = parameters
        per_bucket = embeddings @ softmax
        per_word = np.empty(len(n_grams))
        for a, b, p, q in blocks:
            per_word[a:b] = np.add.reduceat(per_bucket[gram_of[p:q]], gram_ends[a:b] - n_grams[a:b] - p) / n_grams[a:b]
        sums = np.concatenate([[0.0], np.cumsum(per_word[flat])])
        logits = (sums[hi] - sums[lo]) / (hi - lo)
        top = np.maximum.reduceat(logits, doc_starts)
        best = np.flatnonzero(logits == top[doc_of])
        best = best[np.unique(doc_of[best], return_index=True)[1]]
        slope = weight * (1 / (1 + np.exp(-np.clip(top + bias[0], -30, 30))) - y)
        span = hi[best] - lo[best]
        words = flat[np.repeat(lo[best] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())]
        by_word = np.bincount(words, np.repeat(slope / span, span), len(n_grams)) / n_grams
        by_bucket = np.zeros(BUCKETS)
        for a, b, p, q in blocks:
            by_bucket += np.bincount(gram_of[p:q], np.repeat(by_word[a:b], n_grams[a:b]), BUCKETS)
        gradients = [
            by_bucket[:, None] * softmax[None, :] + decay * embeddings,
            by_bucket @ embeddings + decay * softmax,
            np.array([slope.sum()]),
        ]
        for i, (g, (m, v)) in enumerate(zip(gradients, moments, strict=True)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            parameters[i] = parameters[i] - STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    embeddings, softmax, bias = parameters
    return Model(embeddings @ softmax, float(bias[0]), base, window)


def fold(doc_id: Column, of: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """(text, toxic, order) and the share of toxic labels: at most per_class labelled texts of each label outside the held-out fold, in hash order.

    An id with several labels is toxic if one says so; an id with several texts
    brings the first in text order. Ids are picked from the labels by a hash
    threshold, so a few thousand rows at most meet the documents.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), F.md5(F.col("doc_id").cast("string")).alias("order"))
    )
    # A first cut by a threshold on the hash, so that the exact cut sorts a small number of rows.
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rough = F.conv(F.substring("order", 1, 7), 16, 10).cast("double") / float(16**7)
    share = F.when(F.col("toxic") == 1, min(1.0, 1.3 * per_class / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, 1.3 * per_class / max(1, counts.get(0, 0)))
    )
    ranked = known.where(rough < share).withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("order")))
    chosen = ranked.where(F.col("rank") <= per_class).select("doc_id", "toxic", "order")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))
    # From the shortest on, so that a very long text is the one left out, not those behind it.
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    upto = F.sum(size).over(Window.partitionBy("toxic").orderBy(size, "order").rowsBetween(Window.unboundedPreceding, 0))
    rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    return texts.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES // 2).select("text", "toxic", "order"), rate


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, window: int | None = WINDOW) -> Model:
    """Learns from ``training_sample``; repeated, null and empty texts, ids without a text or a label do no harm."""
    sample, rate = training_sample(docs.where(F.col("text").isNotNull()), labels, per_class)
    rows = sorted((r["order"], r["text"], r["toxic"]) for r in sample.collect())
    return train([r[1] for r in rows], [r[2] for r in rows], rate, window=window)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with each text's probability of being toxic in ``out`` (replaced where there is one).

    Nothing but the text is an input. Null, empty and word-free texts have the share
    of toxic labels as their score. Equal texts score alike. Texts of any length are
    read whole. An empty table gives an empty result; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(t.as_py() for t in texts), pa.float64())

    return docs.withColumn(out, F.arrow_udf(scored, "double")(F.col(text)))
