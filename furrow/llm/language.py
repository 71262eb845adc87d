"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is predicted by a linear
classifier on hashed byte n-grams. A text goes to the language whose codeword
loses least against the classifiers' margins (logistic loss), so that a few wrong
bits don't matter, and a small lead over the second language flags the text as
ambiguous.

The sample to learn from is bounded (``SAMPLE`` texts, shared out among the
languages, in the order of a hash) and reaches the driver as feature vectors of
fixed size, whatever the texts' lengths. Prediction reads each text whole, by
itself, without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.shared import free_name
from furrow.llm.toxicity import fold

#: Bound of the training sample, over all languages.
SAMPLE = 2048
FOLDS, HELD_OUT = 4, 2
FEATURES = 4096
NGRAMS = (1, 2, 3)
PASSES, STEP, DECAY = 150, 0.02, 1e-4
#: A lead below this is ambiguous.
LEAD = 0.2
UNKNOWN = "und"

_OTHERS = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of a text's byte n-grams, hashed; None for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = np.frombuffer(_OTHERS.sub(" ", f" {text} ").lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES)
    rolled = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        rolled = rolled[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
        if n in NGRAMS and len(rolled):
            mixed = (rolled * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(mixed, minlength=FEATURES)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of -1 and 1. Up to five languages get the exhaustive code, more get random words that differ in a fifth of their bits at least."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        columns = [[1 if i == 0 else 1 if b >> (i - 1) & 1 else -1 for i in range(n)] for b in range(bits)]
        return -np.array([[c[i] for c in columns] for i in range(n)])
    rng, bits, best, apart = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), None, -1
    while apart < 0.2 * bits:
        for _ in range(20):
            words = rng.choice([-1, 1], (n, bits))
            words = words[:, np.abs(words.sum(0)) < n]  # a bit that is alike for all tells nothing
            alike = words @ words.T
            np.fill_diagonal(alike, -bits)
            if (words.shape[1] - alike.max()) / 2 > apart:
                best, apart = words, (words.shape[1] - alike.max()) / 2
        bits = bits if apart >= 0.2 * bits else bits + bits // 2
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, share of the decoded likelihood, ambiguous)."""
        x = features(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0, True
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * margins[None, :]).sum(1)
        odds = np.exp(loss.min() - loss)
        shares = odds / odds.sum()
        first = int(np.argmax(shares))
        second = float(np.partition(shares, -2)[-2]) if len(shares) > 1 else 0.0
        return self.languages[first], float(shares[first]), bool(shares[first] - second < LEAD)


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Logistic regressions for all bits at once, full batch, languages weighed alike. No rows: everything is unknown."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1))
    code = codewords(len(languages))
    at = np.array([languages.index(lang) for lang, _ in rows])
    x = np.stack([v for _, v in rows]).astype(np.float32)
    target = (code[at] > 0).astype(np.float32)
    weight = (1 / np.bincount(at)[at] / len(languages)).astype(np.float32)[:, None]
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    for step in range(1, PASSES + 1):
        slope = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * weight
        for p, g, m in ((w, x.T @ slope + DECAY * w, moments[0]), (b, slope.sum(0), moments[1])):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= 10 * STEP * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, code, w, b)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents outside the held-out fold; rows without lang, or without a letter, teach nothing.

    At most ``sample`` texts in all, but one of each language at least. Repeated
    rows and null ids are as likely to be drawn as others.
    """
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(-1)) != HELD_OUT)
    ).select("lang", "text", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), "lang")).alias("order"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    each = max(1, sample // len(counts))
    # A first cut by a threshold on the hash, so that the exact cut sorts few rows.
    rough = F.conv(F.substring("order", 1, 7), 16, 10).cast("double") / float(16**7)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n + 8 / n))])
    ranked = rows.where(rough < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text"))))

    def vectors(texts: pa.Array) -> pa.Array:
        found = (features(t.as_py()) for t in texts)
        return pa.array([None if v is None else v.tobytes() for v in found], pa.binary())

    chosen = ranked.where(F.col("rank") <= each).select("lang", "order", F.arrow_udf(vectors, "binary")(F.col("text")).alias("v"))
    got = sorted((r["lang"], r["order"], bytes(r["v"])) for r in chosen.collect() if r["v"] is not None)
    return train([(lang, np.frombuffer(v, np.float32)) for lang, _, v in got])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; columns of these names are replaced.

    Null, empty and letter-free texts are ``und`` with score 0, and so are all
    texts if there was nothing to learn from. Of languages that tie, the first by
    name is answered and the text is ambiguous. Equal texts get equal answers; texts
    of any length are read whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays(
            [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["lang_pred", "score", "ambiguous"]
        )

    kind = "struct<lang_pred: string, score: double, ambiguous: boolean>"
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    found = free_name(docs, "predicted")
    answered = docs.withColumn(found, F.arrow_udf(predicted, kind)(F.col(text)))
    return answered.select(*(F.col(f"`{c}`") for c in names), f"`{found}`.*")
