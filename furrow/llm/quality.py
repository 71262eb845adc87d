"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated windows. The method's
verdict compares two histograms of a document with its language's: classes of
characters, and common function words against all other words. The distance is
Jensen-Shannon's (base 2, square root, 0 to 1). Texts too short for a histogram to
mean anything are guarded: they are judged by the base rules alone.

Letters and blanks swamp rare classes in these two, so a third histogram has only
symbols, words that repeat the word before them, and all other words. A text with
more of the rare ones than its language is far from it at a small distance already.

A language's reference is the sum of the histograms of all its documents, so it
follows the corpus: one pass with map-side sums, one row for each language. The
second pass joins it (broadcast where languages are counted to be few).
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.mixing import hinted
from furrow.llm.shared import free_name, settle
from furrow.llm.words import FOLD, utf8

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Guards: fewer characters or words than this give no verdict on their histogram.
GUARD_CHARS = 200
GUARD_WORDS = 60
#: Largest distances of a kept document.
MOST_CHARS = 0.3
MOST_WORDS = 0.5
#: Largest distance of a kept document that has more rare classes than its language, and the share of them that is never odd.
MOST_RARE = 0.12
GUARD_RARE = 0.1

BLANK, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Character classes: these, then non-ASCII characters, then all others.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    BLANK,
    b".,;:?'\"()-",
    b"!",
    SYMBOLS,
)
#: Common function words of English, German, French and Spanish.
COMMON = (
    "the of and to in is it that for as with on are this was be by at an or from not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le un la et les en du une que est pour qui dans par au il sur ce ne pas avec "
    "el de y los se del las por con no una su para es al lo como más"
).split()
#: ASCII, and the bytes of UTF-8 that go on with a character: what is left is one byte for each wider character.
_NOT_LEADING = bytes(range(0xC0))
_INDEX = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
N_CLASSES, N_COMMON, N_RARE = len(CLASSES) + 2, len(_INDEX) + 1, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HISTOGRAMS = ("classes", "common", "rare")
MEASURES = "struct<" + ", ".join([f"{c}: long" for c in COUNTS] + ["n_chars: long"] + [f"{h}: double" for h in HISTOGRAMS] + ["rare_share: double", "ref_share: double"]) + ">"


def histograms(text: str | None) -> tuple[list[int], list[int]]:
    """Counts of character classes, and of common words with all other words last."""
    data = utf8(text)
    classes = [len(data) - len(data.translate(None, c)) for c in CLASSES]
    n_chars = len(text or "")
    wide = len(data.translate(None, _NOT_LEADING))
    classes += [wide, n_chars - sum(classes) - wide]
    counts = Counter(data.translate(FOLD).split())
    common = [counts[w] for w in _INDEX]
    return classes, [*common, counts.total() - sum(common)]


def rare_classes(n_symbols: int, words: list[bytes]) -> list[int]:
    """Counts of symbols, words equal to the word before, and all other words."""
    again = sum(map(eq, words, words[1:]))
    return [n_symbols, again, len(words) - again]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window which occurs twice or more, its first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + window - max(i, upto)
            upto = i + window
    return n


def measure(text: str | None) -> dict:
    data = utf8(text)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    classes, common = histograms(text)
    n_symbols = classes[CLASSES.index(SYMBOLS)]
    return {
        "n_words": len(words),
        "word_chars": len(text or "") - classes[CLASSES.index(BLANK)],
        "n_symbols": n_symbols,
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "classes": classes,
        "common": common,
        "rare": rare_classes(n_symbols, words),
    }


def js_distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's counts and reference; not a number if either is all zeros."""

    def term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(2 * np.where(a > 0, a, 1) / np.where(a + b > 0, a + b, 1)), 0 * a)

    with np.errstate(invalid="ignore", divide="ignore"):
        p, q = (x / x.sum(1, keepdims=True) for x in (counts, reference))
        return np.sqrt(np.maximum((term(p, q) + term(q, p)).sum(1) / 2, 0)) + 0 * (p + q).sum(1)


def rare_shares(counts: np.ndarray) -> np.ndarray:
    """Share of each row's rare classes, all but the last; not a number for an empty row."""
    with np.errstate(invalid="ignore"):
        return counts[:, :-1].sum(1) / counts.sum(1)


def measures(texts: pa.Array, *references: pa.Array) -> pa.Array:
    """Base measures of texts, and distances of their histograms from the references of their languages."""
    found = [measure(t.as_py()) for t in texts]
    columns = [pa.array([m[c] for m in found], pa.int64()) for c in COUNTS] + [pa.array([sum(m["classes"]) for m in found], pa.int64())]
    if not found:
        return pa.StructArray.from_arrays([*columns, *[pa.array([], pa.float64())] * 5], [*COUNTS, "n_chars", *HISTOGRAMS, "rare_share", "ref_share"])
    counts = [np.array([m[h] for m in found], float) for h in HISTOGRAMS]
    refs = [r.flatten().to_numpy().reshape(len(found), -1).astype(float) for r in references]
    floats = [*map(js_distances, counts, refs), rare_shares(counts[-1]), rare_shares(refs[-1])]
    return pa.StructArray.from_arrays(
        [*columns, *(pa.array(x, pa.float64(), from_pandas=True) for x in floats)], [*COUNTS, "n_chars", *HISTOGRAMS, "rare_share", "ref_share"]
    )


def all_histograms(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        text = t.as_py()
        classes, common = histograms(text)
        out.append([*classes, *common, *rare_classes(classes[CLASSES.index(SYMBOLS)], utf8(text).split())])
    return pa.array(out, pa.list_(pa.int64()))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(ref_lang, ref_classes, ref_common, ref_rare): each language's histograms over all its documents, null a language of its own."""
    n = N_CLASSES + N_COMMON + N_RARE
    counted = docs.select(F.col(lang).alias("ref_lang"), F.arrow_udf(all_histograms, "array<long>")(F.col(text)).alias("counts"))
    sums = counted.groupBy("ref_lang").agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(n)))
    columns = [F.col(f"c{i}") for i in range(n)]
    return sums.select(
        "ref_lang",
        F.array(*columns[:N_CLASSES]).alias("ref_classes"),
        F.array(*columns[N_CLASSES:-N_RARE]).alias("ref_common"),
        F.array(*columns[-N_RARE:]).alias("ref_rare"),
    )


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """docs with a struct column ``out``: the base measures, base_failed, the three distances, kept.

    A null or empty text has no words, fails the base rules and isn't kept. A null
    language is compared with all texts of null language. Where a distance is
    undefined (no words, a reference without any) it doesn't count against a
    text. Texts of any length are measured whole. Repeated rows are judged alike; an
    empty table gives an empty result. Other columns pass through; a column called
    ``out`` is replaced.
    """
    m, r = free_name(docs, "measured"), free_name(docs, "reference")
    refs = settle(references(docs, text, lang)).select(F.struct("*").alias(r))
    met = docs.join(hinted(refs), F.col(lang).eqNullSafe(F.col(f"{r}.ref_lang")), "left")
    df = met.withColumn(m, F.arrow_udf(measures, MEASURES)(F.col(text), *(F.col(f"{r}.ref_{h}") for h in HISTOGRAMS)))
    n_words = F.col(f"{m}.n_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > REPEAT_PERCENT * n_words)
    chars, words, rares, share, ref_share = (F.col(f"{m}.{c}") for c in (*HISTOGRAMS, "rare_share", "ref_share"))
    full = (share > GUARD_RARE) & (share > ref_share) & (rares > MOST_RARE)
    odd = F.coalesce((F.col(f"{m}.n_chars") >= GUARD_CHARS) & (chars > MOST_CHARS), F.lit(False)) | F.coalesce(
        (n_words >= GUARD_WORDS) & (words > MOST_WORDS), F.lit(False)
    )
    return df.withColumn(
        out,
        F.struct(
            *(F.col(f"{m}.{c}").alias(c) for c in COUNTS),
            failed.alias("base_failed"),
            chars.alias("char_distance"),
            words.alias("word_distance"),
            rares.alias("rare_distance"),
            (~failed & ~odd & ~F.coalesce(full, F.lit(False))).alias("kept"),
        ),
    ).drop(*[c for c in (m, r) if c != out])
