"""Fill-in-middle and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import importance, infilling
from tests.llm.test_llm import WORD, ascii_lower, docs, sentence

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", " a", "a ", "é ü \U0001f600x y\t", "<P>", "a <S> b", "x<M", "<P <S <M >", "\x00 \x1f\x0b"]


def groups(text):
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def made_plainly(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = groups(f"42:{'' if doc_id is None else doc_id}")
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("every,piece", [(1, 1), (2, 3), (3, 7), (64, 1 << 20)])
def test_checkpoints_find_every_cut(every, piece):
    rng = random.Random(every)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a", "é", "\U0001f600", " ", "  ", "\n", "bc"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    for text in texts:
        index, units = infilling.Checkpoints(text.encode(), every, piece), UNITS.findall(text)
        assert index.n == len(units)
        assert index.units == list(range(0, len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1, every))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_fill_in_middle_is_that_of_a_plain_version(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["wort ", "é", "\n", "\U0001f600 ", "x"]) for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    texts.append("lang wört " * 300_000)
    rows = [(i * 7 - 3, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (4, texts[1]), (4, texts[1])] + [(99_990 + k, texts[-1]) for k in range(3)]
    made = infilling.fill_in_middle(docs(spark, rows).withColumn("_drawn", F.lit(1)).withColumn("infilling", F.lit("old")))
    assert "_drawn" in made.columns
    got = made.select("doc_id", "infilling.*", infilling.restored(F.col("infilling.output"), F.col("infilling.form")).alias("restored"), "text").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *made_plainly(i, t)) for i, t in rows)
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most,piece", [(1, 5), (3, 1), (3, 12), (4, 1 << 20)])
def test_crcs_are_those_of_the_runs_written_out(most, piece):
    rng = random.Random(most)
    for text in [*ODD, sentence(rng, 50), "a" * 3000 + " b " + "ü" * 700, *(sentence(rng, n) for n in range(8))]:
        words = [w.encode() for w in WORD.findall(ascii_lower(text or ""))]
        want = Counter(zlib.crc32(b" ".join(words[i : i + k])) % importance.BUCKETS for k in range(1, most + 1) for i in range(len(words) - k + 1))
        got, n = Counter(), 0
        for more, found in importance.text_buckets(text, importance.WordCrcs(), most, piece):
            n += more
            got.update(found.tolist())
        assert n == len(words) and got == want


def resampled_plainly(rows, targets, most, percent):
    def runs(text):
        words = WORD.findall(ascii_lower(text or ""))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)[1]) for texts in ([x for _, x in rows], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, found = runs(text)
        gains = [math.floor(1000 * np.log((t[b] + 1) * (all_s + 10000.0) / ((s[b] + 1) * (all_t + 10000.0)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = groups(f"2024:{'' if doc_id is None else doc_id}")[0]
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return [tuple(r) for r in out], [(r[0], r[4]) for r in able[: len(able) * percent // 100]]


@pytest.mark.parametrize("most,percent", [(1, 10), (2, 45), (3, 100)])
def test_resampling_is_that_of_a_plain_version(spark, most, percent):
    rng = random.Random(most)
    rows = [(i, sentence(rng, rng.randrange(60))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, sentence(rng, 30)), (None, sentence(rng, 30)), rows[0], rows[1], rows[1], (900, sentence(rng, 40_000))]
    targets = [sentence(rng, 200).replace("ba", "ke"), None, "", "neu"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, doc_id int")
    df = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("weighed", F.lit(1))
    got = importance.resample(df, target, most=most, percent=percent).collect()
    plain, drawn = resampled_plainly(rows, targets, most, percent)
    assert Counter(tuple(r)[:5] for r in got) == Counter(plain)
    chosen = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in chosen] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in chosen] == drawn


def test_resampling_of_nothing_and_towards_nothing(spark):
    none = docs(spark, [])
    assert importance.resample(none, none).count() == 0
    some = docs(spark, [(i, sentence(random.Random(i), 25)) for i in range(20)])
    got = importance.resample(some, none).collect()
    assert len(got) == 20 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert importance.resample(none, some).count() == 0
