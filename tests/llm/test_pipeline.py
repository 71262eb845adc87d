"""The corpus pipeline, stage by stage, against plain versions of the stages."""

import math
import random

import pytest

import corpus_pipeline
from furrow.llm import quality, toxicity
from tests.llm.test_llm import DOCS, classes_by_brute_force, hits_by_brute_force, measures_by_brute_force, sentence


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, sentence(rng, 20)) for i in range(5)]
    rows = []
    for i in range(150):
        words = f"The {sentence(rng, rng.randrange(30, 80))} of the end.".split()
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(["blorkhead", "snivelwit"])
        if i % 10 == 3:
            words += items[i % 5][1].split()
        rows.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "a", "b", None])))
    rows += [(200 + i, rows[i][1] + " extra", "en", "a") for i in range(0, 40, 3)]
    rows += [(300, rows[1][1], "en", "b"), (301, None, None, None), (302, "", "en", "a"), (303, "%%% $$$ " * 60, "en", "b"), rows[2], (None, rows[4][1], "en", "a")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))


def kept_by_quality(rows):
    sums = {}
    for r in rows:
        for k, h in enumerate(quality.histograms(r["text"])):
            old = sums.setdefault((r["lang"], k), [0] * len(h))
            sums[r["lang"], k] = [a + b for a, b in zip(old, h, strict=True)]
    for r in rows:
        m = measures_by_brute_force(r["text"])
        if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
            continue
        chars, words = quality.histograms(r["text"])
        odd = sum(chars) >= quality.GUARD_CHARS and distance(chars, sums[r["lang"], 0]) > quality.MOST_CHARS
        if not odd and not (m["n_words"] >= quality.GUARD_WORDS and distance(words, sums[r["lang"], 1]) > quality.MOST_WORDS):
            yield r


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["lang"] or "", r["source"] or "")


def test_stages(spark, corpus):
    folder, items = corpus
    before = spark.read.parquet(f"{folder}/documents.parquet")
    columns, states = before.columns, [before.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            after.write.parquet(f"{folder}/stage{k}")
            before = spark.read.parquet(f"{folder}/stage{k}")
            states.append(before.collect())
        else:
            last = after.collect()
    assert sorted(map(key, states[1])) == sorted(map(key, kept_by_quality(states[0])))
    model = toxicity.fit(spark.read.parquet(f"{folder}/stage0"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(map(key, states[2])) == sorted(key(r) for r in states[1] if model.score(r["text"]) < 0.5)
    rows = sorted(states[2], key=key)
    groups = classes_by_brute_force([r["text"] for r in rows])
    assert sorted(map(key, states[3])) == sorted(key(rows[g]) for g in set(groups))
    clean = [r for r in states[3] if (h := hits_by_brute_force(r["text"], items)) and not (h[1] and 20 * h[1] >= h[0])]
    assert sorted(map(key, states[4])) == sorted(map(key, clean)) and len(clean) < len(states[3])
    taken = {}
    for r in last:
        assert 1 <= r["copies"] <= 3 and r["size"] == len(r["text"].split() if "text" in r else range(r["size"]))
        s = taken.setdefault(r["source"], [0, r["target"]])
        s[0] += r["taken"]
    assert all(abs(n - target) <= 100 for n, target in taken.values())


def test_run_is_the_stages_one_after_the_other(spark, corpus):
    folder, _ = corpus
    got = sorted((r["doc_id"] or -1, r["taken"]) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/again{k}")
        docs = spark.read.parquet(f"{folder}/again{k}")
    assert got == sorted((r["doc_id"] or -1, r["taken"]) for r in docs.collect())


def test_stages_of_no_documents_and_of_odd_ones(spark, corpus):
    folder, _ = corpus
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    odd = documents.where("text is null or text = ''").selectExpr("*", "1 AS n_chars", "'x' AS stay", "'y' AS mix", "'z' AS score")
    for df in (documents.limit(0), odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, folder)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == df.columns
            assert out.count() <= df.count()


def test_a_very_long_text_is_judged_whole(spark):
    from furrow.llm import decontaminate, tokens
    from tests.llm.test_llm import docs

    rng = random.Random(30)
    item = sentence(rng, 15)
    long = f"{sentence(rng, 200_000)} {item}"
    df = docs(spark, [(1, long)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    c = decontaminate.contamination(df, bench).first()["contamination"]
    assert c["n_words"] == 200_015 and c["n_hit"] >= 15 and not c["contaminated"]
    m = quality.assess(df).first()["quality"]
    assert m["n_words"] == 200_015
    assert tokens.count_tokens(df).first()["n_tokens"] > 200_000
