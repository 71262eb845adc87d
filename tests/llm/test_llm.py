"""The training-data operators against plain versions, with the odd rows that each has to bear."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from furrow.llm import chat, decontaminate, html_text, language, mixing, order_minhash, quality, tokens, toxicity, url_filter
from furrow.llm.components import components
from furrow.llm.words import occurrence_labelled, shingle_hashes, word_hashes

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = [a + b for a in ("ba", "ke", "li", "mo", "nu", "éa", "zü") for b in ("r", "st", "ne", "lo", "x")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# Decontamination


def hits_by_brute_force(text, items, window=13):
    words = WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for item_id, item in items:
        w = WORD.findall(ascii_lower(item or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit |= set(range(at, at + len(p)))
                    found.add(None if item_id is None else str(item_id))
    return len(words), len(hit), sorted(i for i in found if i is not None), len(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_finds_what_brute_force_finds(spark, block_bytes):
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(14)]
    items += [(3, items[3][1]), (None, sentence(rng, 20)), (20, ""), (21, None), (22, "A,B;c")]
    rows = [(0, None), (1, ""), (2, "?!"), (3, items[5][1].upper().replace(" ", ", "))]
    for i in range(4, 40):
        parts = [sentence(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w) - 12))
            parts += [" ".join(w[a : a + rng.randrange(10, 20)]), sentence(rng, rng.randrange(30))]
        rows.append((i, ". ".join(parts)))
    rows.append(rows[-1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows).withColumn("hits_so_far", F.lit("mine"))
    got = decontaminate.contamination(df, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        n, h, ids, n_items = hits_by_brute_force(r["text"], items)
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"], c["n_items"]) == (n, h, ids, n_items), r["doc_id"]
        assert c["contaminated"] == (h > 0 and 20 * h >= n)
        assert c["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r["hits_so_far"] == "mine"


def test_decontamination_in_many_blocks_keeps_one_worker_a_task(spark):
    rng = random.Random(21)
    items = [(i, sentence(rng, 60)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{sentence(rng, 20)} {' '.join(items[i % 40][1].split()[5:30])} {sentence(rng, 400)}") for i in range(60)] + [(99, None)]
    df = docs(spark, rows)
    small = sum(len(t) for _, t in items) // 20
    assert len(list(decontaminate._blocks(bench, small))) >= 20
    many, one = decontaminate.contamination(df, bench, block_bytes=small), decontaminate.contamination(df, bench)
    assert many._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert sorted((r["doc_id"], r["contamination"]) for r in many.collect()) == sorted((r["doc_id"], r["contamination"]) for r in one.collect())


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert not decontaminate.contamination(docs(spark, [(1, "a b")]), none).first()["contamination"]["contaminated"]


# Mixing


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(1, 30)), None, rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(9000, None, None, "empty"), (9001, "", None, "empty"), (None, "x y z", None, "b"), rows[0]]
    got = mixing.mix(docs(spark, rows).withColumn("mix", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r["mix"] == 1 for r in got)
    total = sum(len((r[1] or "").split()) for r in rows)
    sources = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        s = sources.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0], s[1] = s[0] + r["size"], s[1] + r["taken"]
    weights = dict(zip(sorted(s for s in sources if s is not None) + [None], itertools.cycle([1, 2, 3]), strict=False))
    open_, target = dict(weights), {}
    left = total
    while True:  # water-filling, one round after the other
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 3 * sources[s][0]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * sources[s][0]
            left -= target[s]
            del open_[s]
    for s, (size, taken, known, wanted) in sources.items():
        assert size == known and wanted == pytest.approx(target[s])
        assert abs(taken - wanted) <= 30
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mix_of_many_sources_and_a_long_text(spark):
    rng = random.Random(22)
    rows = [(i, sentence(rng, rng.randrange(1, 12)), None, f"s{i % 300:03d}") for i in range(1500)] + [(9000, sentence(rng, 100_000), None, None)]
    got = mixing.mix(docs(spark, rows)).collect()
    per = {}
    for r in got:
        s = per.setdefault(r["source"], [r["source_size"], r["target"], 0])
        s[2] += r["taken"]
    level = {}
    for k, name in enumerate([*sorted(s for s in per if s is not None), None]):
        size, target, taken = per[name]
        assert target <= 3 * size + 1e-6 and (name is None or abs(taken - target) <= 12)
        if target < 3 * size - 1e-6:
            level[name] = target / (k % 3 + 1)
    assert sum(t for _, t, _ in per.values()) == pytest.approx(sum(s for s, *_ in per.values())) or not level
    assert max(level.values(), default=1) == pytest.approx(min(level.values(), default=1))


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


# Quality


def measures_by_brute_force(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(again),
    }


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(3)
    plain = [f"The {sentence(rng, 12)} of the {sentence(rng, 30)}." for _ in range(40)]
    odd = "One two three four five six seven eight nine " * 3 + sentence(rng, 20)
    junk = " ".join("%%%$$$###" for _ in range(100))
    rows = [(i, t, "en") for i, t in enumerate(plain)]
    rows += [(100, None, "en"), (101, "", None), (102, odd, "en"), (103, junk, "en"), (104, "a\nb\na\n \n\na\x0bé", "xx"), rows[0]]
    got = {r["doc_id"]: r["quality"].asDict() for r in quality.assess(docs(spark, rows).withColumn("measured", F.lit(0))).collect()}
    for i, t, *_ in rows:
        want = measures_by_brute_force(t)
        assert {k: got[i][k] for k in want} == want, i
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert all(got[i]["kept"] for i in range(40)) and not got[103]["kept"] and not got[102]["kept"]
    assert quality.assess(docs(spark, [])).count() == 0


def test_quality_counts_rare_classes(spark):
    rng = random.Random(31)
    plain = [f"The {sentence(rng, 30)} of the {sentence(rng, 60)}." for _ in range(60)]
    table_rows = [" | ".join(sentence(rng, 80).split()) for _ in range(12)]
    runs = [" ".join(w for w in sentence(rng, 14).split() for _ in range(6)) for _ in range(6)]
    listed = ["\n".join(f"* {sentence(rng, 12)}" for _ in range(8)) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(plain + listed)]
    bad = [(100 + i, t, "en") for i, t in enumerate(table_rows + runs)]
    got = {r["doc_id"]: r["quality"] for r in quality.assess(docs(spark, rows + bad)).collect()}
    assert all(got[i]["kept"] for i, *_ in rows)
    assert not any(got[i]["kept"] for i, *_ in bad) and not any(got[i]["base_failed"] for i, *_ in bad[:12])
    corpus = docs(spark, rows + bad)
    stage = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, corpus, "").collect()}
    assert stage == {i for i, *_ in rows}


# Near-duplicates


def linked_by_brute_force(a, b):
    """Longest common subsequence of the five-word runs over their union, by the classic table."""
    def runs(t):
        w = WORD.findall(ascii_lower(t))
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    x, y = runs(a), runs(b)
    if not x or not y:
        return a == b
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] >= 0.8 * (len(x) + len(y) - row[-1]) - 1e-9


def near_copies(seed, n_groups=12):
    rng = random.Random(seed)
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + 1] = [] if kind == 0 and len(w) > 2 else [w[at], "neu"] if kind == 1 else ["anders"]
            texts.append(" ".join(w))
    shuffled = " ".join(sorted(texts[0].split(), key=lambda _: rng.random()))
    return texts + [shuffled, "", "", "?!", "?!", "!?", "The, END", "the end"]


def classes_by_brute_force(texts):
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] is not None and texts[j] is not None and linked_by_brute_force(texts[i], texts[j]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("seed", [4, 5])
def test_near_duplicate_classes_are_those_of_brute_force(spark, seed):
    texts = [*near_copies(seed), None, None]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts)


def test_one_row_of_each_class_stays(spark):
    texts = near_copies(6, 5)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s"), (0, texts[0], "en", "s"), (None, texts[1], None, None)]
    df = docs(spark, rows).withColumn("copies", F.lit("mine"))
    left = order_minhash.keep_one(df).collect()
    assert set(left[0].asDict()) == {"doc_id", "text", "lang", "source", "copies"}
    group = classes_by_brute_force([r[1] for r in rows])
    assert Counter(r["doc_id"] for r in left) == Counter(set(group))
    assert order_minhash.keep_one(docs(spark, [])).count() == 0


def test_classes_of_long_texts_with_clashing_columns(spark):
    rng = random.Random(51)
    long = sentence(rng, 60_000)
    rows = [(1, long), (2, long.replace(" ", "  ")), (3, long + " one more"), (4, sentence(rng, 60_000)), (1, long)]
    df = docs(spark, rows)
    for name in ("unit", "copy", "bucket", "class", "one", "first"):
        df = df.withColumn(name, F.lit("mine"))
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in order_minhash.classes(df).collect())
    assert got == Counter({(1, 1, 4): 2, (2, 1, 4): 1, (3, 1, 4): 1, (4, 4, 1): 1})


def test_banded_alignment_is_exact_within_its_band():
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        row = [0] * (len(b) + 1)
        for p in a:
            new = [0]
            for j, q in enumerate(b):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
            row = new
        assert order_minhash.aligned(a, b, len(b) - len(a) + 5) == row[-1]


def test_sketches_keep_text_order():
    forward = shingle_hashes(word_hashes(" ".join(VOCABULARY)), 5)
    assert order_minhash.sketch_hashes(forward) != order_minhash.sketch_hashes(forward[::-1].copy())
    twice = shingle_hashes(word_hashes("a b c d e f " * 3), 5)
    assert len(set(occurrence_labelled(twice).tolist())) == len(twice) > len(set(twice.tolist()))


def test_word_hashes_do_not_depend_on_pieces():
    text = " ".join(VOCABULARY * 30) + " x" * 50
    whole = word_hashes(text)
    assert len(whole) == len(WORD.findall(ascii_lower(text))) and len(set(whole.tolist())) == len(set(text.split()))
    for piece in (1, 7, 100):
        assert (word_hashes(text, piece) == whole).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pages


PAGES = {
    "<article><h1>A &amp; B</h1><p>One<br>two&nbsp;<b>th</b>ree<p>Four</article><footer>x</footer>": "A & B\n\nOne two three\n\nFour",
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><main><p>Text here.</p><form>Name <input></form><aside>more</aside></main><script>var t='</p>';</script>": "Text here.",
    "<div class='cookie-banner'>We use cookies</div><div id=menu><a>a</a><a>b</a></div><div class=post><h1>Head</h1><p>"
    + "Long text with many words. " * 5
    + "</p><p>Short.</p><p>" + "Closing text with many words. " * 5 + "</p></div><div class=comments><p>I liked this.</p></div>":
        "Head\n\n" + " ".join(["Long text with many words."] * 5) + "\n\nShort.\n\n" + " ".join(["Closing text with many words."] * 5),
    "<body><div class=side-rail>Links</div><div><p>Tiny.</p><p>" + "Plain page without an article element. " * 6 + "</p><p>End.</p></div><div class=footer>f</div>":
        "Tiny.\n\n" + " ".join(["Plain page without an article element."] * 6) + "\n\nEnd.",
    "<article><header><h1>T</h1></header><p>Body text.</p><div class=comments><p>Nice one, thank you.</p></div><section id=newsletter-signup>Mail</section></article>": "T\n\nBody text.",
    "no markup at all": "no markup at all", "": "", "<p></p><br>": "", "<nav>only menu</nav>": "",
}


def test_main_text(spark):
    rows = [(i, "u", h) for i, h in enumerate(PAGES)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(want)
    assert got[99]["text"] == "" and got[99]["url"] is None


PROSE = " ".join(["Plain prose that goes on for a while."] * 6)
KEPT_PAGES = {
    f"<svg viewBox='0 0 1 1'/><math/><object data=x /><p>{PROSE}</p>": PROSE,
    f"<article><p>One.<svg/></p><p>{PROSE}</p></article>": f"One.\n\n{PROSE}",
    f"<body><form id=aspnetForm><article><p>{PROSE}</p></article></form></body>": PROSE,
    f"<body><form action=/><div><p>{PROSE}</p><p>{PROSE}</p></div></form></body>": f"{PROSE}\n\n{PROSE}",
    f"<article><p>{PROSE}</p><section id='related-work'><p>{PROSE}</p></section><h2 id='social-history'>Social history</h2><p>{PROSE}</p>"
    f"<section id='related'>Other</section><div class='share-bar'>Share</div></article>": f"{PROSE}\n\n{PROSE}\n\nSocial history\n\n{PROSE}",
    f"<div><p>{PROSE}</p><p><a href=/x>{PROSE}</a></p><p>{PROSE}</p></div>": f"{PROSE}\n\n{PROSE}\n\n{PROSE}",
}


@pytest.mark.parametrize("page", KEPT_PAGES)
def test_main_text_keeps(page):
    assert html_text.main_text(page) == KEPT_PAGES[page]


def test_main_text_clusters_lines():
    tags = "".join(f"<ul><li><a href=/t><b>tag{i}</b></a></li></ul>" for i in range(12))
    page = f"<article><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>{tags}</div></article><article><p>{PROSE}</p><p>End.</p></article>"
    got = html_text.main_text(page).split("\n\n")
    assert [x for x in got if not x.startswith("tag")] == ["Head", PROSE, "Short.", PROSE, PROSE, "End."]
    assert not {f"tag{i}" for i in range(2, 10)} & set(got)
    bits = "".join(f"<div><b>x{i}</b><i>y</i></div>" for i in range(12))
    got = html_text.main_text(f"<div><p>{PROSE}</p></div><div><div>{bits}</div></div><section><p>{PROSE}</p><p>End.</p></section>").split("\n\n")
    assert [x for x in got if not x.startswith("x")] == [PROSE, PROSE, "End."] and not {f"x{i}y" for i in range(2, 10)} & set(got)


@pytest.mark.parametrize("article", [True, False])
def test_main_text_goes_by_its_ratios(monkeypatch, article):
    page = "".join(f"<div><b>x{i}</b><i>y</i></div>" for i in range(12))
    page = f"<div>{page}</div><p>{PROSE}</p><p>{PROSE}</p><div>{page}</div>"
    page = f"<article>{page}</article>" if article else page
    by_ratio = html_text.main_text(page)
    assert PROSE in by_ratio and "x5y" not in by_ratio
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1.0: np.ones(len(ratios)))
    assert html_text.main_text(page) != by_ratio


def test_smoothing_is_a_gaussian_average():
    ratios = np.random.default_rng(5).uniform(0, 50, 30)
    padded = np.concatenate([np.full(2, ratios[0]), ratios, np.full(2, ratios[-1])])
    weights = np.exp(-np.array([4, 1, 0, 1, 4]) / 2)
    want = [(padded[i : i + 5] * weights).sum() / weights.sum() for i in range(30)]
    assert html_text.smoothed(ratios) == pytest.approx(want)


def test_main_text_of_nothing_of_repeats_and_of_long_and_deep_pages(spark):
    long, deep = f"<article>{f'<p>{PROSE}</p>' * 4000}</article>", "<div>" * 3000 + f"<p>{PROSE}</p>"
    pages = spark.createDataFrame([(1, long), (1, long), (2, deep), (3, None)], "page_id long, html string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert got[0] == got[1] and got[0]["text"].count(PROSE) == 4000 and got[2]["text"] == PROSE and got[3]["n_chars"] == 0
    assert html_text.extract(pages.limit(0)).count() == 0


# Toxicity


def toxic_rows(rng, n):
    insults = ["blorkhead", "snivelwit", "gruntface"]
    rows = []
    for i in range(n):
        words = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(rng.randrange(20, 300))]
        bad = i % 3 == 0
        for _ in range(max(1, len(words) // 60) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(random.Random(8), 700)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 10] + [(1, 0, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, [r[:2] for r in rows] + [(None, None), (9000, ""), (9001, "?!")])
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 or i % 10 == 0]
    right = np.mean([(got[i] >= 0.5) == y for i, y in held])
    assert right > 0.97 and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.5
    assert model.score(f"{sentence(random.Random(9), 30)} blorkhaed gruntfacee") > model.score(sentence(random.Random(9), 30))
    assert toxicity.fold(F.col("doc_id")) is not None
    folds = df.select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).where("doc_id is not null").collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in folds)


def plain_toxicity(model, text):
    """A text's score word by word and gram by gram."""
    words = list(dict.fromkeys(WORD.findall(ascii_lower(text or ""))))
    if not words:
        return model.base
    mask = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return x ^ (x >> 33)

    def of(word):
        marked = f"<{word}>"
        grams = [mixed((sum((ord(c) + 1) * pow(0x100000001B3, n - 1 - k, 1 << 64) for k, c in enumerate(marked[i : i + n])) + n) & mask)
                 for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        grams.append(mixed(sum((ord(c) + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(marked)) & mask))
        return np.mean([model.bucket_scores[g >> 48] for g in grams])

    scores = [of(w) for w in words]
    if model.window is None:
        best = np.mean(scores)
    else:
        step = model.window // 2
        starts = range(0, max(1, len(words) - step), step)
        best = max(np.mean(scores[a : a + model.window]) for a in starts)
    return 1 / (1 + np.exp(-(model.bias + best)))


@pytest.mark.parametrize("window", [toxicity.WINDOW, None])
def test_toxicity_scores_are_those_of_a_plain_version(window):
    rng = random.Random(31)
    texts = [None, "", "?!", "a", "Ümläut 😀 ßx"] + [sentence(rng, rng.choice([1, 5, 6, 7, 12, 13, 18, 19, 200])) for _ in range(40)]
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), -0.3, 0.1, window)
    want = [plain_toxicity(model, t) for t in texts]
    assert model.scores(texts) == pytest.approx(want) and [model.score(t) for t in texts] == pytest.approx(want)
    assert toxicity.train([t for _, t, _ in toxic_rows(rng, 60)], [y for *_, y in toxic_rows(rng, 60)], window=window).window == window


def test_toxicity_of_nothing_of_repeats_and_of_long_texts(spark):
    model = toxicity.Model(np.random.default_rng(2).normal(size=toxicity.BUCKETS), -0.3, 0.1)
    long = sentence(random.Random(3), 300_000)
    assert toxicity.score(docs(spark, []), model).count() == 0
    got = [r["score"] for r in toxicity.score(docs(spark, [(1, long), (1, long), (2, None)]), model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == model.score(long) and got[2] == model.base


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a")]), none)
    assert 0 <= model.score("a") <= 1 and 0 <= model.score(None) <= 1


def test_one_long_text_leaves_the_others_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8000)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    first = min(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    df = docs(spark, [(i, "word " * (2000 if i == first else 5)) for i in ids])
    sample, _ = toxicity.training_sample(df, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int"))
    assert sample.count() == len(ids) - 1


# Chat


def test_chat_of_long_roles_and_clashing_columns(spark):
    long = "role\\\n<|" * 25_000
    rows = [(1, 0, long, "x"), (1, 1, "assistant", "y\\<|" * 200_000), (2, 0, long[:-1], "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("turns", "out", "n", "end", "t", "example", "last"):
        df = df.withColumn(name, F.lit("mine"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    for c in (1, 2):
        text = "".join(f"{r}\n{t}\n" for i, _, r, t in rows if i == c)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[2]["loss_chars"] == 0


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|im_end|>", "a\nb\n", "", "<|im_start|>user\nx<|im_end|>\n", "é😀", "\\n"]
    rng = random.Random(10)
    rows = []
    for c in range(40):
        for i in range(rng.randrange(1, 9)):
            rows.append((c, i, rng.choice(["user", "assistant", "system", "tool\nrole", "<|x", None]), rng.choice([*tricky, None, "plain text"])))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (41, 0, "assistant", "same"), (41, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    made = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest(), turns
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    lengths = {r["conv_id"]: r["n"] for r in made.groupBy("conv_id").agg(F.sum(F.length(F.concat("context", F.coalesce("target", F.lit(""))))).alias("n")).collect()}
    assert all(got[c]["formatted_chars"] == lengths[c] for c in got)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


# Tokens


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    rng = random.Random(11)
    alphabet = list(" ab▁\n\t<s>the1é日²x   ") + ["😀", "the ", "ing", "  ", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", None, "x" * 5000, "<s></s><unk>", "Zwölf Boxkämpfer jagen " * 50]
    got = tokens.count_tokens(docs(spark, list(enumerate(texts))).withColumn("n_tokens", F.lit("old")), limit=20).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 20)
    counter = tokens.counter(tokens.MODEL)
    for t in filter(None, texts[:60]):
        prefixes = counter.prefixes(t)
        assert prefixes == [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        for budget in (0, 1, 5):
            assert len(counter.truncated(t, budget)) == max(i for i, n in enumerate(prefixes) if n <= budget)
    cut = tokens.truncate_tokens(docs(spark, [(1, "one two three four"), (2, None)]), 2).orderBy("doc_id").collect()
    assert cut[1]["text"] is None and len(library.encode(cut[0]["text"])) <= 2


# URLs


def test_tokens_of_nothing_and_of_repeats(spark):
    assert tokens.count_tokens(docs(spark, [])).count() == 0 and tokens.truncate_tokens(docs(spark, []), 3).count() == 0
    got = tokens.count_tokens(docs(spark, [(1, "a b"), (1, "a b"), (2, None)]).withColumn("n_tokens", F.lit("x"))).orderBy("doc_id").collect()
    assert got[0] == got[1] and got[2]["n_tokens"] == 0


def test_urls_of_repeats_long_ones_and_clashing_columns(spark):
    long = "http://a.example.de/" + "x" * 300_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://B.org/fr/x"), (3, None)], "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "reputation"):
        pages = pages.withColumn(name, F.lit("mine"))
    outcomes = spark.createDataFrame([], "url string, bad int")
    got = url_filter.judge(pages, outcomes).orderBy("page_id").collect()
    assert got[0] == got[1] and got[0]["path"] == long[len("http://a.example.de") :] and got[0]["reputation"] == "mine"
    assert (got[2]["host"], got[2]["rule"], got[2]["verdict"]) == ("b.org", "org/fr/", "allow") and got[3]["host"] == ""
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def test_url_rules_and_reputation(spark):
    urls = [
        "https://Sub.Example.NET/en/1?x", "http://example.net/de/2#y", "http://a.example.com/de/3", "http://badexample.com/de/", "https://x.org/fr/", "x.org/fr/",
        None, "", "://", "http://good.test/a", "http://bad.test/a", "http://u:p@host:80/p//q?z=http://net/", "http://NET",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("reputation", F.lit(1))
    outcomes = spark.createDataFrame([("http://bad.test/", 1)] * 60 + [("http://good.test/", 0)] * 60 + [(None, 1), ("http://good.test", None)], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, outcomes).collect()}
    assert got[0] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/2", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2] is None
    assert got[4][2:] == ("org/fr/", "allow") and got[5][:3] == ("", "", None)
    assert got[6][:2] == got[7][:2] == got[8][:2] == ("", "")
    assert got[9][3] == "allow" and got[10][3] == "block"
    assert got[11][:2] == ("u:p@host:80", "/p//q") and got[12][:3] == ("net", "", None)
    nothing = outcomes.limit(0)
    assert url_filter.judge(pages, nothing).where("rule is null and verdict != 'allow'").count() == 0
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    outcomes = spark.createDataFrame([("a.bad.test", 1)] * 50 + [("b.bad.test", 1)] * 50 + [("a.good.test", 0)] * 100, "host string, bad int")
    hosts = spark.createDataFrame([("new.bad.test",), ("new.good.test",), ("other.test",)], "host string")
    mean = {r["host"]: r["bad_mean"] for r in url_filter.reputations(hosts, outcomes).collect()}
    assert mean["new.good.test"] < mean["other.test"] < mean["new.bad.test"]


# Languages


def test_languages_on_held_out_rows(spark):
    rng = random.Random(12)
    kinds = {"aa": ["kal", "ömu", "rik"], "bb": ["sth", "ing", "wo"], "cc": ["ção", "eja", "lu"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(300))]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ?!", "cc"), (None, "ingwo sthing", None), (1003, rows[0][1], None)]
    df = docs(spark, rows + odd)
    model = language.fit(df)
    got = {r["doc_id"]: r for r in language.identify(df.select("doc_id", "text").withColumn("score", F.lit("x")), model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == k for i, k in held]) > 0.98
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.fit(df.limit(0)).predict("text") == ("und", 0.0, True)


def test_languages_are_those_of_a_plain_version(spark):
    rng = random.Random(41)
    rows = [(lang, "".join(rng.choice(letters) for _ in range(200))) for lang, letters in (("aa", "abc de"), ("bb", "vwx yz"), ("cc", "mno pq")) for _ in range(12)]
    model = language.train([(lang, language.features(t)) for lang, t in rows])
    texts = [t for _, t in rows] + ["abc vwx", "mno", None, "", "12 ²", "éà", rows[0][1] * 5000]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, list(enumerate(texts)) + [(0, texts[0])]), model).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["ambiguous"]) == ("und", 0, True)
            continue
        data, counts = re.sub(r"[\W\d_]+", " ", f" {t} ").lower().encode(), np.zeros(language.FEATURES)
        for n in (1, 2, 3):
            for a in range(len(data) - n + 1):
                h = 0
                for b in data[a : a + n]:
                    h = (h * 257 + b + 1) & 0xFFFFFFFF
                counts[((h * 2654435761) & 0xFFFFFFFF) >> 20] += 1
            if len(t) > 100_000:
                break
        if len(t) > 100_000:
            assert got[i]["lang_pred"] == "aa"
            continue
        margins = np.sqrt(counts / counts.sum()) @ model.weights + model.bias
        loss = {lang: sum(np.log1p(np.exp(-c * m)) for c, m in zip(word, margins, strict=True)) for lang, word in zip(model.languages, model.code, strict=True)}
        odds = {lang: np.exp(-x) for lang, x in loss.items()}
        shares = sorted((x / sum(odds.values()) for x in odds.values()), reverse=True)
        assert got[i]["lang_pred"] == min(loss, key=loss.get) and got[i]["score"] == pytest.approx(shares[0], abs=1e-4)
        assert got[i]["ambiguous"] == (shares[0] - shares[1] < language.LEAD)
    assert language.identify(docs(spark, []), model).count() == 0
    tie = language.Model(["x", "y"], np.array([[1], [1]]), np.zeros((language.FEATURES, 1), np.float32), np.zeros(1))
    assert tie.predict("abc") == ("x", 0.5, True)


def test_languages_beyond_the_sample_are_learned(spark):
    rows = [(i, chr(97 + i % 8) * 3 + " " + chr(97 + i % 8) * 4, f"l{i % 8}") for i in range(80)] + [(None, f"{'z' * k} zz", "zz") for k in range(2, 9)]
    model = language.fit(docs(spark, [(*r, None) for r in rows]), sample=4)
    assert model.languages == [*(f"l{k}" for k in range(8)), "zz"]


def test_many_codewords_keep_their_distance():
    for n in (6, 30, 200):
        words = language.codewords(n)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 0.19 * words.shape[1] and (np.abs(words.sum(0)) < n).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    apart = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
    assert not apart or min(apart) >= (1 if n < 3 else 2)


def test_url_suffixes_and_ports(spark):
    hosts = {
        "www.shop.co.uk": ("co.uk", "shop.co.uk"), "a.b.com.br:8080": ("com.br", "b.com.br"), "co.uk": ("co.uk", "co.uk"),
        "x.example.com:443": ("com", "example.com"), "example.org": ("org", "example.org"), "": ("", ""), "localhost:80": ("localhost", "localhost"),
    }
    h = F.col("host")
    df = spark.createDataFrame([(x,) for x in hosts], "host string").select(h, url_filter.suffix(h).alias("s"), url_filter.domain(h).alias("d"))
    assert {r["host"]: (r["s"], r["d"]) for r in df.collect()} == hosts
    bad = [(f"http://{x}.bad.co.uk/", 1) for x in "abcdef" for _ in range(20)]
    good = [(f"http://{x}.good.co.uk:80/", 0) for x in "abcdef" for _ in range(20)]
    pages = spark.createDataFrame([("http://new.bad.co.uk/",), ("http://new.good.co.uk/",), ("http://a.bad.co.uk:81/",)], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame(bad + good, "url string, bad int")).collect()}
    assert got == {"http://new.bad.co.uk/": "block", "http://new.good.co.uk/": "allow", "http://a.bad.co.uk:81/": "block"}
