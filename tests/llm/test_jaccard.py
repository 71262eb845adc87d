"""The Jaccard join against all pairs, its filters against their promise, and its blocks under load."""

import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.llm import jaccard_join as J
from tests.llm.test_llm import ascii_lower, docs, sentence

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = BLANK.findall(ascii_lower(text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def joined_plainly(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((doc_id, len(s), least[top(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True)))


def changed(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng, families=12):
    rows = []
    for _ in range(families):
        base = sentence(rng, rng.choice([3, 9, 10, 11, 21, 40, 130, 400]))
        for _ in range(rng.randrange(1, 9)):
            base = changed(rng, base, rng.choice([0, 1, 1, 2, 3]))
            rows.append(base)
    passage = sentence(rng, 150)
    rows += [f"{sentence(rng, 8)} {passage} {sentence(rng, 8)}" for _ in range(40)]
    rows += [None, "", " \n", "one", "ONE", "one two", "one  two", "two one", "one two three", "One\tTwo three four", "a b c " * 400, "a b c " * 900]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng)
    rows += [rows[0], rows[1], rows[1], (None, rows[2][1]), (None, "nobody else has this"), (None, None)]
    df = docs(spark, rows).select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("bucket"), F.lit(2).alias("s"))
    assert Counter(tuple(r) for r in J.join(df).collect()) == joined_plainly(rows)


def test_small_blocks_and_heavy_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    monkeypatch.setattr(J, "FOLLOWERS", 2)
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    rng = random.Random(7)
    core = sentence(rng, 100)
    rows = [(i, changed(rng, core, rng.choice([1, 2, 3, 4]))) for i in range(120)] + [(500 + i, core) for i in range(150)]
    assert Counter(tuple(r) for r in J.join(docs(spark, rows)).collect()) == joined_plainly(rows)


def test_nothing_joins_nothing(spark):
    assert J.join(docs(spark, [])).count() == 0
    assert [tuple(r) for r in J.join(docs(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_long_texts_join_whole(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, text), (2, text + " more"), (3, text[: len(text) // 2])]
    assert {r["doc_id"]: r["component_id"] for r in J.join(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_linked_sets_share_a_prefix_element_in_every_order():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    for _ in range(200):
        n = int(rng.integers(1, 120))
        core = rng.choice(2**60, n, replace=False).astype(np.int64)
        df = {int(e): int(x) for e, x in zip(core, rng.integers(2, 40, n), strict=True)}
        sets = []
        for _ in range(2):
            own = rng.integers(2**61, 2**62, int(rng.integers(0, n // 12 + 2)))
            sets.append((np.sort(core[rng.random(n) > 0.03]), len(own)))
        (a, more_a), (b, more_b) = sets
        n_a, n_b, shared = len(a) + more_a, len(b) + more_b, len(np.intersect1d(a, b))
        if not len(a) or not len(b):
            continue
        got = J.prefixes(pa.array([n_a, n_b]), pa.array([a, b]), pa.array([[df[int(e)] for e in x] for x in (a, b)], pa.list_(pa.int64())))
        if J.reaches(shared, n_a, n_b):
            assert all(set(x[k]) & set(y[k]) for x, y in [got.to_pylist()] for k in ("first", "second", "third"))
        assert J.linked(a, b) == J.reaches(shared, len(a), len(b))


def test_a_block_of_many_short_units_ends_soon():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2**62, (J.BLOCK_ROWS, 2))
    lists = [np.array([7, *x]) for x in own]
    block = pd.DataFrame({"bucket": 1, "unit": [i.to_bytes(16) for i in range(len(lists))], "component": [i.to_bytes(16) for i in range(len(lists))],
                          "n": 12, "second": lists, "third": [np.array(x[1:]) for x in lists], "asks": True, "i": 0, "j": 0})
    began = time.perf_counter()
    assert not len(J.close_ones(block)) and time.perf_counter() - began < 10
