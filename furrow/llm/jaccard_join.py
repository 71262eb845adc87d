"""Similarity join of documents by the Jaccard index of their n-gram sets, exact, with prefix filters under several orders.

A text's set is that of its three-word shingles, as 64-bit hashes. Texts of equal sets
are one unit. Two sets of n and m elements that reach the limit share so much that,
whatever the order in which all elements of all sets are put, the first
n - ceil(limit n) + 1 elements of the one and those of the other (their prefixes)
have one in common. So a pair has to pass this filter under each of several global
orders before its sets are compared, and no pair that links is ever filtered away.
All orders begin with the elements that only one unit has, which prove at no cost
that a prefix is shared with nobody; then come

1. the other elements by the number of units that have them, rarest first;
2. by the number of binary digits of that number, in another random order;
3. in a third random order, whatever the number.

What is done, in this order:

- Of a quarter of all elements (by hash), those that a single unit has are counted for
  each unit. A unit with as many of them as its prefix is long is linked with nobody; that
  settles most texts without a look at their other elements.
- For the rest, elements are counted by units, and prefixes are made. Elements of the
  first order's prefixes are buckets.
- Each unit is compared with the least unit of most of its buckets; links make
  components, so a bucket that is one group isn't expanded into pairs.
- In buckets that hold several components, units outside the largest are held
  against units of others, in blocks of bounded rows and elements: pairs that share no
  prefix element in the second or the third order drop out, then sets are compared.
  A pair is skipped only where it is connected already.

Rows of a frequent element, bucket or unit don't meet in one task: keys with more
than a fixed share of all rows, whose number that share bounds, are broadcast.
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
from furrow.llm.order_minhash import copy_of
from furrow.llm.shared import BROADCAST_BYTES, settle
from furrow.llm.words import LOWER_BLANKS, mix64, shingle_hashes, word_hashes

SHINGLE = 3
#: Two sets link if 100 times their intersection is at least PERCENT times their union.
PERCENT = 90
#: One in so many elements is looked at to find units that nobody can be linked with.
SAMPLE = 4
#: A key with more than one in HEAVY of all rows is broadcast; there are at most so many of them.
HEAVY = 50_000
#: Rows and elements in a block, on average.
BLOCK_ROWS, BLOCK_ELEMENTS = 2_000, 500_000
#: Units compared with the same unit in one task, on average.
FOLLOWERS = 1_000
#: Bytes of a row without elements, at most.
ROW_BYTES = 160

#: How each order begins, from the number of units that have an element; random beyond that, with a seed of its own.
_ORDERS = [lambda df: df, lambda df: np.frexp(df.astype(np.float64))[1], lambda df: np.zeros(len(df))]
_SEEDS = mix64(np.arange(1, len(_ORDERS) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

GATHERED = "struct<unit: binary, u: long, n: long, sample: array<long>>"
PREFIXES = "struct<first: array<long>, second: array<long>, third: array<long>>"


def elements(text: str | None) -> np.ndarray:
    """The text's set, in increasing order."""
    return np.unique(shingle_hashes(word_hashes(text, fold=LOWER_BLANKS), SHINGLE))


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    values = np.concatenate(found) if found else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def gathered(texts: pa.Array) -> pa.Array:
    units, sizes, samples = [], [], []
    for t in texts:
        found = elements(t.as_py())
        units.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
        sizes.append(len(found))
        samples.append(found[found % np.uint64(SAMPLE) == 0])
    short = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in units]
    return pa.StructArray.from_arrays(
        [pa.array(units, pa.binary()), pa.array(short, pa.int64()), pa.array(sizes, pa.int64()), _lists(samples)], ["unit", "u", "n", "sample"]
    )


def elements_of(texts: pa.Array) -> pa.Array:
    return _lists([elements(t.as_py()) for t in texts])


def prefix_length(n):
    """Of a set of n elements; a number or a column."""
    need = F.floor((n * PERCENT + 99) / 100) if isinstance(n, Column) else (n * PERCENT + 99) // 100
    return n - need + 1


def prefixes(sizes: pa.Array, elements_: pa.Array, dfs: pa.Array) -> pa.Array:
    """The prefixes under all orders, without the elements of a single unit: those come first and are not among elements_."""
    out: list[list[np.ndarray]] = [[] for _ in _ORDERS]
    for n, found, df in zip(sizes.to_pylist(), elements_, dfs, strict=True):
        x, df = found.values.to_numpy(), df.values.to_numpy()
        take = max(prefix_length(n) - (n - len(x)), 0)
        for k, order in enumerate(_ORDERS):
            out[k].append(x[np.lexsort((mix64(x.view(np.uint64) * _SEEDS[k]), order(df)))[:take]])
    return pa.StructArray.from_arrays([_lists(x) for x in out], ["first", "second", "third"])


def reaches(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= PERCENT * (n + m - shared)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, in increasing order as unsigned numbers, reach the limit."""
    a, b, n, m = a.view(np.uint64), b.view(np.uint64), len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    at = np.searchsorted(b, a)
    return reaches(int((b[np.minimum(at, m - 1)] == a).sum()), n, m)


def verified(*columns: pa.Array) -> pa.Array:
    """For rows of two units each (elements, second and third prefix): whether they pass both filters and their sets reach the limit."""
    out = []
    for row in zip(*columns, strict=True):
        a, second_a, third_a, b, second_b, third_b = (x.values.to_numpy() for x in row)
        out.append(len(np.intersect1d(second_a, second_b)) > 0 and len(np.intersect1d(third_a, third_b)) > 0 and linked(a, b))
    return pa.array(out, pa.bool_())


def candidates(block: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(a unit that asks, those of other components that share a prefix element with it in the second and in the third order), by place in the block.

    The first order's element is that of the block's bucket.
    """
    sizes, component = block["n"].to_numpy(), pd.factorize(block["component"])[0]
    indexes = []
    for order in ("second", "third"):
        lists = [np.asarray(x, np.int64) for x in block[order]]
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        by = np.argsort(flat, kind="stable")
        indexes.append((lists, flat[by], owner[by]))
    for x in np.flatnonzero(block["asks"].to_numpy(bool)):
        near = component != component[x]
        near &= 100 * np.minimum(sizes, sizes[x]) >= PERCENT * np.maximum(sizes, sizes[x])
        for lists, flat, owner in indexes:
            lo, hi = np.searchsorted(flat, lists[x], "left"), np.searchsorted(flat, lists[x], "right")
            met = np.zeros(len(block), bool)
            for p, q in zip(lo, hi, strict=True):
                met[owner[p:q]] = True
            near &= met
        if near.any():
            yield x, np.flatnonzero(near)


def _once(block: pd.DataFrame) -> pd.DataFrame:
    """A unit that asks may be in the block as one that is asked too."""
    return block.sort_values(["asks", "unit"], ascending=[False, True], kind="stable").drop_duplicates("unit", ignore_index=True)


def close_ones(block: pd.DataFrame) -> pd.DataFrame:
    """The units of one block that pass all filters with a unit of another component."""
    block = _once(block)
    close = np.zeros(len(block), bool)
    for x, near in candidates(block):
        close[x] = close[near] = True
    return block.loc[close]


def links_between(block: pd.DataFrame) -> pd.DataFrame:
    """Links of the units of one block; pairs that a link of this block connects already are skipped."""
    block = _once(block)
    sets = [np.asarray(x, np.int64) for x in block["elements"]]
    root = {c: c for c in block["component"]}

    def top(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    own, found = block["component"].tolist(), []
    for x, near in candidates(block):
        for y in near:
            if top(own[x]) != top(own[y]) and linked(sets[x], sets[y]):
                root[top(own[x])] = top(own[y])
                found.append((block["unit"][x], block["unit"][y]))
    return pd.DataFrame(found, columns=["a", "b"])


def met(many: DataFrame, one: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """many with the columns of one, which has a row for each key and the number of its rows in ``size``, of ``total`` rows in all.

    Keys with more than total / HEAVY rows are broadcast (at most HEAVY, whatever the tables), the others shuffled.
    """
    limit = max(total // HEAVY, 100)
    heavy = F.broadcast(one.where(F.col(size) > limit))
    rest = many.join(heavy.select(on), on, "left_anti").join(one.where(F.col(size) <= limit), on)
    return many.join(heavy, on).unionByName(rest)


def _hinted(rows: DataFrame) -> DataFrame:
    """Broadcast if the written rows, of known width, are counted to be few bytes."""
    return F.broadcast(rows) if rows.count() * ROW_BYTES <= BROADCAST_BYTES else rows


def possible(seen: DataFrame) -> DataFrame:
    """(unit, u, n, one): the units that may be linked, with the key of a row that has each one's text."""
    some = seen.where("n > 0")
    own = some.select("u", F.explode("sample").alias("e")).groupBy("e").agg(F.min("u").alias("u"), F.max("u").alias("other")).where("u = other")
    own = own.groupBy("u").agg(F.count("*").alias("own"))
    units = some.groupBy("unit").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.min("copy").alias("one"))
    return units.join(own, "u", "left").where(F.coalesce("own", F.lit(0)) < prefix_length(F.col("n"))).select("unit", "u", "n", "one")


def with_prefixes(sets: DataFrame) -> DataFrame:
    """sets (unit, u, n, elements) with the prefixes first, second and third; only units that share an element in the first."""
    each = sets.select("u", F.explode("elements").alias("e"))
    counts = settle(each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = met(each, counts, "e", "df", total).groupBy("u").agg(F.collect_list(F.struct("e", "df")).alias("s"))
    some = sets.join(shared, "u").where(F.size("s") > F.col("n") - prefix_length(F.col("n")))
    made = F.arrow_udf(prefixes, PREFIXES)(F.col("n"), F.col("s.e"), F.col("s.df"))
    return some.withColumn("p", made).select("unit", "n", "elements", "p.*")


def links(units: DataFrame) -> DataFrame:
    """(a, b): links that connect all linked units (unit, n, elements, first, second, third), not all of them."""
    keys = units.select(F.explode("first").alias("bucket"), "unit")
    # Buckets of equal members would only repeat the same comparisons: two hashes of the set tell them apart.
    counted = settle(
        keys.groupBy("bucket").agg(
            F.min("unit").alias("least"), F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("unit")).alias("set_a"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("set_b"),
        ).where("size > 1").groupBy("size", "set_a", "set_b", "least").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
    ).select("bucket", "least", "size", "times")
    total = counted.agg(F.sum("size")).first()[0] or 0
    members = settle(met(keys, counted, "bucket", "size", total).select("bucket", "unit", "least", "times"))
    votes = members.where("unit != least").groupBy("unit", "least").agg(F.sum("times").alias("times"))
    firsts = settle(votes.groupBy("unit").agg(F.max_by("least", F.struct("times", "least")).alias("head")))
    heads = settle(firsts.groupBy("head").agg(F.ceil(F.count("*") / FOLLOWERS).alias("parts")))
    parts = ["elements", "second", "third"]
    each = units.select("unit", *parts).join(firsts, "unit").join(_hinted(heads), "head")
    each = each.withColumn("part", F.pmod(F.xxhash64("unit"), "parts")).drop("parts")
    head = units.select(F.col("unit").alias("head"), *(F.col(c).alias(f"head_{c}") for c in parts)).join(_hinted(heads), "head")
    head = head.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    check = F.arrow_udf(verified, "boolean")(*(F.col(c) for c in parts), *(F.col(f"head_{c}") for c in parts))
    found = settle(each.join(head, ["head", "part"]).where(check).select(F.col("head").alias("a"), F.col("unit").alias("b")))
    return found.unionByName(settle(_rest(members, units, components(found))))


def _rest(members: DataFrame, units: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between components in buckets that hold several of them."""
    named = found.withColumnsRenamed({"node": "unit"})
    placed = settle(members.select("bucket", "unit").join(named, "unit", "left").withColumn("component", F.coalesce("component", "unit")))
    mixed = settle(
        placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        .groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size"))
        .where("parts > 1").drop("parts")
    )
    total = mixed.agg(F.sum("size")).first()[0] or 0
    sized = met(placed, mixed, "bucket", "size", total).withColumn("asks", F.col("component") != F.col("main")).drop("main", "size")
    sized = settle(sized.join(units.select("unit", "n", "second", "third"), "unit"))
    asking = F.when(F.col("asks"), 1).otherwise(0)

    def number(rows: Column) -> Column:
        return F.greatest(F.ceil(F.sum(rows) / BLOCK_ROWS), F.ceil(F.sum(rows * F.col("n")) / BLOCK_ELEMENTS))

    blocks = settle(
        sized.groupBy("bucket").agg(number(asking).alias("ask_blocks"), number(F.lit(1)).alias("all_blocks"), F.count("*").alias("size"))
    )
    at = met(sized, blocks, "bucket", "size", total).drop("size")
    spot, row = F.xxhash64("unit"), ["bucket", "unit", "component", "n", "second", "third"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = at.where("asks").select(*row, "asks", F.pmod(spot, "ask_blocks").alias("i"), every("all_blocks").alias("j"))
    asked = at.select(*row, F.lit(False).alias("asks"), every("ask_blocks").alias("i"), F.pmod(spot, "all_blocks").alias("j"))
    # Dealt out by block, in as many tasks as the session has: few bytes for much work.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asks.unionByName(asked).repartition(tasks, "bucket", "i", "j")
    close = settle(dealt.groupBy("bucket", "i", "j").applyInPandas(close_ones, dealt.schema))
    whole = close.join(units.select("unit", "elements"), "unit").repartition(tasks, "bucket", "i", "j")
    return whole.groupBy("bucket", "i", "j").applyInPandas(links_between, "a binary, b binary").distinct()


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs: the size of its set, and the least doc_id that links reach from it.

    Two documents link if their sets' intersection is at least PERCENT in 100 of their
    union; ties at the limit link. A null text, or one without words, has an empty set
    and is linked with nothing: its component is its own id. Repeated rows have equal
    sets and so share a component. Null ids don't count as the least; a component
    without any other has a null one. Texts are taken whole, however long. An empty
    table gives an empty result. Other columns of docs, whatever their names, are left out.
    """
    copy = copy_of(text, doc_id)
    seen = settle(
        docs.select(F.col(doc_id).alias("doc_id"), copy.alias("copy"), F.arrow_udf(gathered, GATHERED)(F.col(text)).alias("s")).select("doc_id", "copy", "s.*")
    )
    few = settle(possible(seen))
    # The join's own partitioning by row key serves the grouping too: equal rows of one unit are one.
    sets = settle(
        docs.select(F.col(text).alias("text"), copy.alias("one")).join(_hinted(few), "one")
        .groupBy("one").agg(*(F.first(c).alias(c) for c in ("unit", "u", "n", "text")))
        .select("unit", "u", "n", F.arrow_udf(elements_of, "array<long>")(F.col("text")).alias("elements"))
    )
    found = components(links(settle(with_prefixes(sets)))).withColumnsRenamed({"node": "unit"})
    units = seen.where("n > 0").groupBy("unit").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classed = settle(units.join(found, "unit", "left").withColumn("component", F.coalesce("component", "unit")))
    each = settle(classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"), F.sum("rows").alias("all")))
    n = each.agg(F.sum("size"), F.sum("all")).first()
    of_unit = settle(met(classed.select("component", "unit", "rows"), each.drop("all"), "component", "size", n[0] or 0).select("unit", "component_id", "rows"))
    rows = met(seen.where("n > 0").select("doc_id", "n", "unit"), of_unit, "unit", "rows", n[1] or 0)
    alone = seen.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
