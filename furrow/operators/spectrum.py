"""Leading eigenpairs of the linear kernel of wide features, by a randomised block Krylov range finder.

The kernel of n rows with p features is K = X X' / p, by default with each feature's mean
taken off, which is the double-centred kernel. Neither K nor the features' p x p matrix
is made. X is cut into tiles of about ROWS rows by COLUMNS features; a random start block X R is
multiplied by K again and again, each time through X' and X, tile by tile, with
products summed in a tree. What comes out is made orthogonal to the blocks before it, and the
eigenproblem of K within their span (some hundred columns) is solved on the driver. The
part of the last product outside that span gives each pair's residual |K v - value v|,
which bounds the distance to a true eigenvalue; the search ends once all wanted ones are
under the tolerance, or the span has the kernel's whole rank.

To the driver come matrices of (columns of the span) x (columns of a block); whatever has n
rows or p rows stays in blocks. A factor is broadcast to the tiles only if its bytes, known from
its shape, are few.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and features of a tile (1 MB of doubles), on average.
ROWS, COLUMNS = 256, 512
#: Where the rank can't be larger than this, the first block spans all, and one round does.
NARROW = 128
#: Blocks that are summed in one group.
FAN_IN = 64
#: A factor of at most so many bytes is broadcast.
BROADCAST_BYTES = 8 << 20


def settle(df: DataFrame) -> DataFrame:
    """Writes df once to the folder that the session names in spark.checkpoint.dir; a temporary one only on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="furrow-"))
    return df.checkpoint()


def _widths(features: int) -> Callable[[int], int]:
    """The number of features of each block of them."""
    return lambda c: min(COLUMNS, features - c * COLUMNS)


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width) if width else np.empty((0, 0))


def _each(df: DataFrame, of: Callable[[dict], dict], schema: str) -> DataFrame:
    """One row out for each row in, in whatever batches they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = of({name: batch.column(name)[k].as_py() for name in batch.schema.names})
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()})

    return df.mapInArrow(run, schema)


def _summed(parts: DataFrame, key: str, number: int) -> DataFrame:
    """(key, s): the sums of blocks (key, part, s) with parts from 0 to number - 1, FAN_IN at a time."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(s) for s in group["s"].iloc[1:]), np.frombuffer(group["s"].iloc[0]))
        return group[[key, "part"]].iloc[:1].assign(s=np.ascontiguousarray(total).tobytes())

    while True:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}"))
        parts = parts.groupBy(key, "part").applyInPandas(add, f"{key} long, part long, s binary")
        number = -(-number // FAN_IN)
        if number <= 1:
            return parts.drop("part")


@dataclass(frozen=True)
class Tiles:
    """Rows with features as tiles (r, c, x): block of rows, block of features, doubles; ids (r, ids) name each block's rows."""

    table: DataFrame
    ids: DataFrame
    rows: int
    features: int

    @property
    def row_blocks(self) -> int:
        return max(1, -(-self.rows // ROWS))

    @property
    def column_blocks(self) -> int:
        return max(1, -(-self.features // COLUMNS))

    def _product(self, factor: DataFrame, by: str, to: str, parts: int, columns: int, size: int, turned: bool) -> DataFrame:
        width = _widths(self.features)

        def times(row: dict) -> dict:
            x, f = _numbers(row["x"], width(row["c"])), _numbers(row["f"], columns)
            return {to: row[to], "part": row[by], "s": np.ascontiguousarray((x.T if turned else x) @ f).tobytes()}

        small = size * columns * 8 <= BROADCAST_BYTES
        met = self.table.join(F.broadcast(factor) if small else factor, by)
        return _summed(_each(met, times, f"{to} long, part long, s binary"), to, parts)

    def times(self, factor: DataFrame, columns: int) -> DataFrame:
        """(r, s): X F for F in blocks of features (c, f) with so many columns."""
        return self._product(factor, "c", "r", self.column_blocks, columns, self.features, False)

    def turned_times(self, factor: DataFrame, columns: int) -> DataFrame:
        """(c, s): X' F for F in blocks of rows (r, f)."""
        return self._product(factor, "r", "c", self.row_blocks, columns, self.rows, True)

    def means(self) -> DataFrame:
        """(c, m): each feature's mean over all rows."""
        width, n = _widths(self.features), self.rows
        sums = _each(self.table, lambda t: {"c": t["c"], "part": t["r"], "s": (_numbers(t["x"], width(t["c"])).sum(0) / n).tobytes()}, "c long, part long, s binary")
        return settle(_summed(sums, "c", self.row_blocks).withColumnRenamed("s", "m"))

    def less(self, means: DataFrame) -> Tiles:
        width = _widths(self.features)

        def off(t: dict) -> dict:
            x = _numbers(t["x"], width(t["c"])) - np.frombuffer(t["m"])
            return {"r": t["r"], "c": t["c"], "x": x.tobytes()}

        small = self.features * 8 <= BROADCAST_BYTES
        met = self.table.join(F.broadcast(means) if small else means, "c")
        return Tiles(settle(_each(met, off, "r long, c long, x binary")), self.ids, self.rows, self.features)


def tiles(df: DataFrame, entity: str, features: str, width: int | None = None) -> Tiles:
    """The rows of df with an id and all features (as many as the longest array, or width); others are left out."""
    of = df.schema[entity].dataType.simpleString()
    rows = df.select(F.col(entity).alias("e"), F.transform(features, lambda v: v.cast("double")).alias("x")).where("e IS NOT NULL AND x IS NOT NULL")
    if width is None:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    n = rows.count()
    made = Tiles(rows, rows, n, width)
    last = F.lit(made.column_blocks - 1).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: F.struct(c.alias("c"), F.slice("x", (c * COLUMNS + 1).cast("int"), COLUMNS).alias("x")))
    # Rows of equal ids are told apart by their features; where those are equal too, either may come first.
    each = rows.select(F.pmod(F.xxhash64("e"), F.lit(made.row_blocks)).alias("r"), "e", F.xxhash64("x").alias("h"), F.explode(cut).alias("t")).select("r", "t.c", "e", "h", "t.x")

    def tile(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by([("e", "ascending"), ("h", "ascending")])
        x = block["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        c = block["c"][0].as_py()
        ids = block["e"].to_pylist() if c == 0 else None
        return pa.table({"r": block["r"][:1], "c": pa.array([c], pa.int64()), "ids": pa.array([ids], pa.list_(block["e"].type)), "x": pa.array([x.tobytes()], pa.binary())})

    found = settle(each.groupBy("r", "c").applyInArrow(tile, f"r long, c long, ids array<{of}>, x binary"))
    return Tiles(found.drop("ids"), found.where("c = 0").select("r", "ids"), n, width)


@dataclass(frozen=True)
class Spectrum:
    """Eigenpairs, largest first. whole: the search ran out of directions, so these are all that aren't noise."""

    values: np.ndarray
    #: |K v - value v| of each pair.
    residuals: np.ndarray
    whole: bool
    #: (r, f): the eigenvectors in blocks of rows.
    vectors: DataFrame
    tiles: Tiles
    means: DataFrame | None
    entity: str

    def _named(self, blocks: DataFrame, ids: DataFrame, scale: np.ndarray) -> DataFrame:
        of, width = ids.schema["ids"].dataType.elementType, len(scale)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    names = batch.column("ids").slice(k, 1).flatten()
                    z = np.frombuffer(batch.column("f")[k].as_py()).reshape(len(names), width) * scale
                    yield pa.RecordBatch.from_arrays([names, pa.array(list(z), pa.list_(pa.float64()))], names=["e", "z"])

        return ids.join(blocks, "r").select("ids", "f").mapInArrow(rows, f"e {of.simpleString()}, z array<double>").withColumnRenamed("e", self.entity)

    def train(self) -> DataFrame:
        """(entity, z): V sqrt(D) of the rows that the kernel was made of."""
        return self._named(self.vectors, self.tiles.ids, np.sqrt(self.values))

    def project(self, df: DataFrame, features: str) -> DataFrame:
        """(entity, z): K(new, train) V / sqrt(D) of other rows, centred by the train rows' means.

        By way of X' V, which has a row for each feature; the kernel between new and
        train rows isn't made. Rows with a null id, or without all features, are left out.
        """
        k = len(self.values)
        new = tiles(df, self.entity, features, self.tiles.features)
        if self.means is not None:
            new = new.less(self.means)
        loads = settle(self.tiles.turned_times(self.vectors, k).withColumnRenamed("s", "f"))
        return self._named(new.times(loads, k).withColumnRenamed("s", "f"), new.ids, 1 / (np.sqrt(self.values) * max(self.tiles.features, 1)))


def _gram(blocks: DataFrame, m: int, columns: int, number: int) -> np.ndarray:
    """[Q W]' W over so many blocks (r, q, w) of m and so many columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((m + columns, columns)), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            for q, w in zip(batch.column("q").to_pylist(), batch.column("w").to_pylist(), strict=True):
                w = _numbers(w, columns)
                total[m:] += w.T @ w
                if m:
                    total[:m] += _numbers(q, m).T @ w
        if seen:
            yield pa.RecordBatch.from_pydict({"key": [0], "part": [0], "s": [total.tobytes()]})

    sums = blocks.select("q", "w").mapInArrow(partial, "key long, part long, s binary").withColumn("part", F.pmod(F.spark_partition_id().cast("long"), F.lit(number)))
    return _numbers(_summed(sums, "key", number).first()["s"], columns).copy()


def _moved(blocks: DataFrame, m: int, columns: int, a: np.ndarray, turn: np.ndarray) -> DataFrame:
    """w becomes (W - Q a) turn."""

    def of(row: dict) -> dict:
        w = _numbers(row["w"], columns)
        w = (w - _numbers(row["q"], m) @ a if m else w) @ turn
        return {"r": row["r"], "q": row["q"], "w": np.ascontiguousarray(w).tobytes()}

    return settle(_each(blocks, of, "r long, q binary, w binary"))


def spectrum(
    df: DataFrame, entity: str, features: str, components: int | None = None, most: int | None = None,
    centred: bool = True, relative: float = 1e-10, tolerance: float = 1e-9, rounds: int = 40, extra: int = 10, seed: int = 11,
) -> Spectrum:
    """The largest eigenvalues of the linear kernel and their vectors: exactly ``components``, or ``most`` at most.

    Values of at most ``relative`` times the largest are noise and left out. Fewer than components
    raises; fewer than most is fine. Ends when all residuals are under tolerance times the
    largest value, the rank is exhausted, or after so many rounds of ``most + extra``
    columns; what was reached is in ``residuals``. Signs are as they come. Rows with a null id, a null
    array, a null or NaN in it or less than all features are left out; rows with equal ids
    count each. Without rows or without variation there are no values.
    """
    if (components is None) == (most is None):
        raise ValueError("give either components or most")
    wanted = components if components is not None else most
    made = tiles(df, entity, features)
    means = made.means() if centred and made.rows else None
    x = made.less(means) if means is not None else made
    columns, p, width = wanted + extra, max(made.features, 1), _widths(made.features)
    rank = min(made.rows, made.features)
    if rank <= NARROW:
        columns = max(columns, rank + extra)

    def start(row: dict) -> dict:
        return {"c": row["c"], "f": np.random.default_rng([seed, row["c"]]).standard_normal((width(row["c"]), columns)).tobytes()}

    spark = df.sparkSession
    random = _each(spark.range(made.column_blocks).select(F.col("id").alias("c")), start, "c long, f binary")
    blocks = settle(x.times(random, columns).select("r", F.lit(b"").alias("q"), F.col("s").alias("w")))
    m, h, values, vectors, residuals, whole = 0, np.zeros((0, 0)), np.empty(0), np.empty((0, 0)), np.empty(0), made.rows == 0
    for k in range(rounds + 1 if made.rows else 0):
        # Three times: off the span; off it and to unit length; once more, against rounding.
        for turn in range(3):
            s = _gram(blocks, m, columns, made.row_blocks)
            a, left = s[:m], s[m:] - s[:m].T @ s[:m]
            along = np.eye(columns)
            if turn == 0 and m:
                # a is Q' K (last block): the last columns of the kernel within the span.
                h = np.block([[h, np.zeros((len(h), columns))], [np.zeros((columns, m))]]) if len(h) < m else h
                h[:, m - columns :], h[m - columns :, :] = a, a.T
                values, vectors = np.linalg.eigh(h)
                values, vectors = values[::-1], vectors[:, ::-1]
            if turn == 1:
                out = vectors[m - columns :] if m else np.zeros((columns, 0))
                residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", out, left, out), 0))
                top = values[0] if m else 0.0
                if m and (residuals[:wanted] <= tolerance * top).all() and m >= wanted:
                    break
            if turn:
                spread, axes = np.linalg.eigh(left)
                keep = spread > max(1e-13 * spread.max(), (1e-12 * (values[0] if m else 0.0)) ** 2)
                along = axes[:, keep] / np.sqrt(spread[keep])
                if not keep.any():
                    whole = True
                    break
            blocks = _moved(blocks, m, columns, a, along)
            columns = along.shape[1]
        if whole or turn == 1 or k == rounds:
            break
        factor = blocks.select("r", F.col("w").alias("f"))
        through = settle(x.turned_times(factor, columns).withColumnRenamed("s", "f"))
        span = blocks.select("r", "q", F.col("w").alias("new"))
        old, added = m, columns

        def grown(row: dict, old: int = old, added: int = added) -> dict:
            new = _numbers(row["new"], added)
            q = np.hstack([_numbers(row["q"], old), new]) if old else new
            return {"r": row["r"], "q": np.ascontiguousarray(q).tobytes(), "w": (np.frombuffer(row["s"]) / p).tobytes()}

        blocks = settle(_each(span.join(x.times(through, columns), "r"), grown, "r long, q binary, w binary"))
        m += columns
    found = values > relative * max(values[0], 0.0) if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    whole = whole and int(found.sum()) <= wanted
    if components is not None and found.sum() < components:
        raise ValueError(f"{components} components wanted, the kernel has {int(found.sum())}")
    take = np.flatnonzero(found)[:wanted]
    turn_, span_width = (vectors[:, take] if m else np.empty((0, 0))), m
    final = _each(
        blocks.select("r", "q"), lambda row: {"r": row["r"], "f": np.ascontiguousarray(_numbers(row["q"], span_width) @ turn_).tobytes() if len(take) else b""}, "r long, f binary"
    )
    return Spectrum(values[take], residuals[take] if len(residuals) else np.zeros(len(take)), whole, settle(final), x, means, entity)
