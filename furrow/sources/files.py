"""File sources and sinks beyond Spark's own readers: checked directories, formats by name, manifests, settings."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "NA"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local master may do without and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="furrow-")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder under the session's shared checkpoint folder; a temporary one only where that is unset. Removed at the end."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    try:
        yield folder
    finally:
        system.delete(path, True)


def landed(df: DataFrame) -> DataFrame:
    """df read now and kept in the shared folder, so that its files may go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header and NA for null. Spark's committer makes the result appear at once or not at all."""
    df.write.csv(path, header=True, nullValue=NULL, sep=sep)


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reads by the path's ending; the schema is given, never inferred."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, schema=schema, nullValue=NULL)
    if kind == "tsv":
        return spark.read.csv(path, header=True, schema=schema, nullValue=NULL, sep="\t")
    if kind in ("json", "jsonl"):
        return spark.read.json(path, schema=schema)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for .{kind}")


def read_directory(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, expected: int | None = None, least: int = 1) -> DataFrame:
    """All CSV files or folders that match, with the file's name in ``origin``; too few or unexpectedly many raise."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    n = len(found)
    if n < least or expected is not None and n != expected:
        raise FileNotFoundError(f"{n} files match {pattern}; wanted {expected if expected is not None else f'at least {least}'}")
    df = spark.read.csv([f.getPath().toString() for f in found], header=True, schema=schema, nullValue=NULL)
    return df.withColumn("origin", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(position, sample) from the header line, without a look at genotypes."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM"))
    parts = F.split("value", "\t")
    return header.select(F.posexplode(F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0)))).alias("position", "sample"))


def manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, md5, sha256) of whole files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def check_manifest(spark: SparkSession, stored: DataFrame, paths: Sequence[str]) -> DataFrame:
    """(path, status) of a stored manifest (path, size, sha256) against the files: ok, changed, missing, or unlisted."""
    now = manifest(spark, paths).select("path", F.struct("size", "sha256").alias("now"))
    met = stored.select("path", F.struct(F.col("size").cast("long").alias("size"), "sha256").alias("then")).join(now, "path", "full")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unlisted").when(F.col("now") == F.col("then"), "ok").otherwise("changed")
    return met.select("path", status.alias("status"))


def read_settings(spark: SparkSession, path: str, defaults: Mapping[str, str], prefix: str = "FURROW_") -> dict[str, str]:
    """Settings from a file of ``key: value`` lines (``#`` starts a comment) on any file system that Spark reads."""
    lines = (r[0].split("#", 1)[0] for r in spark.read.text(path).collect())
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return settings(defaults, {k.strip(): v.strip() for k, v in pairs}, prefix)


def read_definition(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row of the given schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that is there, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def settings(defaults: Mapping[str, str], overrides: Mapping[str, str], prefix: str = "FURROW_") -> dict[str, str]:
    """Defaults, then overrides, then environment variables; a key without a default raises."""
    unknown = set(overrides) - set(defaults)
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    return {k: os.environ.get(prefix + k.upper(), overrides.get(k, v)) for k, v in defaults.items()}
