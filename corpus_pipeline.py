"""A corpus pipeline over the documents table, in stages that each write Parquet for the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame with the columns of docs, the last one with what the mix says of each
document besides. ``run`` applies them one after the other to the documents of a
folder. Null, empty and very long texts, null ids, ties, repeated rows, empty tables
and extra columns are dealt with as the stages' operators say.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontaminate, mixing, order_minhash, quality, toxicity
from furrow.llm.shared import free_name, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or short text goes, repeated rows share one verdict."""
    found = free_name(docs, "quality")
    return quality.assess(docs, out=found).where(F.col(f"{found}.kept")).select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under one half; learned from the labelled ones among docs.

    Where nothing can be learned, every document has the share of toxic labels as its score and stays while that is under one half.
    """
    score = free_name(docs, "toxicity_score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, one with its least doc_id; of repeated rows one, each null text with its own id stays."""
    return order_minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; a null or empty text isn't."""
    found = free_name(docs, "contamination")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=found)
    return judged.where(~F.col(f"{found}.contaminated")).select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once each and whole, with size, source_size, target, copies (how often it takes them) and taken.

    Columns of docs with these names are replaced.
    """
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("near-duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", to_target_weights),
]

#: The learned stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written to the shared folder and read again; a stage's rows go once the next ones are written."""
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
