"""Cross-validation designs: folds, roles under several schemes, masks, carves, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import hash_order
from furrow.operators.relational import present_everywhere
from furrow.operators.timeseries import folds

FIT, OBSERVE, PREDICT = "FIT", "OBSERVE", "PREDICT"


def entity_folds(df: DataFrame, entity: str, place: str, k: int, seed: int) -> DataFrame:
    """(entity, fold) for entities found in every place."""
    return folds(present_everywhere(df, entity, place), k, seed, entity)


def with_fold(df: DataFrame, entity_fold: DataFrame, entity: str) -> DataFrame:
    """fold of each row's entity, null for entities that have none."""
    return df.join(entity_fold, entity, "left")


def scheme_cv2_cv1(df: DataFrame, held: int) -> DataFrame:
    """Rows of the held fold are predicted (CV1); other common rows are fitted (CV2); the rest is only observed."""
    common = F.col("fold").isNotNull()
    role = F.when(F.col("fold") == held, PREDICT).when(common, FIT).otherwise(OBSERVE)
    return df.withColumns({"role": role, "cv_label": F.when(F.col("fold") == held, "CV1").when(common, "CV2")})


def scheme_cv0_cv00(df: DataFrame, place: str, out: str | int, held: int) -> DataFrame:
    """The place left out is predicted: CV00 for the held fold, CV0 for other common rows. Elsewhere the held fold is hidden too."""
    away, common, fold = F.col(place) == out, F.col("fold").isNotNull(), F.col("fold") == held
    role = F.when(away | fold, PREDICT).when(common, FIT).otherwise(OBSERVE)
    label = F.when(away & fold, "CV00").when(away & common, "CV0")
    return df.withColumns({"role": role, "cv_label": label})


def scheme_leave_one_out(df: DataFrame, key: str, out: str | int) -> DataFrame:
    away = F.col(key) == out
    return df.withColumns({"role": F.when(away, PREDICT).otherwise(FIT), "cv_label": F.when(away, "LOO")})


def scheme_random(df: DataFrame, row: str, k: int, seed: int, held: int) -> DataFrame:
    """Folds over rows."""
    return folds(df, k, seed, row).withColumn("role", F.when(F.col("fold") == held, PREDICT).otherwise(FIT))


def masked(df: DataFrame, response: str, hide: Column) -> DataFrame:
    """response becomes null where hide holds."""
    return df.withColumn(response, F.when(~F.coalesce(hide, F.lit(False)), F.col(response)))


def ratio_split(df: DataFrame, key: str, test: float, validation: float, seed: int) -> DataFrame:
    """split = test, val or train by a hash of the key; validation is a share of all rows."""
    u = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "val").otherwise("train"))


def carve(df: DataFrame, taken: DataFrame | None, group: str, n: int, seed: int) -> DataFrame:
    """Rows of n groups drawn by hash, out of those whose group isn't taken yet."""
    free = df if taken is None else df.join(taken.select(group).distinct(), group, "left_anti")
    chosen = free.select(group).distinct().orderBy(hash_order(seed, group), group).limit(n)
    return free.join(chosen, group, "left_semi")


def coverage_audit(expected: DataFrame, observed: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Each expected cell with its rows and the reasons why it isn't complete."""
    counted = observed.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("status") != "ok").alias("errors"))
    grid = expected.join(counted, list(keys), "left").fillna(0, ["rows", "errors"])
    reasons = F.concat_ws(
        "; ", F.when(F.col("rows") == 0, "missing"), F.when((F.col("rows") > 0) & (F.col("rows") < least), "short"), F.when(F.col("errors") > 0, "errors")
    )
    return grid.withColumn("reasons", reasons).withColumn("complete", F.col("reasons") == "")
