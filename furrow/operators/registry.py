"""Named operators: processors applied in order, registries of functions, gates over settings, column selectors."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import correlation, finite_or_null, normal_log_density, rmse, z_score
from furrow.operators import models, splits, timeseries

PROCESSORS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def processor(name: str, priority: int):
    """Registers a DataFrame function; lower priorities are applied first."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in PROCESSORS:
            raise ValueError(f"{name} is registered already")
        PROCESSORS[name] = (priority, f)
        return f

    return register


@processor("finite_values", 0)
def finite_values(df: DataFrame) -> DataFrame:
    return df.withColumn("value", finite_or_null("value"))


@processor("group_scores", 1)
def group_scores(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id")
    return df.withColumn("score", z_score("value", F.avg("value").over(w), F.stddev_samp("value").over(w)))


def apply_processors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    unknown = set(names) - set(PROCESSORS)
    if unknown:
        raise KeyError(f"unknown processors: {sorted(unknown)}")
    for name in sorted(names, key=lambda n: PROCESSORS[n][0]):
        df = PROCESSORS[name][1](df)
    return df


def _log_density(actual: str, predicted: str) -> Column:
    return F.avg(normal_log_density(actual, predicted, F.lit(1.0)))


#: Every name stands for the function that does it. Metrics are aggregates of (actual, predicted).
REGISTRIES: dict[str, dict[str, Callable]] = {
    "processors": {name: f for name, (_, f) in PROCESSORS.items()},
    "metrics": {"rmse": rmse, "pearson": correlation, "bias": lambda a, p: F.avg(F.col(p) - F.col(a)), "log_density": _log_density},
    "regressors": {"gp": models.gp_predictions, "gibbs": models.gibbs_predictions, "blup": models.blup_predictions},
    "schemes": {"cv_2_1": splits.scheme_cv2_cv1, "cv_0_00": splits.scheme_cv0_cv00, "leave_one_out": splits.scheme_leave_one_out, "random": splits.scheme_random},
    "carves": {"grouped": splits.carve, "ratio": splits.ratio_split},
    "axes": {"identity": lambda df, *_: df, "dedup": timeseries.collapse_axis},
    "scalers": {"none": lambda x, *_: F.col(x), "global": z_score},
}
#: Streams that each scheme can serve.
STREAMS = {"cv_2_1": {"CV1", "CV2"}, "cv_0_00": {"CV0", "CV00"}, "leave_one_out": {"LOO"}, "random": {"random"}}


def find(kind: str, name: str) -> Callable:
    """The registered function; an unknown kind or name raises and says what there is."""
    if name not in REGISTRIES.get(kind, {}):
        raise KeyError(f"no {name} among {kind}: {', '.join(REGISTRIES.get(kind, REGISTRIES))}")
    return REGISTRIES[kind][name]


def problem(config: Mapping) -> str | None:
    """What is wrong with an experiment's settings, in the order in which it is looked for: scheme, streams, monitor, metrics."""
    scheme, streams = config.get("scheme"), config.get("streams") or []
    if scheme not in REGISTRIES["schemes"]:
        return f"unknown scheme {scheme}"
    unfit = sorted({s["name"] for s in streams} - STREAMS[scheme])
    if unfit:
        return f"{scheme} has no stream {', '.join(unfit)}"
    monitors = sum(bool(s.get("monitor")) for s in streams)
    if monitors != 1:
        return f"{monitors} monitors; wanted 1"
    unknown = sorted(set(config.get("metrics") or []) - set(REGISTRIES["metrics"]))
    return f"unknown metrics {', '.join(unknown)}" if unknown else None


def gate(config: Mapping) -> Mapping:
    """The settings, or a ValueError that says what is wrong with them."""
    wrong = problem(config)
    if wrong:
        raise ValueError(wrong)
    return config


def resolve_channels(selectors: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns by name, pattern, ``kind:name`` or ``-name`` to leave one out; an unknown selector raises."""
    chosen: list[str] = []
    for s in selectors:
        out, pattern = s.startswith("-"), s.removeprefix("-").split(":", 1)[-1]
        hits = [c for c in columns if fnmatch.fnmatch(c, pattern)]
        if not hits:
            raise KeyError(f"no column for selector {s}")
        chosen = [c for c in chosen if c not in hits] if out else chosen + [c for c in hits if c not in chosen]
    return chosen


def match_columns(wanted: Sequence[tuple[str, str]], columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns that match each expected token, without regard to case: exact, or by prefix."""
    fits = {"exact": str.__eq__, "prefix": str.startswith}
    return {w: [c for c in columns if fits[how](c.lower(), w.lower())] for w, how in wanted}
