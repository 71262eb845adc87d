"""Column expressions that stay in Catalyst: guarded statistics, missing values, keys, hashes.

All statistics skip rows in which an input is null, as SQL aggregates do; what the
reference does differently is a parameter or a function of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: Fixed values of the rolling hash that seeds the samplers.
HASH_START, HASH_FACTOR, HASH_MODULUS = 104729, 31, 2147483646


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite_or_null(c: str | Column) -> Column:
    """NaN and both infinities become null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def is_finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe_mean(c: str | Column) -> Column:
    """Mean of the finite values; null if there are none."""
    return F.avg(finite_or_null(c))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over rows in which both are non-null; null if either doesn't vary (Spark's own raises)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(px), F.stddev_pop(py)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(px, py) / F.nullif(sx * sy, F.lit(0.0)))


def rmse(actual: str | Column, predicted: str | Column) -> Column:
    return F.sqrt(F.avg(F.pow(col(actual) - col(predicted), F.lit(2.0))))


def pooled_rmse(rmse_: str | Column, n: str | Column) -> Column:
    """Root of the squared group errors weighted by the groups' sizes."""
    return F.sqrt(F.try_divide(F.sum(col(n) * col(rmse_) * col(rmse_)), F.sum(col(n))))


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    x, w = col(x), col(w)
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def pooled_correlation(r: str | Column, n: str | Column) -> Column:
    """Inverse-variance mean of group correlations; |r| = 1 stays, its variance clamped at machine epsilon."""
    r, n = col(r), col(n)
    keep = is_finite(r) & (n > 2)
    v = F.greatest((1 - r * r) / F.nullif(n - 2, F.lit(0)).cast("double"), F.lit(EPSILON))
    return F.try_divide(F.sum(F.when(keep, r / v)), F.sum(F.when(keep, 1 / v)))


def pooled_correlation_strict(r: str | Column, n: str | Column) -> Column:
    """As above, but blocks with |r| >= 1 or fewer than three rows are left out."""
    r, n = col(r), col(n)
    keep = is_finite(r) & (n >= 3) & (F.abs(r) < 1)
    v = F.when(keep, (1 - r * r) / F.nullif(n - 2, F.lit(0)).cast("double"))
    return F.try_divide(F.sum(r / v), F.sum(1 / v))


def blocks_used(r: str | Column, n: str | Column) -> Column:
    r, n = col(r), col(n)
    return F.count_if(is_finite(r) & (n >= 3) & (F.abs(r) < 1))


def z_score(x: str | Column, mean: str | Column, sd: str | Column) -> Column:
    """Standardised; a spread of zero or null counts as 1, a non-finite result as 0."""
    scale = F.when(col(sd) > 0, col(sd)).otherwise(F.lit(1.0))
    return F.coalesce(finite_or_null((col(x) - col(mean)) / scale), F.lit(0.0))


def maternal_id(pedigree: str | Column) -> Column:
    """What stands before the first slash, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(col(pedigree), "/", 1)))


def composite_key(*parts: str | Column, sep: str = ".") -> Column:
    """Joined parts, in which a null shows as NA."""
    return F.concat_ws(sep, *(F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts))


def parse_flag(c: str | Column) -> Column:
    """true for TRUE, T, 1, YES, Y; false for FALSE, F, 0, NO, N; null for anything else."""
    token = F.upper(F.trim(col(c)))
    return F.when(token.isin("TRUE", "T", "1", "YES", "Y"), True).when(token.isin("FALSE", "F", "0", "NO", "N"), False)


def first_parsed(c: str | Column, formats: list[str]) -> Column:
    """The timestamp by the first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats))


def rolling_hash(key: str | Column) -> Column:
    """Polynomial hash of a key's characters, plus one: a seed that doesn't depend on partitioning."""
    codes = F.transform(F.split(col(key), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(HASH_START).cast("long"), lambda h, b: (h * HASH_FACTOR + b) % HASH_MODULUS) + 1


def hash_order(seed: int | str, *key: str | Column) -> Column:
    """Sort key of the deterministic draws: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in key)))


def softplus(x: str | Column) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def normal_log_density(y: str | Column, mu: str | Column, sigma: str | Column) -> Column:
    return -0.5 * F.log(F.lit(2.0) * F.pi()) - F.log(col(sigma)) - 0.5 * F.pow((col(y) - col(mu)) / col(sigma), F.lit(2.0))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Fractional days."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def growing_degrees(high: str | Column, low: str | Column, cap: float, base: float) -> Column:
    """Capped daily mean over a base, not below zero; null if either temperature is."""
    high, low = col(high), col(low)
    both = high.isNotNull() & low.isNotNull()
    return F.when(both, F.greatest((F.least(high, F.lit(cap)) + F.least(low, F.lit(cap))) / 2 - base, F.lit(0.0)))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two double arrays of one length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
