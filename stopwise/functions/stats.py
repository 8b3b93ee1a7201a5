"""Scalar statistics as Column expressions, plus the two small-group aggregates built on them.

Undefined results are NULL. Log-odds of 0 and 1 are -inf and +inf on purpose: a boundary prior
stays visible in every table and is excluded only where a rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den, NULL when either is NULL or den is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def wilson(k, n, z: float = fixed.WILSON_Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clipped to [0, 1]; NULL when n is 0."""
    n_, p = _c(n).cast("double"), ratio(k, n)
    z2 = F.lit(z * z)
    scale = F.lit(1.0) + F.try_divide(z2, n_)
    mid = F.try_divide(p + F.try_divide(z2, F.lit(2.0) * n_), scale)
    inner = F.try_divide(p * (F.lit(1.0) - p), n_) + F.try_divide(z2, F.lit(4.0) * n_ * n_)
    half = F.try_divide(F.lit(z) * F.sqrt(inner), scale)
    one, zero = F.lit(1.0), F.lit(0.0)
    low = F.when(mid.isNotNull(), F.greatest(zero, mid - half))
    high = F.when(mid.isNotNull(), F.least(one, mid + half))
    return low, high


def logit(p, eps: float = fixed.LOGIT_EPS) -> Column:
    c = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(c / (F.lit(1.0) - c))


def sigmoid(z) -> Column:
    z = _c(z)
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(
        F.exp(z) / (F.lit(1.0) + F.exp(z))
    )


def log_odds(p) -> Column:
    p = _c(p)
    return (
        F.when(p <= 0.0, F.lit(-INF))
        .when(p >= 1.0, F.lit(INF))
        .otherwise(F.ln(F.try_divide(p, F.lit(1.0) - p)))
    )


def prior_log_ratio(target, train) -> Column:
    return log_odds(target) - log_odds(train)


def prior_degenerate(target, train) -> Column:
    t, r = _c(target), _c(train)
    return t.isin(0.0, 1.0) | r.isin(0.0, 1.0)


def shift_score(p, head, log_r) -> Column:
    """Remove a label-prior shift: the failure head moves by exactly the opposite amount."""
    sign = F.when(_c(head) == "success", F.lit(1.0)).otherwise(F.lit(-1.0))
    return sigmoid(logit(p) + sign * _c(log_r))


def sign_name(x) -> Column:
    x = _c(x)
    return F.when(x > 0, "positive").when(x < 0, "negative").when(x == 0, "zero")


def ci_includes_zero(lo, hi) -> Column:
    return (_c(lo) <= 0) & (_c(hi) >= 0)


def robust(gap, lo, hi, minimum: float = fixed.ROBUST_GAP) -> Column:
    """|gap| large enough and the interval strictly on the gap's side of zero."""
    g, lo, hi = _c(gap), _c(lo), _c(hi)
    one_sided = ((lo > 0) & (g > 0)) | ((hi < 0) & (g < 0))
    return F.coalesce((F.abs(g) >= minimum) & one_sided, F.lit(False))


def interval(value: str) -> list[Column]:
    """Aggregates of the percentile interval over replicates; NULL and NaN are left out."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return [
        F.count(v).alias("n_valid"),
        q[0].alias("ci_lower"),
        q[1].alias("ci_median"),
        q[2].alias("ci_upper"),
    ]


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    group = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(group.orderBy(value)) + (ties - 1) / F.lit(2.0)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Rank correlation per group; groups are one row per model or fold, never raw rows.

    Values are rounded to 12 digits first so that ties do not depend on summation order.
    """
    used = (
        df.select(*keys, F.round(x, 12).alias("_x"), F.round(y, 12).alias("_y"))
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        .where(~F.isnan("_x") & ~F.isnan("_y"))
        .select(*keys, average_rank("_x", keys).alias("_rx"), average_rank("_y", keys).alias("_ry"))
    )
    n = F.count(F.lit(1)).cast("double")
    sx, sy = F.sum("_rx"), F.sum("_ry")
    cov = n * F.sum(F.col("_rx") * F.col("_ry")) - sx * sy
    var = (n * F.sum(F.col("_rx") * F.col("_rx")) - sx * sx) * (
        n * F.sum(F.col("_ry") * F.col("_ry")) - sy * sy
    )
    return used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.try_divide(cov, F.sqrt(var)).alias(name)
    )


def median_or_null(x) -> Column:
    return F.median(_c(x))


def fraction_bin(step, total) -> Column:
    """Index 0..3 of the decision-fraction bin, closed at 1."""
    f = ratio(step, total)
    return F.when(f.isNotNull(), F.least(F.floor(f * 4), F.lit(3))).cast("int")


def bin_label(index) -> Column:
    labels = F.array(*[F.lit(b) for b in fixed.FRACTION_BINS])
    return F.get(labels, _c(index))
