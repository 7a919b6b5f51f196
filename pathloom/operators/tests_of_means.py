"""t-tests on columns, with sums and moments on executors and the p-value of the one resulting row on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_two_sided

_RESULT = "n_x long, n_y long, mean_diff double, t double, df double, p double, label string"


def _row(df: DataFrame, n_x, n_y, diff, se, free) -> DataFrame:
    t = diff / se if diff is not None and se else None
    p = t_two_sided(t, free)
    label = None if p is None else "significant at .05" if p < 0.05 else "not significant"
    return df.sparkSession.createDataFrame([(n_x, n_y, diff, t, None if t is None else float(free), p, label)], _RESULT)


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    """Paired t-test of two columns over rows in which both are present. No t with fewer than two rows or equal differences."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    return _row(df, r["n"], r["n"], r["m"], r["s"] / r["n"] ** 0.5 if r["s"] else None, r["n"] - 1)


def welch_t(df: DataFrame, value: str, first) -> DataFrame:
    """Two-sample t-test with unequal variances of ``value`` where the condition ``first`` holds against where it doesn't."""
    v = F.col(value).cast("double")
    part = lambda c, n: (F.count(F.when(c, v)).alias(f"n{n}"), F.avg(F.when(c, v)).alias(f"m{n}"), F.var_samp(F.when(c, v)).alias(f"v{n}"))
    r = df.agg(*part(first, 1), *part(~first, 2)).first()
    if r["v1"] is None or r["v2"] is None or not r["v1"] + r["v2"]:
        return _row(df, r["n1"], r["n2"], None if None in (r["m1"], r["m2"]) else r["m1"] - r["m2"], None, None)
    a, b = r["v1"] / r["n1"], r["v2"] / r["n2"]
    return _row(df, r["n1"], r["n2"], r["m1"] - r["m2"], (a + b) ** 0.5, (a + b) ** 2 / (a * a / (r["n1"] - 1) + b * b / (r["n2"] - 1)))
