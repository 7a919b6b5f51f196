"""Table operators beyond single built-ins: predicate composition, groups, top-k, sampling, reshaping, summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import in_bbox


def in_set(c: str, values: Iterable) -> Column:
    """Membership in which null is in no set (false, not null)."""
    return F.coalesce(F.col(c).isin(list(values)), F.lit(False))


def across(df: DataFrame, pattern: str, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` applied to every column whose name matches the regular expression."""
    return df.withColumns({c: f(F.col(c)) for c in df.columns if re.search(pattern, c)})


def check_bbox(bbox) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) if it is a box on the globe; ValueError says what is wrong."""
    if bbox is None or len(bbox) != 4:
        raise ValueError("a box has four numbers: xmin, ymin, xmax, ymax")
    xmin, ymin, xmax, ymax = map(float, bbox)
    if not (-180 <= xmin <= 180 and -180 <= xmax <= 180 and -90 <= ymin <= 90 and -90 <= ymax <= 90):
        raise ValueError("longitudes lie within 180 degrees, latitudes within 90")
    if xmin >= xmax or ymin >= ymax:
        raise ValueError("a box's lower bounds are below its upper bounds")
    return xmin, ymin, xmax, ymax


def one_of(value: str, allowed: Iterable[str], what: str = "value") -> str:
    if value not in (allowed := list(allowed)):
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def points_where(points: DataFrame, subid: int | None = None, movement: str | None = None, bbox=None) -> DataFrame:
    """Points of a subject, a movement state and a box; what is None doesn't filter. Nulls pass no given filter."""
    tests = []
    if subid is not None:
        tests.append(F.col("subid") == F.lit(subid))
    if movement is not None:
        tests.append(F.col("movement_state") == one_of(movement, ["stationary", "transition"], "movement"))
    if bbox is not None:
        tests.append(in_bbox("lon", "lat", *check_bbox(bbox)))
    return points.filter(reduce(lambda a, b: a & b, tests)) if tests else points


def in_largest_value(df: DataFrame, by: list[str], value: str, largest: bool = True) -> DataFrame:
    """Rows whose ``value`` is their group's largest (or smallest); all of equal ones. Null groups count as a group.

    The extreme is aggregated (partly before the shuffle) and joined back; no group is gathered.
    """
    top = df.groupBy(*by).agg((F.max if largest else F.min)(value).alias("__top"))
    return attach(df, top, by).filter(F.col(value) == F.col("__top")).drop("__top")


def attach(df: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of a table of its groups; null keys meet null keys."""
    renamed = per_group.withColumnsRenamed({k: f"__g_{k}" for k in by})
    on = reduce(lambda a, b: a & b, (df[k].eqNullSafe(renamed[f"__g_{k}"]) for k in by))
    return df.join(renamed, on, "left").drop(*(f"__g_{k}" for k in by))


def first_per_group(df: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """First ``k`` rows of each group in a total order; groups are cut to ``k`` rows before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by the hash of key and seed: the same rows whatever the partitions. Fewer if there are fewer."""
    return df.filter(F.col(key).isNotNull()).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def two_ends(df: DataFrame, value: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` highest and the ``k`` lowest rows by value (ties by key), labelled in column ``end``; nulls are in neither."""
    some = df.filter(F.col(value).isNotNull())
    high = some.orderBy(F.desc(value), key).limit(k).withColumn("end", F.lit("highest"))
    low = some.orderBy(F.asc(value), key).limit(k).withColumn("end", F.lit("lowest"))
    return high.unionByName(low)


def six_numbers(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """min, q25, median, mean, q75, max of the non-null values; quantiles interpolate linearly."""
    c = F.col(value)
    aggs = [F.min(c).alias("min"), F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.5)).alias("median"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.75)).alias("q75"), F.max(c).alias("max")]
    return df.groupBy(*by).agg(*aggs)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r): Pearson correlation of every pair of columns, over rows in which both are present; one pass."""
    pairs = [(x, y) for x in columns for y in columns]

    def r(x, y):
        # zeros stand for missing pairs only where both are taken out
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        return F.corr(F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double")))

    one = df.agg(*(r(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)))).alias("p")).select("p.x", "p.y", "p.r")


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds pct, the share in percent of each row in the total; the total is one row, sent to all tasks."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.lit(100.0) * F.col(n) / F.col("__total")).drop("__total")


def running_shares(counts: DataFrame, order: list, n: str = "n") -> DataFrame:
    """Adds pct and cum_pct over a total order. ``counts`` is an aggregate of few rows: the window is one task's."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return shares(counts, n).withColumn("cum_pct", F.sum("pct").over(w))


def exemplars(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Each group's first, middle and last row in an order, as pick 'min', 'median' (place n/2 rounded up) and 'max'."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    pick = F.explode(F.filter(F.array(F.when(F.col("__i") == 1, F.lit("min")), F.when(F.col("__i") == F.ceil(F.col("__n") / 2), F.lit("median")), F.when(F.col("__i") == F.col("__n"), F.lit("max"))), lambda x: x.isNotNull()))
    return ranked.withColumn("pick", pick).drop("__i", "__n")


def type_string(code: str, names: list[str]) -> T.StructType:
    """Schema of a compact type string, a letter a column: c text, d double, i integer, l logical, D date, T time, - left out."""
    kinds = {"c": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.BooleanType(), "D": T.DateType(), "T": T.TimestampNTZType(), "-": None}
    if len(code) != len(names):
        raise ValueError(f"{len(code)} types for {len(names)} columns")
    bad = set(code) - set(kinds)
    if bad:
        raise ValueError(f"unknown types: {', '.join(sorted(bad))}")
    return T.StructType([T.StructField(n, kinds[c]) for n, c in zip(names, code, strict=True) if kinds[c] is not None])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of checks that a row passes where they are true or null, as database constraints do."""
    one = df.agg(*(F.count_if(~rule).alias(f"v{i}") for i, rule in enumerate(rules.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"v{i}"), F.lit(0)).cast("long").alias("n_violations")) for i, name in enumerate(rules)))).alias("r")).select("r.*")


def glimpse(df: DataFrame) -> DataFrame:
    """(position, column_name, n_rows, n_missing) of every column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_missing")) for i, c in enumerate(df.columns)))).alias("r")).select("r.*")
