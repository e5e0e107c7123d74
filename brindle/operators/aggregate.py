"""Grouped and global aggregates. Each is one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import is_numeric

MONEY = "decimal(28,6)"


def exact_sum(x: Column) -> Column:
    """The same for any order of the rows: summed as decimals, given as double."""
    return F.sum(x.cast(MONEY)).cast("double")


def exact_average(x: Column) -> Column:
    return F.try_divide(exact_sum(x), F.count(x.cast(MONEY)).cast("double"))


def strict_number(df: DataFrame, field: str) -> Column:
    """DISTILL: numbers only; text and booleans do not count."""
    kind = dict(df.dtypes).get(field)
    return F.col(field) if is_numeric(kind) else F.lit(None).cast("double")


def loose_number(df: DataFrame, field: str) -> Column:
    """PIPE: numeric text and booleans count too."""
    kind = dict(df.dtypes).get(field)
    if kind is None:
        return F.lit(None).cast("double")
    if kind == "boolean":
        return F.col(field).cast("double")
    return F.col(field) if is_numeric(kind) else F.expr(f"try_cast(`{field}` AS double)")


def distill_call(df: DataFrame, fn: str, field: str | None) -> Column:
    fn = fn.upper()
    if fn in ("COUNT", "TALLY"):
        return F.count(F.lit(1) if field in (None, "*") else F.col(field))
    x = strict_number(df, field)
    return {"SUM": exact_sum(x), "TOTAL": exact_sum(x), "AVERAGE": exact_average(x), "AVG": exact_average(x), "MIN": F.min(x), "MAX": F.max(x), "SPREAD": F.max(x) - F.min(x)}[fn]


def distill(df: DataFrame, calls: list[tuple[str, str | None, str | None]], by: str | None = None) -> DataFrame:
    """calls: (function, field, name). An empty input gives no row at all."""
    named = {name or fn.lower(): distill_call(df, fn, field) for fn, field, name in calls}
    columns = [c.alias(n) for n, c in named.items()]
    if by:
        return df.groupBy(by).agg(*columns)
    return df.agg(F.count(F.lit(1)).alias("_rows"), *columns).where("_rows > 0").drop("_rows")


def pipe_call(df: DataFrame, fn: str, field: str | None) -> Column:
    fn = fn.upper()
    if fn in ("TALLY", "COUNT") and field is None:
        return F.count(F.lit(1))
    x = loose_number(df, field)
    if fn == "SPREAD":  # here: sample standard deviation, 0 for a single value
        return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(F.when(F.lit(True), x)), F.lit(0.0)))
    return {"COUNT": F.count(x), "TALLY": F.count(x), "SUM": exact_sum(x), "TOTAL": exact_sum(x), "AVERAGE": exact_average(x), "AVG": exact_average(x), "MIN": F.min(x), "MAX": F.max(x)}[fn]


def pipe_group(df: DataFrame, by: str, calls: list[tuple[str, str | None, str]]) -> DataFrame:
    if not calls:
        return df.select(by).distinct()
    return df.groupBy(by).agg(*[pipe_call(df, fn, field).alias(name) for fn, field, name in calls])


def total_grouped(df: DataFrame, field: str, by: str | None) -> DataFrame:
    """A missing group is "unknown", a missing value 0."""
    x = F.coalesce(loose_number(df, field), F.lit(0))
    if by is None:
        return df.agg(exact_sum(x).alias("total"))
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)).agg(exact_sum(x).alias("total"))


def grouped_sum_view(df: DataFrame, by: str, field: str) -> DataFrame:
    """The first filling of a continuous view: null groups and non-numbers do not count."""
    x = loose_number(df, field)
    return df.where(F.col(by).isNotNull() & x.isNotNull()).groupBy(F.col(by).cast("string").alias("_group")).agg(exact_sum(x).alias(field))


def approximate_distinct(df: DataFrame, field: str) -> DataFrame:
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(field, F.lit(12))).alias("estimate"))


def histogram(df: DataFrame, field: str, buckets: int = 10, spread: int = 256) -> DataFrame:
    """Equi-depth boundaries: the value at place i*n/buckets in rising order.

    Places are found without one task sorting everything: values are counted,
    and only the counted distinct ranges (at most ``spread``) are summed up.
    """
    x = df.where(F.col(field).isNotNull()).select(F.col(field).cast("double").alias("x"))
    n = x.count()
    if not n:
        return x.sparkSession.createDataFrame([], "bucket int, boundary double")
    cuts = x.stat.approxQuantile("x", [i / spread for i in range(1, spread)], 0.001)
    cuts = sorted(set(cuts))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("x") > c).cast("int")
    x = x.withColumn("part", part)
    sizes = x.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = x.join(F.broadcast(offsets), "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1 + F.col("before"))
    places = {min(n - 1, i * n // buckets): i for i in range(buckets)} | {n - 1: buckets}
    number = F.create_map(*[F.lit(v) for k, i in places.items() for v in (k, i)])
    return ranked.where(F.col("place").isin(list(places))).select(number[F.col("place").cast("int")].alias("bucket"), F.col("x").alias("boundary"))


def range_selectivity(boundaries: DataFrame, low: float, high: float) -> DataFrame:
    """Share of rows in [low, high] by interpolation inside each bucket."""
    w = Window.orderBy("bucket")
    spans = boundaries.select("bucket", "boundary", F.lead("boundary").over(w).alias("upper")).where("upper is not null")
    width = F.col("upper") - F.col("boundary")
    inside = F.greatest(F.lit(0.0), F.least(F.col("upper"), F.lit(float(high))) - F.greatest(F.col("boundary"), F.lit(float(low))))
    share = F.when(width > 0, inside / width).otherwise(F.col("boundary").between(low, high).cast("double"))
    return spans.agg((F.sum(share) / F.count(F.lit(1))).alias("selectivity"))


def percentile_report(df: DataFrame, value: str, order: str, last: int = 1000) -> DataFrame:
    """Mean and nearest-rank p95 and p99 of the last rows."""
    recent = df.orderBy(F.desc(order)).limit(last)
    return recent.agg(F.count(F.lit(1)).alias("n"), F.round(exact_average(F.col(value)), 6).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY `{value}`)").alias("p99"))


def field_usage(uses: DataFrame, field: str = "field", threshold: int = 10) -> DataFrame:
    """Fields used at least ``threshold`` times, with a priority for an index."""
    n = uses.groupBy(field).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= threshold)
    return n.withColumn("priority", F.when(F.col("uses") >= 3 * threshold, "high").when(F.col("uses") >= 1.5 * threshold, "medium").otherwise("low"))
