"""Forecasts and time travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"DAY": 86400, "DAYS": 86400, "HOUR": 3600, "HOURS": 3600, "MINUTE": 60, "MINUTES": 60, "MIN": 60}


def points(df: DataFrame, value: str, over: str) -> DataFrame:
    """(t in epoch seconds, y) where both are there."""
    kind = dict(df.dtypes)[over]
    t = F.col(over).cast("double") if kind in ("int", "bigint", "double", "float") else F.unix_timestamp(F.col(over).cast("timestamp")).cast("double")
    return df.select(t.alias("t"), F.col(value).cast("double").alias("y")).where("t is not null and y is not null")


def forecast(df: DataFrame, value: str, over: str, horizon: int, unit: str = "DAY", method: str = "LINEAR", window: int = 3) -> DataFrame:
    """(step, t, predicted), by least squares, moving average or exponential smoothing (0.5)."""
    if not 1 <= horizon <= 10_000:
        raise ValueError("a horizon is 1 to 10000 steps")
    step, p = STEPS.get(unit.upper(), 1), points(df, value, over)
    if method == "LINEAR":
        return _linear(p, horizon, step)
    if method == "MOVING_AVERAGE":
        return _moving(p, horizon, step, window)
    return _exponential(p, horizon, step)


def _linear(p: DataFrame, horizon: int, step: int) -> DataFrame:
    """Times are centred first: raw epochs lose precision when squared."""
    ends = p.agg(F.max("t").alias("last"), F.min("t").alias("first"))
    fit = p.crossJoin(F.broadcast(ends)).select((F.col("t") - F.col("first")).alias("x"), "y", "last", "first")  # ends is one row
    fit = fit.groupBy("last", "first").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    t = F.col("last") + F.col("step") * step
    return ahead.select("step", t.cast("long").alias("t"), F.round(F.col("base") + F.col("slope") * (t - F.col("first")), 4).alias("predicted"), F.round(F.coalesce("r2", F.lit(1.0)), 4).alias("r2"))


def _moving(p: DataFrame, horizon: int, step: int, window: int) -> DataFrame:
    """Predictions are fed back: the state is the last ``window`` values and what was predicted."""
    last = p.orderBy(F.desc("t"), F.desc("y")).limit(window)
    seed = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("w"), F.max("t").alias("last")).where("last is not null")
    tail = lambda a: F.slice(a, F.greatest(F.size(a) - (window - 1), F.lit(1)), F.lit(window))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("w"), lambda a, _: F.concat(a, F.array(mean(tail(a)))))
    out = seed.select("last", F.posexplode(F.slice(grown, F.size("w") + 1, F.lit(horizon))).alias("i", "predicted"))
    return out.select((F.col("i") + 1).alias("step"), (F.col("last") + (F.col("i") + 1) * step).cast("long").alias("t"), F.round("predicted", 4).alias("predicted"))


def _exponential(p: DataFrame, horizon: int, step: int, alpha: float = 0.5) -> DataFrame:
    """Flat forecast. Weights halve with age, so the last 64 points decide to double precision, and the oldest of them takes the rest."""
    ranked = p.orderBy(F.desc("t"), F.desc("y")).limit(64)
    line = ranked.agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s"), F.max("t").alias("last")).where("last is not null")
    smooth = F.aggregate(F.slice("s", F.lit(2), F.lit(64)), F.col("s")[0]["y"], lambda a, x: alpha * x["y"] + (1 - alpha) * a)
    out = line.select("last", smooth.alias("predicted"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select("step", (F.col("last") + F.col("step") * step).cast("long").alias("t"), F.round("predicted", 4).alias("predicted"))


def rewind(audit: DataFrame, moment: object, key: str = "gid") -> DataFrame:
    """State of each document at ``moment``: the latest ``after`` up to it, else the earliest ``before``."""
    t = F.lit(moment)
    return audit.groupBy(key).agg(F.max(F.when(F.col("ts") <= t, F.struct("ts", "seq", "after"))).alias("l"), F.min(F.struct("ts", "seq", "before")).alias("e")).select(key, F.when(F.col("l").isNotNull(), F.col("l.after")).otherwise(F.col("e.before")).alias("state"))


def undo_to(stack: DataFrame, first_undone: object, key: str = "gid") -> DataFrame:
    """What each target goes back to when everything from ``first_undone`` on is reverted."""
    return stack.where(F.col("seq") >= F.lit(first_undone)).groupBy(key).agg(F.min(F.struct("seq", "before")).alias("e"), F.count(F.lit(1)).alias("reverted")).select(key, F.col("e.before").alias("state"), "reverted")


def last_event(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def per_second(events: DataFrame, ts: str, seconds: int = 60) -> DataFrame:
    """Requests in each of the last ``seconds``, 0 where there were none."""
    ends = events.agg(F.max(F.unix_seconds(F.col(ts).cast("timestamp"))).alias("last"))
    grid = ends.select(F.explode(F.sequence(F.col("last") - (seconds - 1), F.col("last"))).alias("second"))
    n = events.groupBy(F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")).agg(F.count(F.lit(1)).alias("requests"))
    return grid.join(n, "second", "left").select("second", F.coalesce("requests", F.lit(0)).alias("requests"))


def within_rate(events: DataFrame, ts: str, user: str, limit: int, order: Column | None = None) -> DataFrame:
    """Each event with its place in the user's minute and whether the limit admits it."""
    minute = F.date_trunc("minute", F.col(ts))
    w = Window.partitionBy(user, minute).orderBy(order if order is not None else F.col(ts))
    return events.withColumn("place", F.row_number().over(w)).withColumn("admitted", F.col("place") <= limit)
