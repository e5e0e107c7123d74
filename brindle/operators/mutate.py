"""Changes as new DataFrames: copy on write, tombstones, branches, limits.

Built-in Parquet tables have no row-level DML, so a change is a plan over the
old rows; who binds the result to the name decides when it takes effect.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLACE = ("OVERWRITE CURRENT", "REPLACE OLDEST", "REPLACE LEAST RECENTLY USED")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole documents replace those of the same key; of several new ones any last one by all columns wins."""
    one = Window.partitionBy(key).orderBy(*[F.desc(c) for c in new.columns if c != key] or [F.lit(1)])
    new = new.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new, allowMissingColumns=True)


def change(base: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Patch top-level fields of the rows that ``where`` finds."""
    kinds = dict(base.dtypes)
    cols = {}
    for f, v in values.items():
        cols[f] = F.when(where, v.cast(kinds[f]) if f in kinds else v).otherwise(F.col(f) if f in kinds else F.lit(None))
    return base.withColumns(cols)


def drain(base: DataFrame, where: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, tombstones)."""
    hit = F.coalesce(where, F.lit(False))
    return base.where(~hit), base.where(hit).withColumn("_deleted_at", at)


def salvage(base: DataFrame, rubbish: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(with the salvaged rows, rubbish without them)."""
    return base.unionByName(rubbish.where(where).drop("_deleted_at")), rubbish.where(~F.coalesce(where, F.lit(False)))


def purge(rubbish: DataFrame, now: Column, seconds: int = 259_200) -> DataFrame:
    return rubbish.where(F.unix_timestamp("_deleted_at") >= F.unix_timestamp(now) - seconds)


def overlay(master: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """A branch as it reads: its own rows, tombstones hidden (``_deleted``), else the master's."""
    live = delta.where(~F.col("_deleted")).drop("_deleted")
    return master.join(delta.select(key), key, "left_anti").select(*master.columns).unionByName(live.select(*master.columns))


def merge_report(master: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    both = delta.select(key, "_deleted").join(master.select(key).withColumn("_old", F.lit(True)), key, "left")
    old = F.coalesce("_old", F.lit(False))
    return both.agg(F.count_if(~F.col("_deleted") & ~old).alias("added"), F.count_if(~F.col("_deleted") & old).alias("updated"), F.count_if(F.col("_deleted") & old).alias("deleted"))


def evict(base: DataFrame, stamp: str, key: str, capacity: int = 100, by: str | None = None) -> DataFrame:
    """The ``capacity`` rows used (or updated) last, of each ``by``."""
    if by is None:
        return base.orderBy(F.desc(stamp), F.desc(key)).limit(capacity)
    w = Window.partitionBy(by).orderBy(F.desc(stamp), F.desc(key))
    return base.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= capacity).drop("_n")


def living(base: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows without an end, or whose end is not yet passed."""
    return base.where(F.col(expires).isNull() | (F.col(expires) > now))


def audit_of(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action, before, after) of what differs."""
    body = lambda df, name: df.select(key, F.to_json(F.struct(*df.columns)).alias(name))
    both = body(old, "before").join(body(new, "after"), key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    action = F.when(F.col("before").isNull(), "POUR").when(F.col("after").isNull(), "DRAIN").otherwise("CHANGE")
    return both.select(key, action.alias("action"), "before", "after")


def migrate(base: DataFrame, source: dict[str, str], target: dict[str, str]) -> DataFrame:
    """Move fields by pattern: {"name": "(\\w+) (\\w+)"} to {"first": "$1", "last": "$2"}; _version goes up by one.

    Rows in which a pattern does not match keep their fields and get none.
    """
    hit = F.lit(True)
    groups: dict[int, Column] = {}
    n = 0
    for field, pattern in source.items():
        x = F.col(field).cast("string")
        hit = hit & F.coalesce(x.rlike(f"^(?:{pattern})$"), F.lit(False))
        for i in range(1, re.compile(pattern).groups + 1):
            n += 1
            groups[n] = F.regexp_extract(x, f"^(?:{pattern})$", i)
    made = {}
    for field, shape in target.items():
        parts = [groups[int(p[1:])] if re.fullmatch(r"\$\d+", p) else F.lit(p) for p in re.split(r"(\$\d+)", shape) if p]
        made[field] = F.when(hit, F.concat(*parts))
    old = F.col("_version") if "_version" in base.columns else F.lit(1)
    out = base.withColumns({**{f"_new_{k}": v for k, v in made.items()}, "_hit": hit})
    out = out.withColumns({k: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(k)) for k in source})
    for k in made:
        out = out.withColumn(k, F.coalesce(f"_new_{k}", k) if k in base.columns else F.col(f"_new_{k}"))
    return out.withColumn("_version", F.when(F.col("_hit"), old + 1).otherwise(old)).drop("_hit", *[f"_new_{k}" for k in made])


def copy_flow(source: DataFrame, target: DataFrame, rules: list[tuple[Column, str]], key: str) -> tuple[DataFrame, DataFrame]:
    """(source, target) after a flow; the first rule that holds says COPY or MOVE."""
    action = F.lit(None).cast("string")
    for where, what in reversed(rules):
        action = F.when(where, what).otherwise(action)
    marked = source.withColumn("_action", action)
    out = upsert(target, marked.where("_action is not null").drop("_action"), key)
    return marked.where("_action is null or _action <> 'MOVE'").drop("_action"), out


def content_id(bucket: str, body: Column) -> Column:
    """16 hex digits of a document's content: equal bodies are one document."""
    return F.concat(F.lit(f"{bucket}:"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit(bucket), body))), 16, "0"))


def retention(buckets: dict[str, dict], name: str) -> dict:
    """Own limits first, then those of the parents."""
    out: dict = {}
    seen = set()
    while name and name not in seen:
        seen.add(name)
        own = buckets.get(name, {})
        out = {k: v for k, v in own.items() if k in ("max_docs", "ttl_seconds") and v is not None} | out
        name = own.get("parent")
    return out


def parse_document(text: str) -> dict:
    return json.loads(text)
