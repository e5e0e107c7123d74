"""Streaming forms: continuous sums, rate limits, late binding, replicas, listeners."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brindle.operators.mutate import upsert
from brindle.operators.timeseries import last_event

SCHEMES = ("http", "https", "ftp")


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def continuous_sum(events: DataFrame, by: str, value: str) -> DataFrame:
    """Grouped sum over an append log, for output mode update or complete."""
    x = F.col(value).cast("decimal(28,6)")
    return events.where(F.col(by).isNotNull() & x.isNotNull()).groupBy(F.col(by).cast("string").alias("_group")).agg(F.sum(x).cast("double").alias(value))


def requests_per_minute(events: DataFrame, ts: str, user: str, late: str = "1 minute", before: Column | None = None) -> DataFrame:
    """Tumbling one-minute counts by user; rejected where over a limit downstream.

    Events not ``before`` a moment move the watermark on, but are not counted.
    """
    counted = F.lit(True) if before is None else F.col(ts) < before
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), user).agg(F.count(F.when(counted, 1)).alias("requests"))
    return counts.where("requests > 0").select(F.col("window.start").alias("minute"), user, "requests")


def requests_per_second(events: DataFrame, ts: str, late: str = "10 seconds") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 second")).agg(F.count(F.lit(1)).alias("requests")).select(F.col("window.start").alias("second"), "requests")


def late_bonds(bonds: DataFrame, targets: DataFrame, lease: str, late: str = "0 seconds") -> DataFrame:
    """Bonds that wait for their target: fused if it comes before the lease ends, else expired.

    bonds: source, target, bond_ts; targets: gid, target_ts. An outer join of
    two streams; the state of a bond lives as long as its lease.
    """
    b, t = bonds.withWatermark("bond_ts", late), targets.withWatermark("target_ts", late)
    arrives = F.expr(f"target = gid AND target_ts >= bond_ts AND target_ts < bond_ts + INTERVAL {lease}")
    return b.join(t, arrives, "leftOuter").select("source", "target", "bond_ts", "target_ts", F.when(F.col("gid").isNull(), "expired").otherwise("fused").alias("status"))


def listen(events: DataFrame, bucket: str, gid: str | None = None) -> DataFrame:
    """The changes of a bucket, or of one document."""
    return events.where(F.col("bucket") == bucket) if gid is None else events.where(F.col("gid") == gid)


def apply_replica(current: DataFrame, batch: DataFrame, key: str, where: Column, fields: list[str], order: list[str]) -> DataFrame:
    """The replica after a batch of changes: matches are upserted, all else leaves it."""
    last = last_event(batch, key, order)
    live = last.where(where & (F.col("action") != "DRAIN"))
    gone = last.join(live.select(key), key, "left_anti").select(key)
    return upsert(current.join(gone, key, "left_anti").select(*current.columns), live.select(*fields), key)


def replica_writer(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, where: Column, fields: list[str], order: list[str]) -> DataStreamWriter:
    return changes.writeStream.foreachBatch(lambda batch, _: write(apply_replica(read(), batch, key, where, fields, order)))


def allowed_url(url: str, private: Callable[[str], bool] | None = None) -> bool:
    """Only web addresses, and none inside the own network."""
    parts = urlparse(url)
    host = (parts.hostname or "").lower()
    inside = host in ("localhost", "") or host.startswith(("127.", "10.", "192.168.", "169.254.", "0.")) or any(host.startswith(f"172.{n}.") for n in range(16, 32)) or host.endswith(".internal") or ":" in host
    return parts.scheme in SCHEMES and not inside and not (private and private(host))


def webhook_writer(changes: DataFrame, hooks: DataFrame, send: Callable[[str, dict], bool], log: Callable[[list], None], tries: int = 3, pause: float = 1.0) -> DataStreamWriter:
    """Send each change that a hook (bucket, action, url) asks for; 3 tries, each pause twice the last.

    Rows are read one at a time from the driver's iterator, never all at once.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        out = []
        for row in batch.join(hooks, ["bucket", "action"]).toLocalIterator():
            ok = False
            for k in range(tries if allowed_url(row["url"]) else 0):
                if ok := send(row["url"], row.asDict()):
                    break
                time.sleep(pause * 2**k)
            out.append((number, row["url"], row["gid"], ok))
        log(out)

    return changes.writeStream.foreachBatch(deliver)


def trigger_writer(changes: DataFrame, run: Callable[[str], object], template: str, action: str, depth: int = 5) -> DataStreamWriter:
    """Run a statement for each change; ``$field$`` stands for the field's value."""

    def fire(batch: DataFrame, _: int) -> None:
        for row in batch.where(F.col("action") == action).where(F.coalesce("depth", F.lit(0)) < depth if "depth" in batch.columns else F.lit(True)).toLocalIterator():
            run(interpolate(template, row.asDict()))

    return changes.writeStream.foreachBatch(fire)


def interpolate(template: str, fields: dict) -> str:
    for k, v in fields.items():
        template = template.replace(f"${k}$", "" if v is None else str(v))
    return template


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain what is there now into a memory table: for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
