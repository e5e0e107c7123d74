"""Shared pieces: scratch tables, packed columns, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
#: Bytes of texts that go to a Python worker, or come from it, together (and one row more).
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) is a
    folder made here and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-", dir=os.environ.get("TMPDIR") or None)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables written inside each ``temporary`` that is open, innermost last.
_written: list[list[str]] = []


def materialize(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor never recomputes what stands above,
    and fixes the outcome of anything not repeatable (numbering of ties). With
    ``stay`` the table outlives the innermost ``temporary``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if len(_written) > stay:
        _written[-1 - stay].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside go at the end, as do the shuffle files of its steps; what is used later must ``stay``."""
    _written.append([])
    try:
        yield
    finally:
        discard(spark, *_written.pop())
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to; executors then delete their files.

    What Python drops is told to the JVM by a thread that looks every second,
    and what that frees there may hold more, hence twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most ``BATCH_BYTES``, however long the texts: a worker holds a few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lean(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For generators that run in Python workers: what one has freed goes back to the system when its task ends.

    Workers outlive tasks and keep freed memory otherwise, so a later stage
    would pay for the peak of an earlier one beside its own.
    """

    @functools.wraps(work)
    def run(*args, **kwargs):
        try:
            yield from work(*args, **kwargs)
        finally:
            give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library only
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(*cols: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def numbered(df: DataFrame, keys: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """``df`` with column ``name``: gapless from 0 within ``keys``.

    No task ever sees a whole key: rows are numbered within (key, ``spread``),
    and the sizes of those groups, at most ``buckets`` a key, give the offsets.
    """
    df = df.withColumn("_spread", spread)
    sizes = df.groupBy(*keys, "_spread").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_spread", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_spread").orderBy(*order)
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, "_spread"]]
    left = df.withColumn("_rank", F.row_number().over(within) - 1).alias("_l")
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = left.join(offsets.alias("_r"), cond, "left")
    keep = [F.col(f"_l.{c}") for c in df.columns if c != "_spread"]
    return out.select(*keep, (F.col("_l._rank") + F.col("_r._offset")).cast("long").alias(name))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that ``edges`` (a, b) reach from each node.

    Alternating large-star and small-star rounds; each moves every node's
    links to the smallest node it knows, so the number of rounds is
    logarithmic, and no round holds a node's links in one place: both stars
    are a ``min`` by key followed by a join on it.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    if not links.take(1):
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = None
    for _ in range(rounds):
        near = both(links)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        held = large.join(low, "a")
        small = held.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links, before = materialize(small, name), links
        discard(edges.sparkSession, before.scratch_path)
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
