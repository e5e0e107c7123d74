"""Sharding by balanced label propagation, in DataFrame functions only.

Documents that link to each other (here: equal texts) form groups; a shard is
a label. Each round every group looks at the labels of its members, which is
one pre-aggregated count by (group, label), and its members ask to move to the
most frequent one. Requests are granted by quota: a shard takes no more linked
documents than its share. Documents without links move last and fill what is
left, which makes the counts even without cutting a link.

Law ``rows``: the counts of two shards differ by at most one. A group larger
than a shard's share is treated as several, each of which may settle apart.

Defined cases: a null text has size 1 and crc32 0, and links with no other
document; an empty text is a text like any other and links with its equals.
Repeated rows are rows of their own. An empty table gives an empty result.
A second run on the same rows gives the same shards, however they are dealt.
Extra columns of the input are ignored by the query and kept by ``shard``, but
for those named shard or slot, which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize, numbered, salt_of, table

SHARDS = 8
ROUNDS = 3
#: A group moves in blocks of at most this share of a shard.
BLOCKS_A_SHARD = 16
#: Groups of requests that are granted or put off together, for each shard.
SLICES = 512


def _loads(df: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for label, n in df.groupBy("label").count().collect():  # one row a shard
        out[label] = n
    return out


def _propagate(linked: DataFrame, shards: int, share: int, rounds: int) -> DataFrame:
    """(key, doc, label) of the linked documents after ``rounds``."""
    for _ in range(rounds):
        votes = linked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        wish = votes.groupBy("key").agg(F.max(F.struct("n", (-F.col("label")).alias("low"))).alias("v"), F.sum("n").alias("all"))
        wish = wish.select("key", (-F.col("v.low")).alias("home"), F.greatest(F.lit(1), F.ceil(F.col("all") * BLOCKS_A_SHARD / F.lit(max(1, share)))).alias("blocks"))
        # a group of more than one share: its later blocks wish for the shards after its home
        asked = linked.join(wish, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
        asked = asked.withColumn("want", F.pmod(F.col("home") + F.floor(F.col("block") / BLOCKS_A_SHARD), F.lit(shards)).cast("int"))
        asked = asked.withColumn("slice", salt_of("key", "block", buckets=SLICES))
        held = asked.where("want = label").groupBy("label").count().collect()  # one row a shard
        room = {r["label"]: share - r["count"] for r in held}
        quota = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, room.get(s, share)))])
        queue = Window.partitionBy("want").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        moves = asked.where("want <> label").groupBy("want", "slice").agg(F.count(F.lit(1)).alias("n"))
        granted = moves.withColumn("upto", F.sum("n").over(queue)).where(F.col("upto") <= quota[F.col("want")]).select("want", "slice", F.lit(True).alias("granted"))
        moved = asked.join(F.broadcast(granted), ["want", "slice"], "left")  # at most SLICES rows a shard
        linked = materialize(moved.select("key", "doc", F.when(F.col("granted"), F.col("want")).otherwise(F.col("label")).alias("label")), "labels")
        if not moves.take(1):
            break
    return linked


def shard(docs: DataFrame, key: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; documents of equal ``key`` (null: none) link."""
    row = F.struct(*[c for c in docs.columns if c not in ("shard", "slot")])
    base = materialize(docs.select(row.alias("_row"), key.alias("_key"), F.md5(F.to_json(row)).alias("_hash")), "sharding")
    # a row's id is its content and its number among equal rows, so that a run repeats; equal rows may change places
    base = numbered(base, ["_hash"], [F.col("_hash")], F.spark_partition_id(), 0, "_nth")
    base = materialize(base.select("_row", "_key", F.concat_ws("-", "_hash", "_nth").alias("_uid")), "sharding")
    rows = base.count()
    share = max(1, rows // shards)
    first = salt_of("_uid", buckets=shards)
    groups = base.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    linked = base.join(groups, F.col("_key") == F.col("key"), "left_semi").select(F.col("_key").alias("key"), F.col("_uid").alias("doc"), first.alias("label"))
    linked = _propagate(materialize(linked, "labels"), shards, share, rounds)

    placed = base.join(linked.select(F.col("doc").alias("_doc"), "label", F.col("key").alias("_group")), F.col("_uid") == F.col("_doc"), "left")
    placed = placed.withColumn("label", F.coalesce("label", first)).withColumn("_free", F.when(F.col("_doc").isNull(), SLICES).otherwise(0) + salt_of(F.coalesce(F.col("_group"), F.col("_uid")), buckets=SLICES))
    order = [F.col("_group").asc_nulls_last(), F.col("_uid")]
    placed = materialize(numbered(placed.drop("_doc"), ["label"], order, F.col("_free"), 2 * SLICES, "_rank"), "placed")

    loads = _loads(placed, shards)
    most = [rows // shards + (s < rows % shards) for s in range(shards)]
    limit = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, most[s])])
    kept = placed.where(F.col("_rank") < limit[F.col("label")]).select("*", F.col("label").alias("shard"), F.col("_rank").alias("slot"))
    over = placed.where(F.col("_rank") >= limit[F.col("label")])
    over = numbered(over.withColumn("_all", F.lit(0)), ["_all"], order, F.col("_free"), 2 * SLICES, "_over")
    to, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    spans = []
    for s in range(shards):
        gap = max(0, most[s] - loads[s])
        spans.append((s, upto, upto + gap, min(loads[s], most[s])))
        upto += gap
    for s, lo, hi, at in spans:
        here = (F.col("_over") >= lo) & (F.col("_over") < hi)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("_over") - lo + at).otherwise(slot)
    over = over.select(*kept.columns[:-2], to.alias("shard"), slot.cast("long").alias("slot"))
    return kept.unionByName(over).select("_row.*", "shard", "slot")


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.crc32(F.col("text").cast("binary"))).cast("long").alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
    )
    out = shard(base, F.when(F.col("digest").isNotNull(), F.concat(F.col("digest"), F.col("size").cast("string").cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
