"""Near-duplicate vectors: iterative quantisation, Hamming tables, reranking.

A rotation that balances the variance of binary codes is learned (alternating
between the codes and the orthogonal map that fits them best) on a bounded
sample of the distinct vectors. A code's bits are the signs of the rotated
vector. The code is cut into tables; in each table a vector is stored under
its own key and looked up under the keys that flip the bits nearest to zero,
in rising order of the flipped squares, so that the likeliest keys come first.
What meets in a table and is near enough in the whole code is reranked by the
cosine of the original vectors in double precision: every pair given as linked
is exactly at or above the threshold. Recall is measured in the tests.

Equal vectors are one before the search and count as links of each other.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; a null vec_id is linked with nothing. Vectors of
each length are searched by themselves, with a rotation of their own, and link
only with their own length; any finite size of the components will do. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, components, materialize, shuffle_partitions, table

THRESHOLD = 0.95
#: The rotation is learned from at most so many distinct vectors.
SAMPLE = 4096
ROUNDS = 40
TABLE_BITS = 16
PROBES = 48
#: Flips among the bits nearest to zero.
FLIPPED_OF, FLIPS = 10, 4
#: Bits in which the whole codes of linked vectors differ at most, of 64.
CODE_DISTANCE = 20


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of unit vectors."""
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1]
    start = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1],) * 2))[0]
    projected, turn = centred @ axes, start
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return mean, axes @ turn


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return unit(x)


SUBSETS = [s for k in range(FLIPS + 1) for s in combinations(range(FLIPPED_OF), k)]
MEMBER = np.array([[i in s for i in range(FLIPPED_OF)] for s in SUBSETS], float)


def probe_batches(batches: Iterator[pa.RecordBatch], mean: np.ndarray, rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, gid, code, own): each vector under its own key and those it is looked up under."""
    dims = len(mean)
    for batch in batches:
        gid = batch.column(0).to_numpy()
        turned = (unit_rows(batch.column(1), dims) - mean) @ rotation
        bits = turned >= 0
        code = np.packbits(np.pad(bits, ((0, 0), (0, -dims % 64))), axis=1, bitorder="little")[:, :8].copy().view(np.uint64)[:, 0]
        for number, at in enumerate(range(0, dims, TABLE_BITS)):
            width = min(TABLE_BITS, dims - at)
            part = bits[:, at : at + width]
            key = (part << np.arange(width)).sum(1).astype(np.int64)
            cost = turned[:, at : at + width] ** 2
            few = min(FLIPPED_OF, width)
            near = np.argsort(cost, axis=1)[:, :few]
            fits = MEMBER[:, few:].sum(1) == 0
            price = np.take_along_axis(cost, near, 1) @ MEMBER[fits][:, :few].T
            chosen = np.argsort(price, axis=1)[:, :PROBES]  # the empty set comes first
            masks = (1 << near) @ MEMBER[fits][:, :few].T.astype(np.int64)
            probes = key[:, None] ^ np.take_along_axis(masks, chosen, 1)
            m = probes.shape[1]
            own = np.zeros((len(gid), m), bool)
            own[:, 0] = True
            yield pa.record_batch([pa.array((probes | number << 32).ravel()), pa.array(np.repeat(gid, m)), pa.array(np.repeat(code.view(np.int64), m)), pa.array(own.ravel())], names=["key", "gid", "code", "own"])


def meet_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a stored and a looked-up vector under one key, from rows sorted by key, own ones first."""

    def pairs(key, gid, code, own):
        out = []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        stored = np.add.reduceat(own.astype(np.int64), edge[:-1]) if len(key) else np.zeros(0, int)
        for at in np.flatnonzero((stored > 0) & (np.diff(edge) > 1)):
            lo, hi, n = edge[at], edge[at + 1], stored[at]
            for i in range(lo, lo + n):  # one stored vector at a time: the key's rows are the only memory
                near = lo + np.flatnonzero(np.bitwise_count(code[lo:hi] ^ code[i]) <= most)
                near = near[gid[near] != gid[i]]
                if len(near):
                    out.append(np.stack([np.minimum(gid[near], gid[i]), np.maximum(gid[near], gid[i])], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    held = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        cols[2] = cols[2].view(np.uint64)
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if done:
            got = pairs(*(x[:done] for x in held))
            yield pa.record_batch([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])
            held = [x[done:] for x in held]
    if held is not None:
        got = pairs(*held)
        yield pa.record_batch([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])


def rerank_batches(batches: Iterator[pa.RecordBatch], dims: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cosine = np.einsum("ij,ij->i", unit_rows(batch.column(2), dims), unit_rows(batch.column(3), dims))
        keep = pa.array(cosine >= threshold)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of (vec_id, embedding)."""
    bounded_batches(vectors.sparkSession)
    number = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    rows = materialize(vectors.select("vec_id", F.when(fine, number).alias("embedding")), "vectors")
    lengths = [r["d"] for r in rows.where("embedding is not null").select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]  # one for each embedding model
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    digest = F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json("embedding"), 256))
    rows = materialize(rows.select("vec_id", digest.alias("digest"), "embedding"), "digests")
    known = None
    for dims in lengths:
        one = known_groups(rows.where(F.size("embedding") == dims), dims, threshold, sample)
        known = one if known is None else known.unionByName(one)
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def known_groups(rows: DataFrame, dims: int, threshold: float, sample: int) -> DataFrame:
    """(digest, n_links, component_id) of the distinct vectors of one length."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("digest").agg(F.min("vec_id").alias("gid"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "groups")
    some = groups.orderBy(F.xxhash64("gid"), "gid").select("embedding").limit(sample).collect()  # bounded
    mean, rotation = learn_rotation(unit(np.array([r["embedding"] for r in some], np.float64)))

    probes = groups.select("gid", "embedding").mapInArrow(lambda x: probe_batches(x, mean, rotation), "key long, gid long, code long, own boolean")
    met = probes.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", F.desc("own")).mapInArrow(lambda x: meet_batches(x, CODE_DISTANCE), "a long, b long")
    pairs = materialize(met.distinct(), "pairs")
    side = lambda name: groups.select(F.col("gid").alias(name), F.col("embedding").alias(f"v{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")
    links = materialize(both.mapInArrow(lambda x: rerank_batches(x, dims, threshold), "a long, b long"), "links")

    ends = links.union(links.select("b", "a")).toDF("gid", "other")
    counts = ends.join(groups.select(F.col("gid").alias("other"), "n"), "other").groupBy("gid").agg(F.sum("n").alias("outside"))
    roots = components(links, "links").withColumnRenamed("node", "gid")
    known = groups.join(counts, "gid", "left").join(roots, "gid", "left")
    return known.select("digest", (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "gid").alias("component_id"))


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, len(embedding) AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
