"""Windows of units (bytes, words) that also start elsewhere: the shared search.

Every window of W units has an anchor, the gram inside it with the smallest
hash (the leftmost of equals), which depends on the window's content alone. So
consecutive windows with one anchor make a *piece*, and equal windows meet if
pieces are brought together by the hash of their anchor's gram:

1. ``cut_pieces``: each document's pieces, as packed columns, one binary a
   receiving task instead of a row a piece (about 23 bytes a piece and one
   piece for 9 to 18 units).
2. ``judge_pieces``: among pieces of one anchor gram, those of one hash are one
   *kind*. The first of a kind that occurs again is a *source*, the others are
   *covered* whole; where a gram has several kinds, the first of each may be
   *open* and ask for its text. An equal window holds the gram and either half of
   what a window has besides, on its left or on its right; so only pieces of
   several kinds that agree on a hash of one side are open (a chance meeting of
   grams is common in a large corpus, one of twice their length is not). All
   other pieces are unique.
3. ``send_open``: the text of open pieces only, to be compared exactly, window
   by window, by the operator that uses this search. A gram with more than
   ``hot_kinds`` kinds is split: its pieces go as single windows, dealt by the
   hash of the window, so no task gets a gram that many texts vary around.
4. ``verified``: every source and covered stretch is read again at its place,
   and 128-bit digests of the text itself are compared. Kinds whose hash brought
   different texts together are taken apart and compared exactly like open ones.

A piece is at most 2 W units long, whatever the text; a long document is cut
into segments that overlap by a window. A document is known by its doc_id and
a 64-bit tag of its text, so rows that share a doc_id are kept apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, discard, lean, materialize, release_shuffles, shuffle_partitions, temporary

#: Units that are looked at together, and the most in one segment.
CHUNK, SEGMENT = 1 << 20, 1 << 20
PLACE_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
KEY = ["doc_id", "tag"]
COVERED, OPEN, SOURCE = 0, 1, 2
JUDGED = "doc_id long, tag long, at long, path long"


@dataclass(frozen=True)
class Units:
    """What windows are made of. within: an earlier start in the same document counts."""

    window: int
    gram: int  # a power of two
    within: bool
    split: Callable[[bytes], object]  # the text as something that slices
    numbers: Callable[[object], np.ndarray]  # a 64-bit number for each unit
    join: Callable[[object], bytes]  # a slice as text
    bits: int = 64  # of the hash of a piece; fewer only in tests, to make collisions
    hot_kinds: int = 256  # of one gram that meet in one task; beyond, its windows are dealt one by one


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64),) * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        n = max(n + 1, 1 << 16)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _powers


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Sums of unit times power: the hash of [a, b) is (p[b] - p[a]) / base^a."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units + np.uint64(1)) * powers(len(units))[0][: len(units)], out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (prefix[b] - prefix[a]) * powers(len(prefix))[1][a]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX
    return x ^ x >> np.uint64(29)


def pieces_of(units: np.ndarray, ends: np.ndarray, spec: Units) -> dict[str, np.ndarray]:
    """The pieces of segments that end at ``ends``: start, anchor's offset, windows, hashes."""
    w, k = spec.window, spec.gram
    n = len(units) - w + 1
    if n <= 0:
        return {x: np.zeros(0, np.int64) for x in ("start", "offset", "windows", "left", "right")} | {x: np.zeros(0, np.uint64) for x in ("gram", "text")}
    gram, size = mixed(units), 1
    while size < k:
        gram = gram[:-size] * MIX + (gram[size:] ^ gram[size:] >> np.uint64(17))
        size *= 2
    gram = mixed(gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span, size = w - k + 1, 1
    while 2 * size <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if span > size:
        best = np.minimum(best[: size - span], best[span - size :])
    anchor = (best & low).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(ends[:-1] - w + 1, 0, n), 1)
    np.add.at(edge, np.clip(ends[:-1], 0, n), -1)
    valid = np.cumsum(edge[:-1]) == 0  # windows that end inside their segment
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(fresh & valid)
    stop = np.ones(n, bool)
    stop[:-1] = fresh[1:] | ~valid[1:]
    windows = np.flatnonzero(stop & valid) - start + 1
    offset = anchor[start] - start
    prefix = prefix_hashes(units)
    text = stretch_hashes(prefix, start, start + windows - 1 + w)
    near = (w - k + 1) // 2  # a window holds so many units before its gram, or the units after it that ``far`` counts
    far = w - k - near + 1
    sides = {}
    for side, a, size, held in (("left", start + offset - near, near, offset >= near), ("right", start + offset + k, far, offset - windows < w - k - far)):
        a = np.where(held, a, 0)  # 0 below stands for a side that the piece does not hold
        sides[side] = np.where(held, 1 + (mixed(stretch_hashes(prefix, a, a + size)) % np.uint64(65_535)).astype(np.int64), 0)
    return sides | {"start": start, "offset": offset, "windows": windows, "gram": gram[anchor[start]] >> np.uint64(16), "text": mixed(text + windows.astype(np.uint64) * MIX + offset.astype(np.uint64)) >> np.uint64(64 - spec.bits)}


WIDTHS = (("gram", 6), ("text", 8), ("start", 5), ("offset", 1), ("windows", 1), ("left", 2), ("right", 2))


def packed(cols: dict[str, np.ndarray], docs: np.ndarray, tags: np.ndarray, doc_of: np.ndarray) -> bytes:
    """Columns byte by byte, compressed; pieces stand by document."""
    import zstandard

    first = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    own, runs = doc_of[first], np.diff(np.append(first, len(doc_of)))
    parts = [np.array([len(doc_of), len(own)], np.int64).tobytes()]
    for a, width in [(docs[own], 8), (tags[own], 8), (runs, 4), *((cols[c], w) for c, w in WIDTHS)]:
        parts.append(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes, only: str | None = None) -> dict[str, np.ndarray]:
    """The columns, or the first one alone."""
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, docs = (int(x) for x in raw[:16].view(np.int64))
    at = 16

    def take(rows: int, width: int) -> np.ndarray:
        nonlocal at
        out = np.zeros((rows, 8), np.uint8)
        out[:, :width] = raw[at : at + rows * width].reshape(width, rows).T
        at += rows * width
        return out.view(np.int64)[:, 0]

    if only:
        at += docs * 20
        return {only: take(n, dict(WIDTHS)[only])}
    doc, tag, runs = take(docs, 8), take(docs, 8), take(docs, 4)
    out = {c: take(n, w) for c, w in WIDTHS}
    return out | {"doc": np.repeat(doc, runs), "tag": np.repeat(tag, runs)}


def segments(batches: Iterator[pa.RecordBatch], spec: Units, rows: int = 128) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(doc_id, tag, where it starts, units) of each segment that holds a window."""
    step = SEGMENT - spec.window + 1
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            for doc, tag, text in zip(*(batch.column(c).slice(at, rows).to_pylist() for c in range(3))):
                units = spec.numbers(spec.split(text or b""))
                for a in range(0, len(units) - spec.window + 1, step):
                    yield doc, tag, a, units[a : a + SEGMENT]


@lean
def cut_pieces(batches: Iterator[pa.RecordBatch], spec: Units, buckets: list[int]) -> Iterator[pa.RecordBatch]:
    def done(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(x[3]) for x in held])
        ends = np.cumsum(sizes)
        cols = pieces_of(np.concatenate([x[3] for x in held]), ends, spec)
        of = np.searchsorted(ends, cols["start"], "right")
        cols["start"] = cols["start"] - (ends - sizes)[of] + np.array([x[2] for x in held])[of]
        docs, tags = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        bucket = (cols["gram"] % np.uint64(len(buckets))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(len(buckets) + 1))
        data, whom = [], []
        for b in np.flatnonzero(np.diff(cut)):
            own = order[cut[b] : cut[b + 1]]
            data.append(packed({c: cols[c][own] for c, _ in WIDTHS}, docs, tags, of[own]))
            whom.append(buckets[b])
        return pa.record_batch([pa.array(whom, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "pieces"])

    held, size = [], 0
    for segment in segments(batches, spec):
        if size and size + len(segment[3]) > CHUNK:
            yield done(held)
            held, size = [], 0
        held.append(segment)
        size += len(segment[3])
    if held:
        yield done(held)


@lean
def judge_pieces(batches: Iterator[pa.RecordBatch], spec: Units) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, at, path) of the pieces that occur again or are open; ``at`` packs place and role."""
    blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
    if not blobs:
        return
    gram = np.sort(np.concatenate([unpacked(x, only="gram")["gram"] for x in blobs]))
    shared = np.unique(gram[1:][gram[1:] == gram[:-1]])
    del gram
    if not len(shared):
        return
    some = []
    for i, x in enumerate(blobs):
        cols, blobs[i] = unpacked(x), b""
        near = np.minimum(np.searchsorted(shared, cols["gram"]), len(shared) - 1)
        keep = shared[near] == cols["gram"]
        some.append({c: v[keep] for c, v in cols.items()})
    p = {c: np.concatenate([x.pop(c) for x in some]) for c in list(some[0])}
    p["shape"] = p["offset"] << 8 | p["windows"]
    order = np.lexsort((p["start"], p["doc"], p["shape"], p["text"], p["gram"]))
    p = {c: x[order] for c, x in p.items()}
    starts = np.ones(len(order), bool)
    starts[1:] = p["gram"][1:] != p["gram"][:-1]
    new = starts.copy()
    new[1:] |= (p["text"][1:] != p["text"][:-1]) | (p["shape"][1:] != p["shape"][:-1])
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    lasts = np.append(heads[1:], len(order)) - 1
    first_doc = p["doc"][heads][group]
    lead = new if spec.within else p["doc"] == first_doc  # what no equal piece covers
    again = (lasts > heads if spec.within else p["doc"][lasts] > p["doc"][heads])[group]
    at_gram, of_gram = np.flatnonzero(starts), np.cumsum(starts) - 1
    kinds = np.add.reduceat(new.astype(np.int64), at_gram)
    several = np.zeros(len(order), bool)
    for side in ("left", "right"):
        by = np.lexsort((p[side], of_gram))
        cut = np.flatnonzero(np.concatenate([[True], (of_gram[by][1:] != of_gram[by][:-1]) | (p[side][by][1:] != p[side][by][:-1])]))
        differ = lambda x: np.minimum.reduceat(x[by], cut) < np.maximum.reduceat(x[by], cut)  # noqa: B023, E731
        meet = (p[side][by][cut] != 0) & differ(group)
        if not spec.within:
            meet &= differ(p["doc"])
        several[by] |= np.repeat(meet, np.diff(np.append(cut, len(by))))
    hot = (kinds > spec.hot_kinds)[of_gram].astype(np.int64)
    rows = [(np.flatnonzero(again), np.where(lead, SOURCE, COVERED)), (np.flatnonzero(lead & several), np.full(len(order), OPEN))]
    at = p["start"] << 20 | p["offset"] << 12 | p["windows"] << 4 | hot << 3
    path = mixed(p["text"].view(np.uint64) ^ p["gram"].view(np.uint64)).view(np.int64)
    for found, role in rows:
        for i in range(0, len(found), 50_000):
            j = found[i : i + 50_000]
            own = np.where(role[j] == OPEN, 0, path[j])  # nothing looks up an open piece by its path
            yield pa.record_batch([pa.array(p["doc"][j]), pa.array(p["tag"][j]), pa.array(at[j] | role[j]), pa.array(own)], names=["doc_id", "tag", "at", "path"])


def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor's offset, windows, role)."""
    return at >> 20, at >> 12 & 255, at >> 4 & 255, at & 7


def role_of(at: str = "at"):
    return F.col(at).bitwiseAND(7)


def bucket_ids(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that hashes to it."""
    rows = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in rows}
    return [found[p] for p in sorted(found)]


def judged(docs: DataFrame, spec: Units, suspects: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, at, path) for docs (doc_id, tag, text as binary); null doc_ids take no part.

    Pieces of ``suspects`` (path) are open, every one.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    bounded_batches(spark)
    buckets = bucket_ids(spark, n)
    cut = docs.where("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(lambda x: cut_pieces(x, spec, buckets), "bucket long, pieces binary")
    known = materialize(cut.repartition(n, "bucket").mapInArrow(lambda x: judge_pieces(x, spec), JUDGED), "judged")
    del cut
    release_shuffles(spark)
    if suspects is None:
        return known
    apart = known.join(suspects, "path", "left_semi").withColumn("at", F.col("at").bitwiseAND(~7).bitwiseOR(OPEN)).withColumn("path", F.lit(0).cast("long"))
    return known.join(suspects, "path", "left_anti").unionByName(apart).distinct()


@lean
def send_open(batches: Iterator[pa.RecordBatch], spec: Units, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, tag, at, piece) of open pieces, from (doc_id, tag, text, ats)."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    names = ["gram", "doc_id", "tag", "at", "piece"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            out = []
            for doc, tag, text, ats in zip(*(batch.column(c).slice(i, rows).to_pylist() for c in ("doc_id", "tag", "text", "ats"))):
                asked = [x for x in ats or () if x & 7 == OPEN]
                if asked:
                    seq = spec.split(text or b"")
                    for x in asked:
                        start, offset, windows = x >> 20, x >> 12 & 255, x >> 4 & 255
                        if x >> 3 & 1:  # a hot gram
                            for k in range(windows):
                                window = spec.join(seq[start + k : start + k + spec.window])
                                out.append((hashed(window) >> 1, doc, tag, (start + k) << 20 | (offset - k) << 12 | 1 << 4 | OPEN, window))
                        else:
                            gram = hashed(spec.join(seq[start + offset : start + offset + spec.gram])) >> 1
                            out.append((gram, doc, tag, x, spec.join(seq[start : start + windows - 1 + spec.window])))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def by_gram(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by gram, cut between grams into tables of about ``most`` rows (more only for one gram)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            done = int(np.searchsorted(gram, gram[-1]))
            if done:
                yield t.slice(0, done)
                held, rows = t.slice(done).to_batches(), t.num_rows - done
    if rows:
        yield pa.Table.from_batches(held)


def with_places(docs: DataFrame, judged_: DataFrame, how: str = "left") -> DataFrame:
    """docs with the places of their pieces, and the pieces' paths, as arrays.

    Two lists, which one aggregation fills in one order, as neither column has
    nulls: a list of structs takes half as much again of a shuffle.
    """
    found = judged_.groupBy(*KEY).agg(F.collect_list("at").alias("ats"), F.collect_list("path").alias("paths"))
    return docs.join(found, KEY, how).select(*docs.columns, "ats", "paths")


def tagged(docs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """(doc_id, tag, text as binary, null as empty), and ``carried`` columns, with ``absent`` for a null text, in a struct ``rest``."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    rest = [F.struct(*[F.struct(*carried).alias("own")] * bool(carried), F.col("text").isNull().alias("absent")).alias("rest")] if carried else []
    return docs.select("doc_id", F.xxhash64(text).alias("tag"), text.alias("text"), *rest)


def lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of arrays of numbers; null as empty."""
    values, edge = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edge, edge[1:])]


def digests(parts: list[bytes]) -> np.ndarray:
    """(low, high) of the 128-bit digest of each."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


CHECKS = "paths array<long>, lows array<long>, highs array<long>"


def check_columns(paths: list[np.ndarray], found: list[np.ndarray]) -> list[pa.Array]:
    """Columns of ``CHECKS`` for some rows."""
    return [pa.array(paths, pa.list_(pa.int64())), *(pa.array([x[:, k] for x in found], pa.list_(pa.int64())) for k in (0, 1))]


def verified(spark: SparkSession, build: Callable[[DataFrame | None], tuple[DataFrame, Callable[[DataFrame], DataFrame]]], name: str) -> DataFrame:
    """The table that ``build`` makes, with one text behind each of its paths.

    ``build`` takes the paths known to stand for several texts (None at first)
    and returns a table with ``CHECKS`` and a function from wrong checks (path)
    to the paths of pieces to take apart. One round, unless a hash collided.
    """
    suspects = None
    while True:
        with temporary(spark):
            made, pieces_of_checks = build(suspects)
            out = materialize(made, name, stay=True)
            del made
            release_shuffles(spark)
            each = out.select(F.explode(F.arrays_zip("paths", "lows", "highs")).alias("c")).select(F.col("c.paths").alias("path"), F.col("c.lows").alias("low"), F.col("c.highs").alias("high"))
            several = each.groupBy("path").agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("low", "high")])
            wrong = materialize(several.where("min_low <> max_low OR min_high <> max_high").select("path"), "collided")
            if not wrong.take(1):
                return out.drop("paths", "lows", "highs")
            wrong = materialize(pieces_of_checks(wrong), "collided", stay=True)
        discard(spark, out.scratch_path)
        suspects = wrong if suspects is None else suspects.union(wrong)
