"""SimHash near-duplicates found through anchor points of a covering code.

A fingerprint has 64 bits; two link at 3 or fewer differing bits, so one of the
two 32-bit halves differs in at most one. The anchors of a half are the words
of the Hamming code over its first 31 bits, which covers every value within a
radius of 1: each fingerprint has one anchor within 1, and whatever differs
from it in one more bit has that anchor within 2. So each distinct fingerprint
is replicated to its anchors within 2, at most 16 a half and 32 in all, and
fingerprints are compared only with those at the same anchor, exactly.

At an anchor only a spanning forest of the links is given on, so a family of m
fingerprints makes at most m - 1 rows there, never all pairs; equal
fingerprints are one before the search. The families are the components.

Defined cases: a null or blank text has fingerprint zero and links like any
other. Repeated rows are documents of their own with the same fingerprint; a
null doc_id is never the smallest unless it is alone. An empty table gives an
empty result. Extra columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, components, materialize, shuffle_partitions, table

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
#: The contract of op8 takes three words; elsewhere near duplicates take five.
PIPELINE_SHINGLE_WORDS = 5
CODE_BITS = 31
#: Groups at an anchor above this size are linked member by member.
FEW = 6


def shingle_hashes(text: str, words: int) -> list[int]:
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return []
    line, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return [hashed(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [hashed(line[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes the bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begins = np.cumsum(sizes) - sizes
    cuts = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins[full], sizes[full])])  # a byte counts to 255
    firsts = np.searchsorted(cuts, begins[full])
    lanes, got = np.uint64(0x0101010101010101), np.zeros(len(full), np.uint64)
    for j in range(8):
        parts = np.add.reduceat((hashes >> np.uint64(j)) & lanes, cuts)
        counts = np.add.reduceat(parts.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        for lane in range(8):
            got |= (counts[:, lane] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * lane + j)
    out[full] = got
    return out


def fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            each = [shingle_hashes(t or "", words) for t in part.column(1).to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            bits = majority(np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum())), sizes)
            yield pa.record_batch([part.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed number."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda x: fingerprint_batches(x, words), "doc_id long, fp long")


def _near_words() -> np.ndarray:
    """For each syndrome the flips that lead to the code words within 2, repeated to one length."""
    flip = lambda i: 0 if i == 0 else 1 << (i - 1)  # noqa: E731  syndrome i is bit i - 1
    rows = [[0] * 16]
    for s in range(1, CODE_BITS + 1):
        rows.append([flip(s), *(flip(i) | flip(i ^ s) for i in range(1, CODE_BITS + 1) if i < i ^ s)])
    return np.array(rows, np.uint64)


FLIPS = _near_words()
CHECKS = [np.uint64(sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> k & 1)) for k in range(5)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint): every anchor within 2 in either half; anchors of the halves differ."""
    keys, whom = [], []
    for half in range(2):
        part = (fps >> np.uint64(32 * half)) & np.uint64((1 << CODE_BITS) - 1)
        syndrome = sum(((np.bitwise_count(part & check) & 1).astype(np.int64) << k) for k, check in enumerate(CHECKS))
        near = part[:, None] ^ FLIPS[syndrome] | np.uint64(half << CODE_BITS)
        near[syndrome == 0, 1:] = near[syndrome == 0, :1]
        one = np.ones(near.shape, bool)
        one[syndrome == 0, 1:] = False  # a code word has itself alone
        keys.append(near[one])
        whom.append(np.repeat(fps, one.sum(1)))
    return np.concatenate(keys), np.concatenate(whom)


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, fp = anchors(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["anchor", "fp"])


def _forest(members: np.ndarray, distance: int) -> tuple[list, list]:
    """Spanning links of the members within ``distance`` of each other."""
    a, b, rest = [], [], members
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                got = rest[near]
                a += [x] * len(got)
                b += got.tolist()
                todo += list(got)
                rest = rest[~near]
    return a, b


def link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each anchor, from rows sorted by anchor."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        size = np.diff(edge)
        a, b = [], []
        of_row = np.repeat(size, size)
        few = (of_row > 1) & (of_row <= FEW)
        k, f = key[few], fp[few]
        for lag in range(1, FEW):
            i = np.flatnonzero((k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)) if len(k) > lag else np.zeros(0, int)
            a.append(f[i])
            b.append(f[i + lag])
        for at in np.flatnonzero(size > FEW):
            x, y = _forest(fp[edge[at] : edge[at + 1]], distance)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        pairs = np.stack([np.concatenate(x) for x in (a, b)], 1) if a else np.zeros((0, 2), np.uint64)
        pairs = np.unique(np.sort(pairs.view(np.int64), axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        done = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last anchor may go on
        if done:
            yield linked(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    yield linked(keys, fps)


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that span the families of distinct fingerprints (fp)."""
    near = distinct.select("fp").mapInArrow(anchor_batches, "anchor long, fp long")
    near = near.repartition(shuffle_partitions(distinct.sparkSession), "anchor").sortWithinPartitions("anchor", "fp")
    return near.mapInArrow(lambda x: link_batches(x, distance), "a long, b long")


def families(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id) from (doc_id, fp): the smallest doc_id that links lead to."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(fingerprint_links(distinct, distance), "near")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    return prints.join(materialize(families(prints, distance), "families"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
