"""Near-duplicate texts for a corpus pipeline: SimHash families, then an exact search.

Texts count as near copies at a Jaccard similarity of 0.8 or more of their
sets of five-word shingles. A 64-bit SimHash fingerprint of the set serves
twice. First the anchor search of ``simhash`` brings together the texts whose
fingerprints differ in at most 3 bits, and the links it spans are verified on
the texts. But at a similarity of 0.8 fingerprints differ in about 10 bits, so
what that search leaves is searched exactly: texts that similar share one of
the first n - ceil(0.8 n) + 1 of their n shingles, whatever order all shingles
are put in (prefix filter), so each text is sent to those shingles alone. The
order puts the shingles that are common in the corpus, counted over all texts,
last; it decides how much meets and never what is found. Of two texts that
meet, those whose fingerprints differ in over 28 bits are no near copies (at a
similarity of 0.8 that has a probability under one in ten million; texts of
few shingles, whose fingerprints are coarse, are exempt).

What meets is verified on the shingles of the whole texts BEFORE anything is
thinned: similarity is not transitive, so a pair is left out only if links
already verified join the two. The first rounds compare one text at each
shingle with the others there, to join large families by few pairs; the last
compares all that is still in different families.

Equal texts are one before the search. Defined cases: null and blank texts
have no shingles and are near copies of each other; rows with a null doc_id
take no part and stay; of repeated rows one stays; a doc_id with several texts
stands for all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, components, lean, materialize, shuffle_partitions, temporary
from brindle.llm.simhash import DISTANCE, PIPELINE_SHINGLE_WORDS, fingerprint_links, majority

SIMILARITY = 0.8
#: Rounds that compare one text of each shingle before the one that compares all.
THIN_ROUNDS = 2
#: Shingles that are remembered as common, and the hashes that a task counts together.
COMMON, COUNTED = 1 << 16, 1 << 21
#: Bits in which fingerprints of near copies differ at most, and from how many shingles on that is asked.
BITS, COARSE = 28, 32
#: Against the rounding of products with the similarity; bounds may only be too loose.
SLACK = 1e-9
#: Word hashes remembered, pairs held, and rows of a key that are compared lag by lag.
WORDS_HELD, PAIRS_HELD, FEW = 1 << 17, 1 << 20, 32
PREFIX = "key long, doc_id long, size int, rest int, fp long"
NAMES = [x.split()[0] for x in PREFIX.split(", ")]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hashed_shingles(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    found = (text or b"").lower().split()
    w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    count = max(1, len(w) - words + 1) if len(w) else 0
    h = np.zeros(count, np.uint64)
    for j in range(min(words, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + count]
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ h >> np.uint64(29))


@lean
def print_batches(batches: Iterator[pa.RecordBatch], words: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows (of_key, id, n): fingerprints of texts by doc_id, and how often shingles recur by key."""
    known, met, size = WordHashes(), [], 0

    def counted() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        again = n > 1
        return pa.record_batch([pa.array(np.ones(again.sum(), bool)), pa.array(key[again].view(np.int64)), pa.array(n[again].astype(np.int64))], names=["of_key", "id", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            each = [hashed_shingles(t.as_py(), words, known) for t in part.column(1)]
            sizes = np.array([len(h) for h in each], np.int64)
            flat = np.concatenate(each)
            yield pa.record_batch([pa.array(np.zeros(len(each), bool)), part.column(0), pa.array(majority(flat, sizes).view(np.int64))], names=["of_key", "id", "n"])
            met.append(flat)
            size += len(flat)
            if size >= COUNTED:
                yield counted()
                met, size = [], 0
    yield counted()


@lean
def prefix_batches(batches: Iterator[pa.RecordBatch], words: int, similarity: float, common: np.ndarray, often: np.ndarray, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The prefix of each text, with the number of its shingles, of those after this one, and the text's fingerprint."""
    known = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            keys, sizes, rests = [], [], []
            each = [hashed_shingles(t.as_py(), words, known) for t in part.column(1)]
            prints = majority(np.concatenate(each), np.array([len(h) for h in each], np.int64)).view(np.int64)
            for h in each:
                n = len(h)
                if len(common) and n:
                    i = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[i] == h, often[i], 0), kind="stable")]
                keys.append(h[: n - ceil(similarity * n - SLACK) + 1] if n else np.zeros(1, np.uint64))  # blank texts meet at 0
                sizes.append(n)
                rests.append(n - 1 - np.arange(len(keys[-1])))
            took = [len(k) for k in keys]
            cols = (np.concatenate(keys).view(np.int64), np.repeat(part.column(0).to_numpy(), took), np.repeat(sizes, took).astype(np.int32), np.concatenate(rests).astype(np.int32), np.repeat(prints, took))
            yield pa.record_batch([pa.array(c) for c in cols], names=NAMES)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, cut only between its values."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on
        if done:
            yield [x[:done] for x in held]
            held = [x[done:] for x in held]
    if held is not None and len(held[0]):
        yield held


@lean
def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key others have too."""
    for cols in whole_keys(batches):
        same = cols[0][1:] == cols[0][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.record_batch([pa.array(c[keep]) for c in cols], names=NAMES)


@lean
def pair_batches(batches: Iterator[pa.RecordBatch], similarity: float, leader: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs that may be near copies, of different families, from rows (key, root, doc_id, size, rest, fp) sorted by key, root, doc_id.

    leader k: only the first row of a key's family k with the rows of later
    families; None: all with all. A pair whose first common shingle this is has
    at most the rest of either text in common, so what cannot reach the
    similarity by it meets elsewhere or never. Families are runs of rows, so a
    key that one family fills costs nothing, and a large family of a key is
    compared only with the rows outside it.
    """
    out, held = [], 0

    def give() -> pa.RecordBatch:
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    for key, root, ids, size, rest, fp in whole_keys(batches):
        fp = fp.view(np.uint64)

        def add(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            most = np.minimum(rest[i], rest[j]) + 1  # noqa: B023
            both = size[i].astype(np.int64) + size[j]  # noqa: B023
            may = (root[i] != root[j]) & (ids[i] != ids[j]) & ((1 + similarity) * most >= similarity * both - SLACK)  # noqa: B023
            may &= (np.bitwise_count(fp[i] ^ fp[j]) <= BITS) | (np.minimum(size[i], size[j]) < COARSE)  # noqa: B023
            i, j = i[may], j[may]
            if len(i):
                out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))  # noqa: B023
                held += len(i)

        begins = np.concatenate([[True], key[1:] != key[:-1]])
        turns = begins | np.concatenate([[True], root[1:] != root[:-1]])
        number = np.cumsum(begins) - 1
        several = np.bincount(number, turns)[number] > 1  # other keys are of one family
        key, root, ids, size, rest, fp, begins, turns = (x[several] for x in (key, root, ids, size, rest, fp, begins, turns))
        if not len(key):
            continue
        heads = np.flatnonzero(begins)
        lengths = np.diff(np.append(heads, len(key)))
        if leader is not None:
            family = np.cumsum(turns)
            family -= np.repeat(family[heads], lengths)
            firsts = np.flatnonzero(turns & (family == leader))
            later = np.flatnonzero(family > leader)
            add(firsts[np.searchsorted(key[firsts], key[later])], later)
            if held >= PAIRS_HELD:
                yield give()
                out, held = [], 0
            continue
        small = np.repeat(lengths <= FEW, lengths)
        i = np.flatnonzero(small)
        for lag in range(1, FEW):
            i = i[i + lag < len(key)]
            i = i[key[i] == key[i + lag]]
            add(i, i + lag)
        for at, n in zip(heads[lengths > FEW].tolist(), lengths[lengths > FEW].tolist()):
            rows = np.arange(at, at + n)
            runs = np.flatnonzero(turns[at : at + n])
            widths = np.diff(np.append(runs, n))
            big = at + runs[widths.argmax()]
            inside = (rows >= big) & (rows < big + widths.max())
            for k in rows[~inside]:
                add(np.full(n, k), np.where(inside | (rows > k), rows, k))  # a row with itself is no pair
                if held >= PAIRS_HELD:
                    yield give()
                    out, held = [], 0
    yield give()


@lean
def alike_batches(batches: Iterator[pa.RecordBatch], words: int, similarity: float, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts have similar sets of shingles."""
    known = WordHashes()
    for batch in batches:
        keep, last = [], [(None, None), (None, None)]
        for i in range(0, batch.num_rows, rows):
            for pair in zip(*(batch.column(c).slice(i, rows).to_pylist() for c in ("ta", "tb"))):
                last = [was if was[1] is not None and was[0] == t else (t, hashed_shingles(t, words, known)) for t, was in zip(pair, last)]
                own, other = last[0][1], last[1][1]
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both >= similarity * (len(own) + len(other) - both) - SLACK)
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids that are near copies, on their whole texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    kin = materialize(texts.join(ends, "doc_id", "left_semi"), "kin")
    side = lambda name: kin.select(F.col("doc_id").alias(name), F.col("raw").alias(f"t{name}"))
    laid = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return materialize(laid.mapInArrow(lambda x: alike_batches(x, words, similarity), "a long, b long"), "links")


def near_links(texts: DataFrame, words: int = PIPELINE_SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that span the families of (doc_id, raw)."""
    spark = texts.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    seen = materialize(texts.mapInArrow(lambda x: print_batches(x, words), "of_key boolean, id long, n long"), "prints")
    prints = seen.where(~F.col("of_key")).select(F.col("id").alias("doc_id"), F.col("n").alias("fp"))
    top = seen.where("of_key").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(COMMON).toArrow()  # bounded; orders the shingles
    common = top.column("id").to_numpy().astype(np.int64).view(np.uint64)
    often = top.column("n").to_numpy()[np.argsort(common)]
    common = np.sort(common)

    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts_of_prints")
    same = prints.join(firsts, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    ends = fingerprint_links(firsts.select("fp"), DISTANCE)
    across = ends.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    checked = materialize(same.union(across).distinct(), "pairs")
    links = verified(checked, texts, words, similarity)

    prefixes = texts.mapInArrow(lambda x: prefix_batches(x, words, similarity, common, often), PREFIX)
    shared = materialize(prefixes.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(shared_batches, PREFIX), "shared")
    for leader in [*range(THIN_ROUNDS), None]:
        roots = materialize(components(links, "links"), "roots").withColumnRenamed("node", "doc_id")
        rows = shared.join(roots, "doc_id", "left").select("key", F.coalesce("root", "doc_id").alias("root"), "doc_id", "size", "rest", "fp")
        rows = rows.repartition(parts, "key").sortWithinPartitions("key", "root", "doc_id")
        pairs = rows.mapInArrow(lambda x: pair_batches(x, similarity, leader), "a long, b long").distinct()  # noqa: B023
        pairs = materialize(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        links, checked = links.union(verified(pairs, texts, words, similarity)), checked.union(pairs)
    return links


def one_of_each(docs: DataFrame, words: int = PIPELINE_SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which no near copy has a smaller doc_id, by families."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    digest = F.unhex(F.md5(raw))
    known = docs.where("doc_id is not null")
    with temporary(docs.sparkSession):
        firsts = materialize(known.select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "firsts")
        texts = known.select("doc_id", raw.alias("raw"), digest.alias("digest")).join(firsts, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("doc_id", "raw")
        links = near_links(materialize(texts, "texts"), words, similarity)
        later = components(links, "links").where("node <> root").select(F.col("node").alias("doc_id"))
        keep = materialize(firsts.join(later, "doc_id", "left_anti"), "kept", stay=True)
    own = docs.columns
    out = known.withColumn("_digest", digest).join(keep.withColumnRenamed("digest", "_digest"), ["doc_id", "_digest"], "left_semi")
    return out.dropDuplicates(["doc_id", "_digest"]).select(*own).unionByName(docs.where("doc_id is null"))
