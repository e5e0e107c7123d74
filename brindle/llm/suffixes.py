"""Suffix-array de-duplication of long byte strings.

Suffixes are sorted by a merge sort that compares two of them through prefix
polynomial hashes: a binary search finds how far they agree, so a comparison
takes logarithmically many steps, and neighbours that agree over a whole
window are then verified byte by byte.

Sorting every suffix of the corpus would move each byte many times; so
suffixes are first brought together by an anchor (see ``windows``). Stretches
around one anchor whose prefix hashes agree over their whole length have that
as their common extension; they are settled by it, and verified by a 128-bit
digest of their bytes, read again in place. The suffixes of stretches that
share an anchor and differ somewhere are sorted, in buckets, where windows
whose hash nothing in the bucket shares are left out first. Where a hash turns
out to have collided, bytes are compared instead.

A byte is removed if a string of 50 bytes over it also starts in a document
with a smaller doc_id, judged on the input. Defined cases: a null text counts
as empty; texts under 50 bytes keep all; rows with one doc_id do not remove
each other's bytes; a row with a null doc_id neither loses nor causes a loss.
An empty table gives an empty result. Extra columns are ignored by the query
and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import lean, materialize, release_shuffles, shuffle_partitions, table
from brindle.llm.windows import CHECKS, COVERED, KEY, OPEN, Units, by_gram, check_columns, digests, judged, lists, place, powers, prefix_hashes, role_of, send_open, stretch_hashes, tagged, verified, with_places

WINDOW = 50
#: Bits of prefix hashes that comparisons look at; fewer only in tests, to make collisions.
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BYTES = Units(WINDOW, 16, False, lambda text: text, lambda text: np.frombuffer(text, np.uint8).astype(np.uint64), bytes)


class Suffixes:
    """Suffixes of one buffer, compared over at most ``limit`` bytes."""

    def __init__(self, buffer: np.ndarray, limit: int):
        self.buffer, self.limit = buffer, limit
        self.prefix, self.inverse = prefix_hashes(buffer.astype(np.uint64)), powers(len(buffer) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes agree, by binary search over hashes of prefixes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.limit)
        pa_, pb, ia, ib = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = ((self.prefix[a + mid] - pa_) * ia ^ (self.prefix[b + mid] - pb) * ib) & MASK == 0
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def order(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Indices that sort each segment (its first index and size, by element) of suffixes ``at``."""
        idx, local, run = np.arange(len(at)), np.arange(len(at)) - first, 1
        while run < size.max(initial=1):
            which = local // run
            other = (which ^ 1) * run
            many = np.clip(size - other, 0, run)
            todo = np.flatnonzero(many > 0)
            new = first + which // 2 * 2 * run + local % run
            lo, hi = np.zeros(len(todo), np.int64), many[todo]
            right = which[todo] & 1
            while len(active := np.flatnonzero(lo < hi)):
                mid = (lo[active] + hi[active]) >> 1
                own = todo[active]
                a, b = at[idx[own]], at[idx[first[own] + other[own] + mid]]
                n = self.common(a, b)
                whole = n == self.limit
                n = np.minimum(n, self.limit - 1)
                x, y = self.buffer[a + n], self.buffer[b + n]
                before = np.where(whole, right[active] == 1, y < x)  # the other one comes first; equal ones keep their order
                lo[active], hi[active] = np.where(before, mid + 1, lo[active]), np.where(before, hi[active], mid)
            new[todo] += lo
            moved = np.empty_like(idx)
            moved[new] = idx
            idx, run = moved, run * 2
        return idx

    def equal(self, a: np.ndarray, b: np.ndarray, rows: int = 65_536) -> tuple[np.ndarray, bool]:
        """Whether whole windows are equal: by hash, then verified byte by byte; and whether a hash collided."""
        out = self.common(a, b) == self.limit
        maybe, step = np.flatnonzero(out), np.arange(self.limit)
        for i in range(0, len(maybe), rows):
            m = maybe[i : i + rows]
            out[m] = (self.buffer[a[m][:, None] + step] == self.buffer[b[m][:, None] + step]).all(1)
        return out, not out[maybe].all()

    def order_by_bytes(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices that sort each segment, and whether each equals the one before it, without hashes."""
        keys = [(f, self.buffer[i : i + self.limit].tobytes()) for f, i in zip(first.tolist(), at.tolist())]
        idx = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        return idx, np.array([False, *(keys[i] == keys[j] for i, j in zip(idx, idx[1:]))])


def covered_windows(gram: np.ndarray, doc: np.ndarray, at: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """For each piece a bit for each of its windows that also starts in a smaller document."""
    _, offset, windows, _ = place(at)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    base = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    piece = np.repeat(np.arange(len(pieces)), windows)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    _, rank = np.unique(gram, return_inverse=True)
    bucket = rank[piece] * 128 + offset[piece] - nth  # equal windows have the anchor at one place
    suffixes, where = Suffixes(buffer, WINDOW), base[piece] + nth
    whole = stretch_hashes(suffixes.prefix, where, where + WINDOW)
    order = np.lexsort((whole, bucket))
    runs = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (whole[order][1:] != whole[order][:-1])]) if len(order) else np.zeros(0, bool)
    heads, own = np.flatnonzero(runs), doc[piece[order]]
    between = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads) if len(heads) else runs
    order = order[between[np.cumsum(runs) - 1]] if len(heads) else order  # others have no equal in another document
    if not len(order):
        return np.zeros(len(pieces), np.int64)
    piece, nth, bucket, where = piece[order], nth[order], bucket[order], where[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(heads, len(piece)))
    first, size = np.repeat(heads, size), np.repeat(size, size)
    idx = suffixes.order(where, first, size)
    same, collided = np.zeros(len(idx), bool), False
    same[1:], collided = suffixes.equal(where[idx][1:], where[idx][:-1])
    same[1:] &= first[idx][1:] == first[idx][:-1]
    if collided:
        idx, same = suffixes.order_by_bytes(where, first)
    starts = np.flatnonzero(~same)
    low = np.repeat(np.minimum.reduceat(doc[piece[idx]], starts), np.diff(np.append(starts, len(idx))))
    hit = idx[doc[piece[idx]] > low]
    out = np.zeros(len(pieces), np.int64)
    np.bitwise_or.at(out, piece[hit], np.int64(1) << nth[hit])
    return out


@lean
def compare_batches(batches: Iterator[pa.RecordBatch], most: int = 16_384) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, at, covered) of the pieces of which some windows are covered, from rows sorted by gram."""
    for t in by_gram(batches, most):
        gram, doc, at = (t.column(c).to_numpy() for c in ("gram", "doc_id", "at"))
        bits = covered_windows(gram, doc, at, t.column("piece").to_pylist())
        keep = bits != 0
        yield pa.record_batch([pa.array(doc[keep]), pa.array(t.column("tag").to_numpy()[keep]), pa.array(at[keep]), pa.array(bits[keep])], names=["doc_id", "tag", "at", "covered"])


def removed_mask(n: int, ats: np.ndarray, open_ats: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` units are removed."""
    edge = np.zeros(n + 1, np.int32)
    start, _, windows, role = place(ats)
    whole = role == COVERED
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, start[whole] + windows[whole] - 1 + window, -1)
    if len(open_ats):
        start = open_ats >> 20
        which, nth = np.nonzero(bits[:, None] >> np.arange(64) & 1)
        np.add.at(edge, start[which] + nth, 1)
        np.add.at(edge, start[which] + nth + window, -1)
    return np.cumsum(edge[:-1]) > 0


def whole_characters(raw: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without the characters of which it has only some bytes."""
    if not len(raw):
        return mask
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    char = char - char[0]
    return (np.bincount(char, mask) == np.bincount(char))[char]


def judged_rows(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray], list[pa.Array]]]:
    """(rows, texts, masks of removed bytes, columns of ``CHECKS``), a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            texts, masks, paths, found = part.column("text").to_pylist(), [], [], []
            for text, ats, own, open_ats, bits in zip(texts, *(lists(part.column(c)) for c in ("ats", "paths", "open_ats", "bits"))):
                masks.append(removed_mask(len(text), ats, open_ats, bits, WINDOW))
                start, _, windows, role = place(ats)
                settled = role != OPEN
                paths.append(own[settled])
                found.append(digests([text[a:b] for a, b in zip(start[settled].tolist(), (start + windows - 1 + WINDOW)[settled].tolist())]))
            yield part, texts, masks, check_columns(paths, found)


@lean
def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in f"{DIGESTS}, {CHECKS}".split(", ")]
    for part, texts, masks, checks in judged_rows(batches):
        kept = [hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest() for t, m in zip(texts, masks)]
        spans = [int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) for m in masks]
        cols = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), [int(m.sum()) for m in masks], spans)), pa.array(kept, pa.string())]
        yield pa.record_batch([*cols, *checks], names=names)


@lean
def clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts, masks, checks in judged_rows(batches):
        kept = []
        for text, mask in zip(texts, masks):
            raw = np.frombuffer(text, np.uint8)
            kept.append(raw[~whole_characters(raw, mask)].tobytes())
        yield pa.record_batch([part.column("rest"), pa.array(kept, pa.binary()), *checks], names=["rest", "kept", "paths", "lows", "highs"])


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeats(docs: DataFrame, suspects: DataFrame | None = None, carried: list[str] = (), units: Units = BYTES) -> DataFrame:
    """(doc_id, tag, text, ats, paths, open_ats, bits), and ``carried`` columns in ``rest``, for every row: what is covered in it."""
    known = judged(tagged(docs), units, suspects)
    found = compared(docs, known, units)
    state = with_places(tagged(docs, carried), known.where(role_of() != OPEN))
    found = found.groupBy(*KEY).agg(F.collect_list("at").alias("open_ats"), F.collect_list("covered").alias("bits"))
    return state.join(found, KEY, "left").select(*state.columns, "open_ats", "bits")


def compared(docs: DataFrame, known: DataFrame, units: Units) -> DataFrame:
    """(doc_id, tag, at, covered) of the open pieces of which some windows are covered.

    A table of its own: the texts are dealt out once more for what follows, but
    by then the shuffles of the open pieces, far larger than their outcome, are gone.
    """
    n = shuffle_partitions(docs.sparkSession)
    asked = with_places(tagged(docs), known.where(role_of() == OPEN), "inner")
    sent = asked.mapInArrow(lambda x: send_open(x, units), "gram long, doc_id long, tag long, at long, piece binary")
    found = materialize(sent.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(compare_batches, "doc_id long, tag long, at long, covered long"), "compared")
    del asked, sent
    release_shuffles(docs.sparkSession)
    return found


def removed(docs: DataFrame, units: Units = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return verified(docs.sparkSession, lambda suspects: (repeats(docs, suspects, units=units).mapInArrow(digest_batches, f"{DIGESTS}, {CHECKS}"), lambda wrong: wrong), "removed")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings cut out of ``text``, only whole characters; n_chars, if there, follows."""
    rest = [c for c in docs.columns if c != "text"]
    kind = tagged(docs.limit(0), rest).schema["rest"].dataType.simpleString()
    schema = f"rest {kind}, kept binary, {CHECKS}"
    out = verified(docs.sparkSession, lambda suspects: (repeats(docs, suspects, rest).mapInArrow(clean_batches, schema), lambda wrong: wrong), "cleaned")
    kept = F.col("kept").cast("string")
    cut = {c: F.col(f"rest.own.`{c}`") for c in rest} | {"text": F.when(~F.col("rest.absent"), kept)}
    if "n_chars" in rest:
        cut["n_chars"] = F.when(F.col("doc_id").isNull(), cut["n_chars"]).otherwise(F.coalesce(F.length(kept), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    out = out.withColumn("doc_id", F.col("rest.own.doc_id"))
    return out.select(*[cut[c].alias(c) for c in docs.columns])


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
bytes AS (SELECT doc_id, unnest(b) AS byte, generate_subscripts(b, 1) AS i FROM d),
windows AS (SELECT doc_id, i, byte, CASE WHEN count(*) OVER near = 50 THEN string_agg(byte, '') OVER near END AS w FROM bytes WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
judged AS (SELECT doc_id, i, byte, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS starts FROM windows),
marked AS (SELECT doc_id, i, byte, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged),
turned AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS span FROM marked),
docs AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (span) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM turned GROUP BY doc_id)
SELECT d.doc_id, CAST(len(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN docs USING (doc_id)
"""
