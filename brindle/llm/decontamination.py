"""Benchmark decontamination by spaced seeds.

Fixed masks look at some positions of a stretch of words and ignore the
others, so a passage is found though some of its words were replaced. The
hashes of every position of the benchmark under every mask are joined with
those of every position of the corpus; around each hit the item is laid over
the text word by word, and the pair counts if some stretch of ``STRETCH``
words (the whole item, if it is shorter) has at least ``SHARE`` equal words.

Words are maximal runs of letters and digits, lower-cased. The benchmark goes
to the executors in blocks of at most ``BLOCK_CHARS`` characters, each block
against all documents, so what is broadcast is bounded however large it is.

Items of under ``STRETCH`` words have lighter masks of their own, which find
every item of 4 words or more with a fifth of its words replaced. A text and an
item that repeat one word meet everywhere; such meetings are counted by where
they lay the item, a bounded number at a time.

Defined cases: null and empty texts match nothing, nor do items of under 4
words. Repeated rows are reported each; a null
doc_id is reported as null. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, table

#: 1: the word counts, 0: it is ignored.
MASKS = ("11111", "1101011", "110010011", "10110101", "1010010011")
#: For items of under ``STRETCH`` words: one word in five may differ, wherever it stands.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
STRETCH, SHARE = 13, 0.8
BLOCK_CHARS = 8_000_000
#: Meetings of a text with items that are laid out at once.
AT_ONCE = 1 << 20
WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, start_word long, n_words long, n_equal long, n_seeds long"
BASE = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """0 for any word that no item has."""

    def __missing__(self, word: str) -> int:
        return 0


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) where every word that the mask looks at is known."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, known = offsets(mask), np.ones(n, bool)
    for o in at:
        known &= ids[o : o + n] > 0
    where = np.flatnonzero(known)
    out = np.zeros(len(where), np.uint64)
    for o in at:
        out = (out + ids[where + o].astype(np.uint64)) * BASE
        out ^= out >> np.uint64(29)
    return where, out


class Block:
    """Seeds of some items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words, self.item_ids, parts, begins, at = Numbers(), [], [], [], 0
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in WORD.findall((text or "").lower())]
            self.item_ids.append(item)
            parts.append(np.array([*ids, *[0] * 16], np.int64))  # no seed crosses items
            begins.append((at, len(ids)))
            at += len(parts[-1])
        self.ids, self.begins = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(begins, np.int64).reshape(-1, 2)
        short = np.concatenate([np.full(len(p), n < STRETCH) for p, (_, n) in zip(parts, begins)]) if parts else np.zeros(0, bool)
        self.seeds = []
        for mask, few in [*((m, False) for m in MASKS), *((m, True) for m in SHORT_MASKS)]:
            where, hashes = seeds(self.ids, mask)
            if few:
                where, hashes = where[short[where]], hashes[short[where]]
            if not len(where):
                continue
            order = np.argsort(hashes, kind="stable")
            hint = np.zeros(1 << 20, bool)
            hint[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((mask, hashes[order], where[order], hint))

    def meetings(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Mask by mask (positions in ``ids``, first and number of equal seeds, their positions in the items)."""
        for mask, hashes, where, hint in self.seeds:
            at, found = seeds(ids, mask)
            maybe = hint[(found >> np.uint64(44)).astype(np.int64)]
            at, found = at[maybe], found[maybe]
            lo, hi = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            some = hi > lo
            yield at[some], lo[some], (hi - lo)[some], where

    def laid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, where its first word would be) of all meetings, and how many seeds agree on each."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, lo, n, where in self.meetings(ids):
            ends = np.cumsum(n)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                number = np.arange(begin, min(begin + AT_ONCE, int(ends[-1])))
                each = np.searchsorted(ends, number, "right")
                place = where[lo[each] + number - (ends - n)[each]]
                item = np.searchsorted(self.begins[:, 0], place, "right") - 1
                got, many = np.unique(item << 36 | at[each] - place + self.begins[item, 0] + (1 << 35), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, many])).astype(np.int64)
        return np.stack([keys >> 36, (keys & (1 << 36) - 1) - (1 << 35)], 1), counts

    def verified(self, ids: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start, words, equal, seeds) of the best place of each item in one text."""
        laid, many = self.laid(ids)
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for (i, start), n in zip(laid.tolist(), many.tolist()):
            begin, size = self.begins[i].tolist()
            lo, hi = max(0, start), min(len(ids), start + size)
            equal = ids[lo:hi] == self.ids[begin + lo - start : begin + hi - start]
            stretch = min(STRETCH, size)
            if hi - lo < stretch:
                continue
            sums = np.concatenate([[0], np.cumsum(equal)])
            if (sums[stretch:] - sums[:-stretch]).max() >= SHARE * stretch:
                got = (self.item_ids[i], lo, hi - lo, int(equal.sum()), n)
                if got[3] > best.get(i, (0, 0, 0, -1, 0))[3]:
                    best[i] = got
        return list(best.values())


def search_batches(batches: Iterator[pa.RecordBatch], block: Block, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Texts of a few rows are numbered and searched as one, then verified one by one."""
    number, gap = block.words.__getitem__, [0] * max(map(len, MASKS))
    types = (pa.int64(),) * 6
    names = [x.split()[0] for x in FOUND.split(", ")]
    for batch in batches:
        out: dict[str, list] = defaultdict(list)
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            each = [list(map(number, WORD.findall(t.lower()))) if t else [] for t in part.column(1).to_pylist()]
            flat = np.array([x for ids in each for x in (*ids, *gap)], np.int64)
            ends = np.cumsum([len(x) + len(gap) for x in each])
            met = [a for a, *_ in block.meetings(flat)]
            for k in np.unique(np.searchsorted(ends, np.concatenate(met), "right")) if met else ():
                for row in block.verified(np.array(each[k], np.int64)):
                    for name, value in zip(names, (part.column(0)[int(k)].as_py(), *row)):
                        out[name].append(value)
        yield pa.record_batch([pa.array(out[n], t) for n, t in zip(names, types)], names=names)


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ``block_chars`` characters at a time."""
    items = benchmark.where("text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // block_chars
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item whose words overlap, with the best place."""
    bounded_batches(docs.sparkSession)
    sc, found = docs.sparkSession.sparkContext, None
    for items in blocks_of(benchmark, block_chars):
        shared = sc.broadcast(Block(items))
        got = docs.select("doc_id", "text").mapInArrow(lambda x, shared=shared: search_batches(x, shared.value), FOUND)
        found = got if found is None else found.unionByName(got)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all their columns, that overlap with no item."""
    bounded_batches(docs.sparkSession)
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for items in blocks_of(benchmark, block_chars):
        shared = sc.broadcast(Block(items))

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
                hit = np.zeros(batch.num_rows, bool)
                for found in search_batches(iter([rows]), shared.value):
                    hit[found.column(0).to_numpy()] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
