"""Packing documents into sequences: dominance reduction, then best fit.

The instance that is solved is the histogram of piece lengths, which has at
most one row a length whatever the number of documents. Its solution is a list
of patterns (lengths that share a sequence, and how many such sequences);
pieces of one length are then numbered and the numbers dealt to the patterns.

``plan`` first fixes what is provably best (Martello and Toth): take the
longest piece j and the longest piece k that still fits beside it. The pair
dominates every other sequence with j if k fills it exactly, or if no two
pieces fit beside j; so it is fixed, all its copies at once, and the instance
shrinks. What this does not settle is packed by best fit in descending order.

Defined cases: a null text counts as empty; an empty text is one piece, the
end id alone. Rows with the same doc_id are documents of their own. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, lean, materialize, numbered, salt_of, table

CAPACITY = 1024
END_ID = 2
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
NUMBERING_BUCKETS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The tokenizer and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class ByteIds(dict):
    """The ids, as little-endian unsigned 32-bit bytes, of a blank and a word.

    A blank with something other than white space on one side always starts a
    new unit of the tokenizer, so a text's ids are those of its first word and
    of each blank with the word behind it; words recur, their ids are kept.
    """

    BLANKS = re.compile(r"\s \s")
    SPECIAL = "<|endoftext|>"

    def __init__(self, json_file: str, ranks_file: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(ranks_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_file, self.remembered = json_file, remembered

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, for texts with its special string; most workers never meet one."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_file)

    def __missing__(self, word: str) -> bytes:
        got = self[word] = array("I", self.encode(" " + word)).tobytes()
        return got

    def of(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.BLANKS.search(text):
            return array("I", self.encode(text)).tobytes()
        if len(self) > self.remembered:
            self.clear()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def byte_ids(json_file: str, ranks_file: str) -> ByteIds:
    return ByteIds(json_file, ranks_file)


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a few rows at a time; a null text is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]


@lean
def cut(batches: Iterator[pa.RecordBatch], files: tuple[str, str], capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    ids_of, end = byte_ids(*files), array("I", [end_id]).tobytes()
    for doc_ids, some in texts(batches):
        rows = []
        for doc, text in zip(doc_ids, some):
            ids = ids_of.of(text) + end
            n = len(ids) // 4
            first = n if n <= capacity else n % capacity or capacity
            edges = [0, *range(first, n + 1, capacity)]
            rows += [(doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def reduce_dominated(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sequences and take their pieces out of ``left``, a count for each length."""
    fixed = []
    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            left[j] -= 1
            fits = [s for s in range(1, room + 1) if left[s]]
            left[j] += 1
            if not fits:
                fixed.append(((j,), left[j]))
                left[j] = 0
                continue
            k = fits[-1]
            two = fits[0] + (fits[0] if left[fits[0]] - (fits[0] == j) > 1 else fits[1] if len(fits) > 1 else capacity)
            if k != room and two <= room:
                break
            n = left[j] // 2 if k == j else min(left[j], left[k])
            fixed.append(((j, k), n))
            left[j] -= n
            left[k] -= n
    return fixed


def best_fit(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending order, all alike pieces and sequences at a time."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for s in range(capacity, 0, -1):
        n = left[s]
        while n:
            room = next((r for r in range(s, capacity) if open_[r]), capacity)
            pattern, m = open_[room].pop() if room < capacity else ((), n)
            each = min(room // s, n)
            many = min(m, n // each)
            if m > many and room < capacity:
                open_[room].append((pattern, m - many))
            open_[room - each * s].append((pattern + (s,) * each, many))
            n -= each * many
    return [x for same in open_ for x in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences)."""
    left = [counts.get(s, 0) for s in range(capacity + 1)]
    return [x for x in reduce_dominated(left, capacity) + best_fit(left, capacity) if x[1]]


def deals(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length: first number dealt, first sequence and offset, by rising number."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    dealt = [0] * (capacity + 1)
    sequence = 0
    for pattern, many in patterns:
        offset = 0
        for s in pattern:
            found.setdefault(s, []).append((dealt[s], sequence, offset))
            dealt[s] += many
            offset += s
        sequence += many
    return {s: np.array(x, np.int64) for s, x in found.items()}


def place(batches: Iterator[pa.RecordBatch], by_length: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
        sequence, offset = np.empty_like(number), np.empty_like(number)
        for s in np.unique(length):
            own = length == s
            first, base, at = by_length[int(s)].T
            i = np.searchsorted(first, number[own], "right") - 1
            sequence[own], offset[own] = base[i] + number[own] - first[i], at[i]
        names = batch.schema.names[:5]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and place in it."""
    files = files or tokenizer_files()
    bounded_batches(docs.sparkSession)
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(lambda x: cut(x, files, capacity, end_id), PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row a length
    by_length = deals(plan(counts, capacity), capacity)
    order = [F.col("doc_id"), F.col("piece")]
    ranked = numbered(pieces, ["length"], order, salt_of("doc_id", "piece", buckets=NUMBERING_BUCKETS), NUMBERING_BUCKETS, "number")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(lambda x: place(x, by_length), PLACED)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
