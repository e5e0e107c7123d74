"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of itself and of its character 3- to
5-grams, hashed into one table, so a misspelling shares most of its vector
with the word it hides. A passage (some words in a row, overlapping by half)
is the average of its words; a linear softmax gives its two classes, and the
document is as toxic as its worst passages (a log-sum of the exponentials:
nearly the maximum, and n passages alike raise it by log(n) / 8). Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled documents outside the
held-out fold; a linear model of averages needs one number a word to score.

Defined cases: a null text counts as empty; an empty text, without any word,
gets the score of the bias alone. Repeated rows are scored each. If a label is
missing from the sample, all scores are the share of label 1 there (0 without
any label). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import bounded_batches, table
from brindle.llm.labelled import Adam, held_out, learning_sample, sigmoid

#: At most so many labelled documents of label 0 and of label 1 are learned from.
SAMPLE = (2500, 1000)
BUCKETS, DIMS, GRAMS = 1 << 18, 8, (3, 4, 5)
PASSAGE, STEP = 16, 8
SHARPNESS, EPOCHS, RATE, DECAY = 8.0, 45, 0.08, 1e-5
REMEMBERED = 400_000
#: Words of the sample that are looked at together; bounds the memory of training.
PART = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, table row) for each of the words and of their n-grams, ends marked."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - first[owner]
    after = sizes[owner] - place  # characters from here to the end of the word
    who, rows, most = [np.arange(len(words))], [], int(sizes.max())
    power = np.cumprod(np.full(most, MIX))
    whole = np.add.reduceat(chars * power[place], first)
    rows.append(whole)
    run = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        run[: len(chars) - n + 1] = run[: len(chars) - n + 1] * MIX + chars[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(after >= n)
            who.append(owner[at])
            rows.append(run[at] ^ np.uint64(n))
    hashed = np.concatenate(rows)
    hashed = (hashed ^ hashed >> np.uint64(31)) * MIX
    return np.concatenate(who), (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of ``n`` words."""
    return np.arange(0, max(1, n - PASSAGE + STEP), STEP)


class Model:
    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score(self, words: np.ndarray) -> float:
        """The score of a text from its words' contributions."""
        if not len(words):
            return float(sigmoid(np.array(self.bias)))
        sums = np.concatenate([[0.0], np.cumsum(words)])
        start = passages(len(words))
        stop = np.minimum(start + PASSAGE, len(words))
        logits = (sums[stop] - sums[start]) / PASSAGE + self.bias
        top = logits.max()
        return float(sigmoid(top + np.log(np.exp(SHARPNESS * (logits - top)).sum()) / SHARPNESS))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), -60.0 if share == 0 else 60.0)
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    vocabulary, n_words, parts = list(known), len(known), []
    del known
    for i in range(0, n_words, PART):
        owner, flat = subwords(vocabulary[i : i + PART])
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner)
        parts.append((slice(i, i + len(sizes)), flat[order].astype(np.int32), np.cumsum(sizes) - sizes, sizes.astype(np.float32)))
    del vocabulary
    starts = [passages(len(d)) for d in docs]
    ends = np.cumsum([len(s) for s in starts])
    doc_first, at = ends - [len(s) for s in starts], np.cumsum([0, *(len(d) for d in docs)])
    lo = np.concatenate([a + np.minimum(s, len(d)) for a, s, d in zip(at, starts, docs)])
    hi = np.concatenate([a + np.minimum(s + PASSAGE, len(d)) for a, s, d in zip(at, starts, docs)])
    words = np.concatenate(docs)
    counts = np.diff(np.append(doc_first, ends[-1]))

    rng = np.random.default_rng(5)
    p = {"table": rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), "soft": rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    adam = Adam(p, RATE)
    weight = np.where(labels == 1, 0.35 / (labels == 1).sum(), 0.65 / (labels == 0).sum())
    for _ in range(epochs):
        line = p["soft"][:, 1] - p["soft"][:, 0]
        vectors = np.empty((n_words, DIMS), np.float32)
        for own, flat, firsts, sizes in parts:
            vectors[own] = np.add.reduceat(p["table"][flat], firsts, axis=0) / sizes[:, None]
        each = vectors @ line
        sums = np.concatenate([[0.0], np.cumsum(each[words], dtype=np.float64)])
        logits = (sums[hi] - sums[lo]) / PASSAGE + float(p["bias"][1] - p["bias"][0])
        top = np.maximum.reduceat(logits, doc_first)
        soft = np.exp(SHARPNESS * (logits - np.repeat(top, counts)))
        total = np.add.reduceat(soft, doc_first)
        error = (sigmoid(top + np.log(total) / SHARPNESS) - labels) * weight
        by_passage = np.repeat(error / total, counts) * soft
        # each word gets what the passages over it get
        change = np.zeros(len(words) + 1)
        np.add.at(change, lo, by_passage)
        np.subtract.at(change, hi, by_passage)
        by_word = np.bincount(words, np.cumsum(change)[:-1] / PASSAGE, n_words)
        d_line = by_word @ vectors
        column = np.zeros(BUCKETS)
        for own, flat, _, sizes in parts:
            column += np.bincount(flat, np.repeat(by_word[own] / sizes, sizes.astype(np.int64)), BUCKETS)
        column = column.astype(np.float32)
        d_bias = float(by_passage.sum())
        adam.step({"table": column[:, None] * line + DECAY * p["table"], "soft": np.stack([-d_line, d_line], 1).astype(np.float32), "bias": np.array([-d_bias, d_bias], np.float32)})
    line = p["soft"][:, 1] - p["soft"][:, 0]
    return Model(p["table"] @ line, float(p["bias"][1] - p["bias"][0]))


class Contributions(dict):
    """What each word adds; words not met before are worked out together."""

    def __init__(self, value: np.ndarray):
        self.value = value.astype(np.float64)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set().union(*texts).difference(self))
        if new:
            who, rows = subwords(new)
            self.update(zip(new, (np.bincount(who, self.value[rows]) / np.bincount(who)).tolist()))


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, rows: int = 128, known: Contributions | None = None) -> Iterator[pa.RecordBatch]:
    known = Contributions(model.value) if known is None else known
    for batch in batches:
        scores = []
        for at in range(0, batch.num_rows, rows):
            texts = [WORD.findall((t or "").lower()) for t in batch.column(1).slice(at, rows).to_pylist()]
            known.learn(texts)
            scores += [model.score(np.array(list(map(known.__getitem__, words)), np.float64)) for words in texts]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    return train(*learning_sample(docs, labels, label, sample))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) for every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(lambda x: score_batches(x, shared.value), "doc_id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, that score under ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    bounded_batches(docs.sparkSession)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Contributions(shared.value.value)
        for batch in batches:
            numbered = pa.record_batch([pa.nulls(batch.num_rows), batch.column(at), pa.nulls(batch.num_rows)], names=["doc_id", "text", "held_out"])
            for scores in score_batches(iter([numbered]), shared.value, known=known):
                yield batch.filter(pa.array(scores.column(2).to_numpy() < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, fit(docs, labels)).selectExpr("doc_id", "held_out", "score", "int(score >= 0.5) AS predicted")
