"""Quality: attention-based multiple-instance learning over passages.

A document is a bag of passages of which only the bag is labelled. Every
passage, to the last one, is encoded from how its characters follow each other
(shares of pairs of character classes); a gated attention, tanh times sigmoid,
gives each passage a weight, learned from the documents' labels together with
the encoder; the weighted mean of the encoded passages is scored.

Defined cases: a null text counts as empty; an empty text is one passage of
zeros. Repeated rows are scored each. If a label is missing from the sample,
all scores are the share of label 1 there (0 without any label). An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import bounded_batches, table
from brindle.llm.labelled import Adam, held_out, learning_sample, sigmoid

#: At most so many labelled documents of label 0 and of label 1 are learned from.
SAMPLE = (2000, 2000)
PASSAGE_BYTES = 512
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 250, 0.01, 1e-4
#: Texts that are encoded together.
PART = 64
#: Character classes of a byte; those of one class are alike to the encoder.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r\x0b\x0c", "stop": b".", "comma": b",;:", "shout": b"!?", "sign": b"#$%&*+=@^~", "bar": b"|/\\_<>{}[]", "quote": b"\"'()`-"}
KINDS = len(CLASSES) + 2
FEATURES = KINDS * KINDS + 3
CLASS_OF = np.full(256, len(CLASSES), np.int64)
CLASS_OF[128:] = len(CLASSES) + 1
for _k, _chars in enumerate(CLASSES.values()):
    CLASS_OF[list(_chars)] = _k


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    n = int(counts.sum())
    first = np.cumsum(counts) - counts
    kinds = CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    begin = np.cumsum(sizes) - sizes
    passage = np.repeat(first, sizes) + (np.arange(len(kinds)) - np.repeat(begin, sizes)) // PASSAGE_BYTES
    same = passage[1:] == passage[:-1]
    pair = ((passage[:-1] * KINDS + kinds[:-1]) * KINDS + kinds[1:])[same]
    found = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    total = found.sum(1, keepdims=True)
    share = np.sqrt(found / np.maximum(total, 1))
    words = found[:, CLASS_OF[32] * KINDS :][:, :KINDS].sum(1, keepdims=True)
    length = np.repeat(np.log1p(counts), counts)[:, None].astype(np.float32)
    return np.hstack([share, words / np.maximum(total, 1), np.log1p(total) / 6, length / 4]).astype(np.float32), counts


class Model:
    def __init__(self, params: dict[str, np.ndarray], share: float | None = None):
        self.params, self.share = params, share

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.params, np.cumsum(counts) - counts
        h = np.tanh(x @ p["encoder"] + p["encoder_bias"])
        gate, lift = sigmoid(h @ p["gate"]), np.tanh(h @ p["lift"])
        raw = (gate * lift) @ p["attention"]
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), counts))
        weight /= np.repeat(np.add.reduceat(weight, first), counts)
        bag = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"h": h, "gate": gate, "lift": lift, "weight": weight, "bag": bag, "score": sigmoid(bag @ p["out"] + p["out_bias"])}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return self.forward(*encode(texts))["score"].astype(np.float64) if texts else np.zeros(0)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    if not len(labels) or labels.min() == labels.max():
        return Model({}, float(labels.mean()) if len(labels) else 0.0)
    some = [encode(texts[i : i + PART]) for i in range(0, len(texts), PART)]
    x, counts = (np.concatenate(c) for c in zip(*some))
    del some
    first = np.cumsum(counts) - counts
    rng = np.random.default_rng(3)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"encoder": normal(FEATURES, HIDDEN) * 4, "encoder_bias": np.zeros(HIDDEN, np.float32), "gate": normal(HIDDEN, GATE), "lift": normal(HIDDEN, GATE), "attention": normal(GATE), "out": normal(HIDDEN), "out_bias": np.zeros(1, np.float32)}
    model, adam = Model(p), Adam(p, RATE)
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()).astype(np.float32)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(counts))
    for _ in range(epochs):
        f = model.forward(x, counts)
        error = (f["score"] - labels) * weight
        d_bag = error[:, None] * p["out"]
        each = d_bag[owner]
        d_weight = (each * f["h"]).sum(1)
        d_raw = f["weight"] * (d_weight - np.add.reduceat(f["weight"] * d_weight, first)[owner])
        d_both = d_raw[:, None] * p["attention"]
        d_gate, d_lift = d_both * f["lift"] * f["gate"] * (1 - f["gate"]), d_both * f["gate"] * (1 - f["lift"] ** 2)
        d_h = (each * f["weight"][:, None] + d_gate @ p["gate"].T + d_lift @ p["lift"].T) * (1 - f["h"] ** 2)
        grads = {"encoder": x.T @ d_h, "encoder_bias": d_h.sum(0), "gate": f["h"].T @ d_gate, "lift": f["h"].T @ d_lift, "attention": (f["gate"] * f["lift"]).T @ d_raw, "out": f["bag"].T @ error, "out_bias": error.sum(keepdims=True)}
        adam.step({k: (g + DECAY * p[k]).astype(np.float32) for k, g in grads.items()})
    return model


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        scores = [model.score([t or "" for t in texts.slice(at, rows).to_pylist()]) for at in range(0, batch.num_rows, rows)]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", "held_out", "score"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: tuple[int, int] = SAMPLE) -> Model:
    return train(*learning_sample(docs, labels, label, sample))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) for every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(lambda x: score_batches(x, shared.value), "doc_id long, held_out boolean, score double")


def op9_passage_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, fit(docs, labels)).selectExpr("doc_id", "held_out", "score", "int(score >= 0.3) AS predicted")
