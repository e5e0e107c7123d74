"""Classifiers: held-out accuracy, reproducibility and odd inputs; decontamination against a slow search."""

import re
import zlib

import numpy as np
import pytest

from brindle.llm import decontamination, quality, toxicity

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.mark.parametrize("module, label, cut, least", [(toxicity, "toxic", 0.5, 0.93), (quality, "quality", 0.3, 0.98)])
# always saying 0 is right for 0.88 of the toxic labels here; measured 0.948 with these few labels, 0.990 with the 20,000 of the check data
def test_held_out_accuracy(labelled, module, label, cut, least):
    docs, labels = labelled
    got = {r.doc_id: r for r in module.scored(docs, module.fit(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    pairs = [((got[r.doc_id].score >= cut), r[label]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r[label] is not None]
    assert np.mean([a == b for a, b in pairs]) >= least
    ones = [a for a, b in pairs if b == 1]
    assert np.mean(ones) > 0.65


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd(spark, odd, empty, module):
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    label = "toxic" if module is toxicity else "quality"
    out = module.scored(odd, module.fit(odd, few)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert module.scored(empty, module.fit(empty, few)).count() == 0
    none = module.scored(odd, module.fit(odd, few.where("doc_id < 0"))).collect()
    assert all(r.score < 1e-9 for r in none), label


def test_misspellings_share_subwords():
    texts = [f"the day was {w} and then" for w in ("calm", "long", "short", "warm", "grey", "plain")] * 5 + [f"the day was {w} and then" for w in ("frobnax", "frobnaxed", "frobnaxing")] * 10
    labels = np.array([0] * 30 + [1] * 30)
    model = toxicity.train(texts, labels, 40)
    known = toxicity.Contributions(model.value)
    known.learn([["frobnaxx", "fr0bnax", "calmly"]])
    assert known["frobnaxx"] > known["calmly"] and known["fr0bnax"] > known["calmly"]


def test_filter_keeps_columns(spark, odd):
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, few.where("toxic = 0"))
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.drop_toxic(odd, model).count() == odd.count()


def slow(docs, items, stretch=13, share=0.8):
    """Every item laid over every place of every text."""
    found = set()
    for doc, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for item, t in items:
            b = re.findall(r"\w+", (t or "").lower())
            n = min(stretch, len(b))
            if len(b) < 5:
                continue
            for start in range(-len(b) + n, len(w) - n + 1):
                eq = [start + k >= 0 and start + k < len(w) and w[start + k] == b[k] for k in range(len(b))]
                if any(sum(eq[i : i + n]) >= share * n for i in range(len(b) - n + 1) if start + i >= 0 and start + i + n <= len(w)):
                    found.add((doc, item))
                    break
    return found


@pytest.fixture(scope="module")
def leaky(spark):
    import random

    rng = random.Random(9)
    words = [f"q{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 9, 15, 30])))) for i in range(25)] + [(97, None), (98, ""), (99, "a b")]
    docs = []
    for d in range(60):
        w = rng.choices(words, k=80)
        if d % 3 == 0:
            leak = rng.choice(items[:25])[1].split()
            for _ in range(d % 4 if len(leak) > 20 else 0):
                leak[rng.randrange(len(leak))] = "changed"
            w[20:20] = leak
        docs.append((d, " ".join(w).title() if d % 2 else ", ".join(w)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (0, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(leaky):
    docs, items = leaky
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    want = slow([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got == want and want
    blocks = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, block_chars=300).collect()}
    assert blocks == got
    clean = decontamination.drop_contaminated(docs, items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_decontamination_odd(spark, odd, empty, leaky):
    items = leaky[1]
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0
    assert decontamination.drop_contaminated(odd, items).count() == odd.count()
