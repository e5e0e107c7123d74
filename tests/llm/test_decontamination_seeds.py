"""Spaced seeds: every substitution within the rule is found, and repetitions stay bounded."""

from itertools import combinations
from math import ceil

import numpy as np

from brindle.llm.decontamination import SHARE, Block, drop_contaminated


def placed(block, words):
    return block.verified(np.array([dict.get(block.words, w, 0) for w in words], np.int64))


def test_every_substitution_is_found():
    for n in range(4, 14):
        item = [f"q{i}" for i in range(n)]
        block = Block([(1, " ".join(item))])
        for gone in combinations(range(n), n - ceil(SHARE * n - 1e-9)):
            text = ["x"] * 5 + ["z" if i in gone else w for i, w in enumerate(item)] + ["y"] * 4
            assert [r[0] for r in placed(block, text)] == [1], (n, gone)
        if n > 5:
            gone = range(n - ceil(SHARE * n) + 1)
            assert not placed(block, ["z" if i in gone else w for i, w in enumerate(item)][: n - 1] + ["z"])


def test_repeated_words_meet_a_few_at_a_time(monkeypatch):
    from brindle.llm import decontamination

    monkeypatch.setattr(decontamination, "AT_ONCE", 1000)
    block = Block([(1, "ha " * 300), (2, " ".join(f"w{i}" for i in range(40)))])
    got = placed(block, ["ha"] * 500)
    assert [r[0] for r in got] == [1] and got[0][3] == 300


def test_blocks_give_the_same(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {' '.join(f'i{i}w{j}' for j in range(3, 18))} after" if i % 2 else "clean words alone") for i in range(8)], "doc_id long, text string")
    whole = [r.doc_id for r in drop_contaminated(docs, items).orderBy("doc_id").collect()]
    assert whole == [r.doc_id for r in drop_contaminated(docs, items, block_chars=200).orderBy("doc_id").collect()] == [0, 2, 4, 6]
