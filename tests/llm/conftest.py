import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = ["", None, "   ", "one", "two words", passage, f"before {passage} after", f"{passage} {passage}", long, long, "née à l'été " * 20, "née à l'été " * 20, "a" * 500, "x\ty\nz  w   v", "end <|endoftext|> of text"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3), (5, passage, None, None, None), (5, "another text under one id", "en", "s", 1), (None, passage, "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("_kept", "tag", "fp", "bucket", "label", "shard", "score", "key", "path"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def families(spark):
    """Texts with near copies, exact copies and shared passages, in a few sizes."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(900)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts, shared = [], [make(40) for _ in range(4)]
    for _ in range(60):
        w = make(rng.choice([5, 30, 120, 300]))
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(shared)[rng.randrange(10) :]
        texts.append(w)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(w)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rng.shuffle(texts)
    rows = [(i, (" " if i % 3 else "\n").join(w), "en", "s", 0) for i, w in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
