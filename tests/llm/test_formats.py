"""Chat formatting, packing, sharding and the pipeline."""

import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from brindle.llm import chat, packing, queries, sharding
from brindle.llm.common import table

TEXT = st.lists(st.sampled_from([*"ab \\#<>/:\n", "é", "漢", "</turn>", "### ", "🙂"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "", "sys#"]), TEXT), max_size=6))
def test_round_trip_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert list(chat.read_back(formatted)) == turns
    _, mask, lows, highs = chat.loss_mask(formatted, spans, chat._file(None))
    assert chat.unescape("".join(formatted[a:b] for a, b in zip(lows, highs))) == "".join(t for r, t in turns if r == "assistant")


def test_chat_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_chat_formatting"]).df()
    got = chat.op5_chat_formatting(spark, sf).toPandas()
    key = lambda d: d[sorted(d.columns)].sort_values("conv_id").reset_index(drop=True)
    assert key(got).equals(key(want))


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "tie"), (1, None, "assistant", "first"), (None, 1, "user", "x"), (1, 0, None, "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert list(chat.read_back(got[1].formatted))[0] == ("assistant", "first") and len(list(chat.read_back(got[1].formatted))) == 4
    assert len(got) == 2 and len(got[1].token_ids) == len(got[1].loss_mask)
    assert chat.digests(df.limit(0)).count() == 0


def packed_ok(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == capacity
        assert sum(r.length for r in own) == len(ids)
    return len(by_sequence)


def test_packing(spark, sf):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs).collect()
    n = packed_ok(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.05 + 2


def test_packing_odd(odd, empty):
    rows = packing.pack(odd).collect()
    unique = odd.where("doc_id not in (3, 5)")
    packed_ok([r for r in rows], {r.doc_id: r.text for r in unique.collect()})
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=8))
def test_plan_uses_every_piece_and_is_near_best(counts):
    patterns = packing.plan(counts, 20)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 20
        for s in p:
            used[s] += n
    assert used == Counter(counts)
    total = sum(s * n for s, n in counts.items())
    assert sum(n for _, n in patterns) <= 1.25 * max(-(-total // 20), sum(n for s, n in counts.items() if s > 10)) + 1


def test_dominance_is_exact_on_perfect_pairs():
    left = [0] * 11
    left[7], left[3], left[6], left[4] = 2, 2, 1, 1
    assert sorted(packing.reduce_dominated(left, 10)) == [((6, 4), 1), ((7, 3), 2)] and not any(left)


def balanced(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.get(s, 0) for s in range(8)) - min(sizes.get(s, 0) for s in range(8)) <= 1 and sum(sizes.values()) == n
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes.get(s, 0)))


def test_sharding(spark, sf):
    docs = table(spark, sf, "documents").collect()
    rows = sharding.op6_balanced_sharding(spark, sf).collect()
    balanced(rows, len(docs))
    text = {r.doc_id: r.text for r in docs}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    groups = defaultdict(set)
    for r in rows:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_sharding_repeats(spark, odd):
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, "same") for i in range(40)], "doc_id long, text string"))
    placed = lambda df: sorted(map(str, sharding.shard(df, F.col("text")).collect()))
    assert placed(rows.repartition(3)) == placed(rows.coalesce(1))


def test_sharding_hot_group_and_odd(spark, odd, empty):
    from pyspark.sql import functions as F

    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 120, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    balanced(sharding.shard(hot, F.col("text")).collect(), 300)
    balanced(sharding.shard(hot.where("doc_id < 120"), F.col("text")).collect(), 120)
    out = sharding.shard(odd.drop("label", "shard"), F.col("text"))
    balanced(out.collect(), odd.count())
    assert "key" in out.columns and sharding.shard(empty, F.col("text")).count() == 0


def test_no_python_in_sharding(spark, sf):
    plan = sharding.op6_balanced_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out.cache()
        assert 0 < docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    packed_ok(last, {r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_take_empty(spark, sf, empty, stage):
    assert stage(spark, empty, sf).count() == 0


def test_queries_are_json_safe():
    assert json.dumps(sorted(queries.QUERIES)) and len(queries.QUERIES) == 10
