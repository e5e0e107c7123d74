"""Small cases with known results, and properties against plain Python."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle import Workspace
from brindle.catalog import RejectedWrite
from brindle.functions import arrays
from brindle.functions.expressions import ExpressionError, compile_expression, macros, moment
from brindle.functions.subwords import SubwordTokenizer
from brindle.operators import aggregate, graph, mutate, search, timeseries
from brindle.operators.records import Records
from brindle.plans import cost
from brindle.plans.compiler import where_column
from brindle.plans.language import LanguageError, parse
from brindle.sources import dump_jsonl, load_csv, load_jsonl, shred, value_kind, widen
from brindle.streaming import allowed_url, continuous_sum, file_stream, interpolate, late_bonds, run_available


def edges(spark, *pairs, label="e"):
    return spark.createDataFrame([(a, b, label) for a, b in pairs], "source string, target string, label string")


def test_filter_and_top(spark):
    df = spark.range(10).select((F.col("id") * 25).alias("total"), (F.col("id") * 10).alias("score"))
    assert df.where(where_column(df, [("AND", "total", ">", 100)])).count() == 5
    w = Workspace(spark).add("t", df.withColumn("k", F.col("total").cast("string")), "k")
    assert [r.score for r in w.run("FIND THE HIGHEST 3 score FROM t").collect()] == [90, 80, 70]
    assert w.run("FIND THE LAST 0 FROM t").count() == 0


def test_closure_triangles_guard_path(spark):
    two = edges(spark, ("a", "b"), ("b", "c"))
    pairs = graph.closure(two)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    new = edges(spark, ("c", "a"), ("c", "d"), ("x", "x"))
    assert {(r.source, r.target) for r in graph.rejected_by_cycle_guard(new, pairs).collect()} == {("c", "a"), ("x", "x")}
    tri = edges(spark, ("u1", "u2"), ("u2", "u3"), ("u3", "u1"), ("u3", "u4"), ("s", "s"))
    assert {tuple(r) for r in graph.triangles(tri).collect()} == {("u1", "u2", "u3"), ("u2", "u3", "u1"), ("u3", "u1", "u2"), ("s", "s", "s")}
    start, goal = spark.createDataFrame([("a",)], "n string"), spark.createDataFrame([("c",)], "n string")
    assert graph.path_authorized(two, start, goal, 2).first().length == 2
    assert not graph.path_authorized(two, start, goal, 1).first().authorized


def test_vectors_histogram_hll(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [0.9, 0.1, 0.0, 0.0])], "id string, v array<double>")
    assert [r.id for r in search.vector_top(v, "id", "v", [1, 0, 0, 0], 2).collect()] == ["a", "c"]
    assert search.vector_top(v, "id", "v", [0, 0, 0, 0], 2).count() == 0
    h = aggregate.histogram(spark.range(1000).select(F.col("id").cast("double").alias("x")), "x")
    assert abs(aggregate.range_selectivity(h, 100, 200).first()[0] - 0.1) < 0.05
    assert 9000 < aggregate.approximate_distinct(spark.range(10_000), "id").first()[0] < 11_000
    one = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert one.select(arrays.total(arrays.softmax(F.col("x")))).first()[0] == pytest.approx(1)


def test_latches(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", "t", "l", "latched", at, at + dt.timedelta(seconds=100))]
    b = spark.createDataFrame(rows, "source string, target string, label string, status string, created_at timestamp, expires_at timestamp")
    docs = spark.createDataFrame([("s",), ("t",)], "gid string")
    status = lambda s: graph.resolve_latches(b, docs, at + dt.timedelta(seconds=s)).first().status
    assert (status(99), status(100)) == ("active", "expired")
    assert graph.resolve_latches(b, docs.where("gid = 's'"), at).first().status == "latched"
    assert graph.resolve_latches(b.withColumn("status", F.lit("expired")), docs, at).first().status == "expired"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["AND", "OR"]), st.sampled_from(["a", "b", "gone"]), st.sampled_from(["=", "!=", ">", "<", ">=", "<="]), st.integers(-2, 2)), min_size=1, max_size=4))
def test_where_folds_from_the_left(spark, parts):
    rows = [(a, b) for a in (None, -1, 0, 2) for b in (None, 0, 1)]
    df = spark.createDataFrame(rows, "a int, b int")

    def holds(row, op, f, v):
        x = {"a": row[0], "b": row[1]}.get(f)
        if op in ("=", "!="):
            return (x == v) == (op == "=")
        return x is not None and {">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v}[op]

    def fold(row):
        out = None
        for c, f, op, v in parts:
            p = holds(row, op, f, v)
            out = p if out is None else (out or p) if c == "OR" else (out and p)
        return out

    got = df.where(where_column(df, parts)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(filter(fold, rows), key=key)


def test_spreads_differ(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "g string, v double")
    assert {r.g: r.s for r in aggregate.distill(df, [("SPREAD", "v", "s")], "g").collect()} == {"x": 2.0, "y": 0.0}
    got = {r.g: r.s for r in aggregate.pipe_group(df, "g", [("SPREAD", "v", "s")]).collect()}
    assert got == {"x": pytest.approx(2**0.5), "y": 0.0}
    text = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert aggregate.distill(text, [("SUM", "v", "s")]).first().s is None
    assert aggregate.pipe_group(text.withColumn("g", F.lit(1)), "g", [("TOTAL", "v", "s")]).first().s == 1.0
    assert aggregate.distill(df.limit(0), [("COUNT", None, "n")]).count() == 0


def test_workspace_lifecycle(spark):
    now = [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)]
    w = Workspace(spark, clock=lambda: now[0])
    w.run('POUR INTO users "alice" {"name": "Alice", "age": 30, "day": "_date_"}')
    w.run('POUR MANY INTO users [{"_id": "bob", "name": "Bob", "age": 25}, {"_id": "cy", "name": "Cy", "age": 40}]')
    w.run("SHAPE BUCKET users AUDITED")
    w.run('CHANGE users "alice" SET age TO 31')
    seq = w.seq
    w.run('CHANGE users "alice" SET age TO 99')
    assert w.run('FIND users WHOSE name IS "Alice"').first().age == 99
    w.run(f"UNDO {seq + 1}")
    assert w.run('FIND users WHOSE name IS "Alice"').first().age == 31
    assert w.run('FIND users WHOSE name IS "Alice"').first().day == "2024-01-01"
    w.run("GUARD users WITH name REQUIRED, age TYPE number")
    with pytest.raises(RejectedWrite):
        w.run('POUR INTO users "dan" {"age": 5}')
    w.run('BOND "users:alice" TO "users:bob" AS MUTUAL "friend"')
    w.run('BOND "users:alice" TO "users:zoe" AS "friend"')
    got = {r.target: r.bond_status for r in w.run('FIND "friend" OF "users:alice"').collect()}
    assert got == {"users:bob": "active", "users:zoe": "latched"}
    assert w.run("SHOW PENDING BONDS").count() == 1
    assert {r.node for r in w.run('FOLLOW "users:alice" THROUGH "friend" DEPTH 2').collect()} == {"users:alice", "users:bob", "users:zoe"}
    now[0] += dt.timedelta(hours=1)
    w.run('SEVER "users:alice" FROM "users:bob"')
    assert w.run('FIND "friend" OF "users:bob"').count() == 0
    assert {r.node for r in w.run('FOLLOW "users:alice" THROUGH "friend" DEPTH 1 AS OF "2024-01-01T00:30:00"').collect()} >= {"users:bob"}
    assert w.run('FIND HOW THE "friend" OF "users:bob" CHANGED BETWEEN "2024-01-01" AND "2024-01-02"').count() == 4
    with pytest.raises(RejectedWrite):
        w.run('SET role = "admin"')
    w.run('EXPERIMENT BRANCH "x"')
    w.run('SET branch = "x"')
    w.run('DRAIN users "bob"')
    assert w.run("FIND THE TALLY OF users").first().tally == 2
    w.run('SET branch = "main"')
    assert w.run("FIND THE TALLY OF users").first().tally == 3
    assert w.run('MERGE BRANCH "x"').first().deleted == 1
    assert w.run("FIND THE TALLY OF users").first().tally == 2
    w.run('GUARD users WITH NOT EXISTS PATH (doc)-["boss"*]->(doc)')
    w.run('BOND "users:alice" TO "users:cy" AS "boss"')
    with pytest.raises(RejectedWrite):
        w.run('BOND "users:cy" TO "users:alice" AS "boss"')


@pytest.mark.parametrize("text", ["FIND", "FIND users WHERE", "GRUMBLE x", "POUR INTO b {broken", "FIND users LIMIT many", "FIND users extra words"])
def test_language_rejects(text):
    with pytest.raises(LanguageError):
        parse(text)


def test_language_reads():
    s = parse('FIND orders WHERE a == -1.5 OR b != "x" ARRANGED BY a GOING UP LIMIT 2')
    assert s.where == [("AND", "a", "=", -1.5), ("OR", "b", "!=", "x")] and s.order == ("a", False) and s.limit == 2
    assert parse('TRACE "a", "b" FROM "x:1"').labels == ["b", "a"]
    assert parse("EVERY 5 MINUTES DO (FIND users)").seconds == 300
    assert parse('MATCH (a FROM x)<-["l"]-(b FROM y)').hops == [("l", "IN")]
    assert parse('BOND "a:1" TO "b:1" AS "l" EXPIRING IN 2 DAYS').ttl == 172800


def test_expressions(spark):
    df = spark.createDataFrame([(6, None)], "a int, b string")
    value = lambda t: df.select(compile_expression(t, dict(df.dtypes)).alias("x")).first().x
    assert value("a / 4 + 1") == 2.5 and value("a / 0") is None and value('CONCAT(a, "-", b)') == "6-" and value("(a - 1) * 2 >= 10") is True
    with pytest.raises(ExpressionError):
        compile_expression("__import__('os')", {})
    assert macros({"x": ["_date_"]}, dt.datetime(2024, 5, 6)) == {"x": ["2024-05-06"]}
    assert moment("2024-01-02").day == 2 and moment(0).year == 1970


def test_sources(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"_id": "a", "n": "7"}\n\nnot json\n{"gid": "b"}\n')
    docs, bad = load_jsonl(spark, str(p))
    assert sorted(r.id for r in docs.collect()) == ["a", "b"] and bad.count() == 1
    assert {r.id: r.n for r in shred(docs, "n int").collect()} == {"a": 7, "b": None}
    c = tmp_path / "in.csv"
    c.write_text("x,y\n1,z\n2.5,w\n")
    assert load_csv(spark, str(c)).count() == 2
    dump_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert [value_kind("x", v) for v in ("2024-01-02", "12:00:00", "true", "5", "1.5", "q", 3, [1], None)] == ["date", "time", "boolean", "integer", "float", "string", "integer", "array", "null"]
    assert widen("integer", "float") == "float" and widen("null", "date") == "date"


def test_small_pieces(spark):
    t = SubwordTokenizer.learn({"lower": 5, "lowest": 3, "new": 2}, 10)
    assert t.decode(t.encode("lower lowest")) == "lower lowest"
    p = cost.LearnedPlanner()
    assert p.learn("FullScan", 10, 1000) <= 10
    assert mutate.retention({"p": {"ttl_seconds": 3600}, "c": {"parent": "p", "max_docs": 100}}, "c") == {"ttl_seconds": 3600, "max_docs": 100}
    assert allowed_url("https://example.org/x") and not allowed_url("http://localhost/x") and not allowed_url("http://10.1.2.3/")
    assert interpolate("POUR $name$", {"name": "x"}) == "POUR x"
    df = spark.createDataFrame([("night", "nacht")], "a string, b string")
    assert df.select(search.bigram_jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 7)
    t = spark.createDataFrame([([{"a": 1}, {"a": 2}],)], "l array<struct<a:int>>")
    assert t.where(search.matching(t.schema, F.struct("l"), {"l": [{"a": 2}]})).count() == 1
    assert t.where(search.matching(t.schema, F.struct("l"), {"l": [{"a": 3}]})).count() == 0
    m = timeseries.forecast(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "t int, y double"), "y", "t", 2, "STEP")
    assert [r.predicted for r in m.orderBy("step").collect()] == [4.0, 5.0]


def test_records_against_plain_python(spark):
    import random

    rng = random.Random(7)
    words = ["bean", "roast", "milk", "sugar", "cup", "filter", "steam", "water"]
    data = [(f"o{i}", rng.randrange(30), " ".join(rng.choices(words, k=4)), round(rng.uniform(0, 1000), 1), rng.randint(1, 9), 1000 + i) for i in range(600)]
    df = spark.createDataFrame(data, "key string, cust int, note string, total double, qty int, ts long")
    r = Records().add("o", df, "key", "ts", "note")
    shapes = [
        (dict(where=[("total", ">", 500)]), lambda x: x[3] > 500),
        (dict(where=[("total", ">", 200), ("qty", "<=", 3)]), lambda x: x[3] > 200 and x[4] <= 3),
        (dict(text="milk"), lambda x: "milk" in x[2].split()),
        (dict(text="mil* water"), lambda x: any(w.startswith("mil") for w in x[2].split()) and "water" in x[2].split()),
        (dict(since=1100, until=1200), lambda x: 1100 <= x[5] <= 1200),
        (dict(text="cup", where=[("qty", "!=", 5)], since=1050), lambda x: "cup" in x[2].split() and x[4] != 5 and x[5] >= 1050),
    ]
    for filters, test in shapes:
        want = sorted((x for x in data if test(x)), key=lambda x: -x[5])
        assert [x.key for x in r.find("o", limit=5, **filters).collect()] == [x[0] for x in want[:5]]
        assert r.count("o", **filters).first()[0] == len(want)
        assert r.agg("o", "total", **filters).first()["sum"] == pytest.approx(sum(x[3] for x in want))


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    got = run_available(continuous_sum(file_stream(spark, str(tmp_path / "in"), df), "g", "v"), "sums", "complete", str(tmp_path / "c"))
    want = aggregate.grouped_sum_view(df, "g", "v")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_late_bonds_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    b = spark.createDataFrame([("s1", "t1", at(0)), ("s2", "t2", at(0)), ("s9", "t9", at(900))], "source string, target string, bond_ts timestamp")
    t = spark.createDataFrame([("t1", at(50)), ("t2", at(150)), ("tx", at(900))], "gid string, target_ts timestamp")
    b.write.parquet(str(tmp_path / "b"))
    t.write.parquet(str(tmp_path / "t"))
    out = late_bonds(file_stream(spark, str(tmp_path / "b"), b, 10), file_stream(spark, str(tmp_path / "t"), t, 10), "100 SECONDS")
    got = {r.source: r.status for r in run_available(out, "fused", "append", str(tmp_path / "c2")).collect()}
    assert got == {"s1": "fused", "s2": "expired"}


def test_time_travel_triggers_tenants_and_write_policies(spark):
    now = [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)]
    w = Workspace(spark, clock=lambda: now[0])
    w.run('POUR MANY INTO stock [{"_id": "a", "n": 1, "tenant": "x"}, {"_id": "b", "n": 2, "tenant": "y"}]')
    w.run('POUR INTO log "0" {"what": "start"}')
    w.run("SHAPE BUCKET stock AUDITED")
    w.run("ON POUR INTO stock RUN 'POUR INTO log \"$_id$\" {\"what\": \"$n$\"}'")
    now[0] += dt.timedelta(days=1)
    w.run('CHANGE stock "a" SET n TO 5')
    now[0] += dt.timedelta(days=1)
    assert {r.n for r in w.run('FIND stock AS OF "2024-01-01T12:00:00"').collect()} == {1, 2}
    assert {r.n for r in w.run("FIND stock").collect()} == {5, 2}
    w.run('POUR INTO stock "c" {"n": 9, "tenant": "x"}')
    assert {(r.gid, r.what) for r in w.run("FIND log").collect()} == {("log:0", "start"), ("log:c", "9")}
    w.session(tenant="x")
    assert {r.gid for r in w.run("FIND stock").collect()} == {"stock:a", "stock:c"}
    w.run('ENFORCE SECURITY "staff" ON "stock" TO ALLOW write IF my role = "staff"')
    with pytest.raises(RejectedWrite):
        w.run('CHANGE stock "a" SET n TO 6')
    w.session(role="staff").run('CHANGE stock "a" SET n TO 6')
    assert w.run("FIND stock WHERE n = 6").count() == 1


def test_drain_reaches_every_bucket_and_depth(spark):
    w = Workspace(spark)
    small = ["b1", "b2", "b3", "b4"]
    for name, n in [("top", 1), ("big", 20_000), *[(b, 1) for b in small]]:
        w.add(name, spark.range(n).select(F.col("id").cast("string").alias("k")), "k")
    targets = spark.range(20_000).select(F.concat(F.lit("big:"), "id").alias("target")).unionByName(spark.createDataFrame([(f"{b}:0",) for b in small], "target string"))
    bonds = targets.select(F.lit("top:0").alias("source"), "target", F.lit(True).alias("cascade"))
    w.state.bonds = bonds.select(*[(F.col(c) if c in bonds.columns else F.lit(None)).cast(t).alias(c) for c, t in w.state.bonds.dtypes])
    w.run('DRAIN top "0"')
    assert [w.bucket(b).df.count() for b in ["top", "big", *small]] == [0] * 6
    chain = edges(spark, *[(f"n{i + 1:03}", f"n{i:03}") for i in range(70)]).withColumn("on_delete", F.lit("cascade"))
    assert graph.cascade_all(chain, spark.createDataFrame([("n000",)], "gid string")).count() == 71


def test_time_window_has_no_row_cap(spark, tmp_path):
    n = 1_000_050
    e = spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-10 12:00:00").cast("timestamp").alias("ts"), F.lit(60.0).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    from brindle.queries import QUERIES

    assert QUERIES["record_time_window"](spark, str(tmp_path)).count() == n


def test_graph_queries_know_all_users(spark, tmp_path):
    from brindle.queries import QUERIES

    users = [1, 70, 90, 1, 5, 70, 80, 200, 200, 210]  # 210 has no way back
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").withColumn("event_type", F.lit("purchase")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    next_of = set(zip(users, users[1:]))
    pairs, size = set(next_of), 0
    while size != len(pairs):
        size = len(pairs)
        pairs |= {(u, t) for u, v in pairs for s, t in next_of if v == s and u != t}
    hop, level = {1: 0}, {1}
    for h in (1, 2, 3):
        level = {t for s, t in next_of if s in level} - set(hop)
        hop |= dict.fromkeys(level, h)
    both, two, level = next_of | {(t, s) for s, t in next_of}, {1: 0}, {1}
    for h in (1, 2):
        level = {t for s, t in both if s in level} - set(two)
        two |= dict.fromkeys(level, h)
    del two[1]
    cyclic = {u: min(v for x, v in pairs if x == u and (v, u) in pairs or x == u == v) for u in {u for u, v in pairs if (v, u) in pairs}}
    tri = {(a, b, c) for a, b in next_of for x, c in next_of if x == b and (c, a) in next_of and len({a, b, c}) in (1, 3)}
    new = {(u, t) for u in users for t in (u * 7, u + 1)}
    got = lambda q, *cols: {tuple(r) for r in QUERIES[q](spark, str(tmp_path)).select(*cols).collect()}
    assert got("follow_out_depth", "node", "hop") == set(hop.items())
    assert got("follow_both", "node", "hop") == set(two.items())
    assert got("closure", "u", "v") == pairs
    assert got("cycles_scc", "component", "node") == {(min(c, u), u) for u, c in cyclic.items()}
    assert got("triangles", "a", "b", "c") == tri and tri
    assert got("acyclic_guard", "source", "target") == {(s, t) for s, t in new if s == t or (t, s) in pairs}
    near = {u: h for u, h in hop.items() if h <= 2}
    assert got("path_auth", "node", "authorized", "length") == {(u, u in near, near.get(u)) for u in users}


def test_whole_tables_are_read(spark, tmp_path):
    from brindle.queries import QUERIES

    d = str(tmp_path)
    spark.createDataFrame([(1, "an idiot", "en"), (2, "ein idiot", "de"), (3, "one two two", None), (4, None, "fr")], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7,), (49,), (50,), (9000,)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(7, 1, 3), (50, 1, 2), (9000, 1, 5), (9000, 2, 1)], "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    assert {tuple(r) for r in QUERIES["term_freq"](spark, d).select("doc_id", "term", "tf").collect()} == {(1, "an", 1), (1, "idiot", 1), (2, "ein", 1), (2, "idiot", 1), (3, "one", 1), (3, "two", 2)}
    assert {tuple(r) for r in QUERIES["intent"](spark, d).collect()} == {(1, "insult"), (2, "insult"), (3, "ambiguous"), (4, "ambiguous")}
    assert {tuple(r) for r in QUERIES["join_many"](spark, d).collect()} == {(7, 1, "3"), (50, 1, "2"), (9000, 2, "1,5")}


def test_score_order_keeps_every_match(spark):
    from brindle.operators.records import Records

    rows = [(1, "milk, bread"), (2, "millet and Milk!"), (3, "milk"), (4, "bread")]
    r = Records().add("notes", spark.createDataFrame(rows, "id long, body string"), "id", text="body")
    found = lambda text, order: [x.id for x in r.find("notes", text=text, order=order).collect()]
    for text in ("mil*", "milk", "mil* bread", "milk bread"):
        assert sorted(found(text, "score")) == sorted(found(text, "newest"))

    def score(tf, size, df, n=4, mean=1.75):
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))

    want = {1: score(1, 2, 3), 2: score(2, 3, 3), 3: score(1, 1, 3)}  # words, of 2, 3, 1 and 1: 7 in 4 texts
    got = {x.id: x.score for x in r.find("notes", text="mil*", order="score").collect()}
    assert got == pytest.approx(want) and found("mil*", "score") == sorted(want, key=want.get, reverse=True)


def test_delete_follows_the_rules(spark):
    from brindle.operators.records import Records

    def records():
        make = lambda rows, cols: spark.createDataFrame(rows, cols)
        r = Records().add("city", make([(1, "a"), (2, "b")], "id long, name string"), "id").add("shop", make([(10, 1), (11, 2)], "id long, city long"), "id").add("sale", make([(100, 10), (101, 11)], "id long, shop long"), "id")
        return r.relate("shop", "city", "city", "city", "cascade")

    r = records().relate("sale", "shop", "shop", "shop", "cascade")
    gone = r.delete("city", spark.createDataFrame([(1,)], "id long"))
    assert {x.gid for x in gone.collect()} == {"city/1", "shop/10", "sale/100"} and [x.id for x in r.collections["sale"].df.collect()] == [101]
    r = records().relate("sale", "shop", "shop", "shop", "restrict")
    with pytest.raises(ValueError):
        r.delete("city", spark.createDataFrame([(1,)], "id long"))
    r.put("city", spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string"))
    assert {tuple(x) for x in r.collections["city"].df.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    joined = r.find("city", limit=None, join=["shop.city"]).collect()
    assert {x.id: None if x.joined_shop_city is None else [y.id for y in x.joined_shop_city] for x in joined} == {1: [10], 2: [11], 3: None}


def test_long_paths_and_components(spark):
    make = lambda rows: spark.createDataFrame(rows, "source long, target long")
    path = make([(i, i + 1) for i in range(70)])
    assert graph.closure(path, spark.createDataFrame([(0,)], "s long")).count() == 70
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 8), (7, 9), (2, 2)]
    assert {tuple(r) for r in graph.cycles(make(edges)).select("component", "node").collect()} == {(1, 1), (1, 2), (1, 3), (5, 5), (5, 6), (8, 8)}
    assert {tuple(r) for r in graph.closes_cycle(make([(4, 1), (9, 1), (9, 10), (5, 5)]), make(edges)).collect()} == {(4, 1), (9, 1), (5, 5)}


def test_policies_hold_for_reads_through_relations(spark):
    w = Workspace(spark)
    w.add("note", spark.createDataFrame([(1, "open", 5.0), (2, "secret", 7.0), (3, "open", 1.0)], "id long, kind string, n double"), key="id")
    for a, b in ((1, 2), (2, 3), (1, 3)):
        w.run(f'BOND "note:{a}" TO "note:{b}" AS "next"')
    w.rules.policies["note"] = {"p": ("read", 'kind == "open"')}
    from brindle.plans import compiler

    seen = compiler.permitted(w, w.state.bonds, "source", "target")
    assert {(r.source, r.target) for r in seen.collect()} == {("note:1", "note:3")}


def test_stream_counts_end_where_the_sql_does(spark, tmp_path):
    """Of the minute that holds the last moment counted, only what is before that moment counts."""
    import datetime as dt

    import duckdb

    from brindle.queries import ORACLE_SQL, QUERIES

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, at(s), u) for i, (s, u) in enumerate([(0, 1), (5, 1), (65, 2), (125, 1), (140, 1), (150, 1), (151, 1), (179, 2), (200, 1), (270, 3)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["rate_limit_stream"])
    got = QUERIES["rate_limit_stream"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 3


def test_closure_keeps_components_not_pairs(spark, monkeypatch):
    """Two stars of links both ways, one after the other: no table on disk has more rows than there are edges, of 1201 pairs."""
    star = lambda a, n: [x for i in range(1, n) for x in ((a, a + i), (a + i, a))]
    rows = [*star(0, 20), *star(100, 20), (3, 107), (107, 107), (119, 500)]
    make = lambda rows: spark.createDataFrame(rows, "source long, target long")
    kept, whole = [], graph.checkpointed

    def watched(df):
        out = whole(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", watched)
    monkeypatch.setattr(graph, "CHUNK", 7)
    got = [tuple(r) for r in graph.closure(make(rows)).collect()]
    a, b = range(20), range(100, 120)
    want = {(u, v) for s in (a, b) for u in s for v in s if u != v} | {(u, v) for u in a for v in b} | {(u, 500) for u in [*a, *b]} | {(107, 107)}
    assert len(got) == len(want) and set(got) == want and max(kept) <= len(rows)
    new = [(500, 0), (100, 3), (0, 100), (0, 0), (5, 9), (7, 500), (500, 7), (900, 1)]
    closed = {tuple(r) for r in graph.closes_cycle(make(new), make(rows)).collect()}
    assert closed == {(s, t) for s, t in new if s == t or (t, s) in want} and max(kept) <= len(rows)
    assert {tuple(r) for r in graph.closure(make(rows), spark.createDataFrame([(3,), (107,)], "n long")).collect()} == {p for p in want if p[0] in (3, 107)}
