"""Statements to DataFrames. Reads follow one fixed order, whatever the order of the clauses."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.expressions import compile_expression, moment
from brindle.functions.predicates import compare, fold
from brindle.operators import aggregate, govern, graph, search, timeseries
from brindle.plans import cost
from brindle.plans.language import Statement
from brindle.sources import infer_schema

if TYPE_CHECKING:
    from brindle.catalog import Workspace


def where_column(df: DataFrame, parts: list[tuple[str, str, str, Any]]) -> Column:
    kinds = dict(df.dtypes)
    return fold((c, compare(F.col(f"`{f}`") if f in kinds else F.lit(None), op, v, kinds.get(f))) for c, f, op, v in parts)


def readable(w: Workspace, name: str, df: DataFrame) -> DataFrame:
    """Row policies of a bucket; they hold for every kind of read."""
    policies = [cond for action, cond in w.rules.policies.get(name, {}).values() if action in ("read", "all")]
    return govern.allowed(df, policies, w.context, w.relations())


def hidden(w: Workspace, name: str, df: DataFrame) -> DataFrame:
    for fields, condition, unless in w.rules.masks.get(name, ()):
        df = govern.masked(df, fields, condition, w.context, w.relations(), unless)
    return df


def base_of(w: Workspace, name: str) -> tuple[str, DataFrame]:
    """The bucket behind a name and its documents, a projection's predicate applied."""
    if name in w.rules.projections:
        bucket, parts = w.rules.projections[name]
        under, df = base_of(w, bucket)
        return under, df.where(where_column(df, parts))
    return name, w.documents(name)


def visible(w: Workspace, name: str) -> DataFrame:
    bucket, df = base_of(w, name)
    return hidden(w, bucket, readable(w, bucket, df))


def permitted(w: Workspace, df: DataFrame, *ends: str) -> DataFrame:
    """``df`` without the rows one of whose ``ends`` is a document that a row policy hides."""
    for name in w.state.buckets:
        if any(action in ("read", "all") for action, _ in w.rules.policies.get(name, {}).values()):
            everything = w.documents(name)
            out_of_sight = everything.select("gid").join(readable(w, name, everything).select("gid"), "gid", "left_anti")
            for end in ends:
                df = df.join(out_of_sight.withColumnRenamed("gid", end), end, "left_anti").select(*df.columns)
    return df


def run_find(w: Workspace, s: Statement) -> DataFrame:
    bucket, df = base_of(w, s.bucket)
    if s.get("at") is not None and bucket == s.bucket:
        df = w.documents_at(bucket, moment(s.at, w.clock()))
    own = df.columns
    order: list[Column] = []
    if s.get("mentioning"):
        df = df.where(search.mentioning(df.select(*[c for c in own if c != "gid"]), s.mentioning))
    if s.get("meaning"):
        if w.embed is None:
            raise ValueError("MEANING needs an embedding function")
        vector = w.bucket(bucket).embedding
        scores = search.meaning(df, "gid", vector, w.embed(s.meaning))
        df = df.join(scores, "gid").select(*own, "score")
        order = [F.desc("score"), F.col("gid")]
    if s.get("matching"):
        body = df.select(*own).schema
        df = df.where(search.matching(body, F.struct(*own), s.matching))
    df = readable(w, bucket, df)
    if s.get("where"):
        df = df.where(where_column(df, s.where))
    if s.get("whose"):
        f, v = s.whose
        df = df.where(F.substring_index("gid", ":", -1) == str(v) if f == "gid" else compare(F.col(f), "=", v, dict(df.dtypes).get(f)))
    mode = s.mode
    if s.get("include"):
        edges = w.state.bonds.where(F.col("label") == s.include).select(F.col("source").alias("gid"), F.col("target").alias(f"included_{s.include}"))
        df = df.join(edges, "gid", "left")
    if s.get("order"):
        f, down = s.order
        order = [F.desc_nulls_last(f) if down else F.asc_nulls_first(f), F.col("gid")]
    elif mode in ("highest", "lowest"):
        x = F.coalesce(F.col(s.field), F.lit(0))
        order = [x.desc() if mode == "highest" else x.asc(), F.col("gid")]
    n = s.get("n")
    if mode in ("first", "highest", "lowest"):
        df = df.orderBy(*(order or [F.col("gid")])).limit(int(n))
    elif mode == "last":
        df = df.orderBy(*_turned(s, order)).limit(int(n))
    if order or mode in ("first", "last") or s.get("limit") is not None:
        df = df.orderBy(*(order or [F.col("gid")]))
    if s.get("limit") is not None:
        df = df.limit(int(s.limit))
    if s.get("show"):
        df = df.select("gid", *[c for c in df.columns if c in s.show and c != "gid"])
    df = hidden(w, bucket, df)
    if mode == "tally":
        return df.agg(F.count(F.lit(1)).alias("tally"))
    if mode == "unique":
        return df.select(s.field).distinct()
    if mode == "total":
        return aggregate.total_grouped(df, s.field, s.get("by"))
    for name, expression in w.rules.enrich.get(bucket, ()):
        df = df.withColumn(name, compile_expression(expression, dict(df.dtypes), w.now().cast("double")))
    return df


def _turned(s: Statement, order: list[Column]) -> list[Column]:
    if not order:
        return [F.desc("gid")]
    if s.get("order"):
        f, down = s.order
        return [F.asc_nulls_first(f) if down else F.desc_nulls_last(f), F.desc("gid")]
    return [F.asc("score"), F.desc("gid")]


def run_distill(w: Workspace, s: Statement) -> DataFrame:
    df = visible(w, s.bucket)
    if s.where:
        df = df.where(where_column(df, s.where))
    return aggregate.distill(df, s.calls, s.by)


def run_pipe(w: Workspace, s: Statement) -> DataFrame:
    df = visible(w, s.bucket)
    for step, *args in s.steps:
        if step == "where":
            df = df.where(where_column(df, args[0]))
        elif step == "group":
            by, calls = args
            df = aggregate.pipe_group(df, by, [(fn, f, name or fn.lower()) for fn, f, name in calls])
        elif step == "order":
            f, down = args
            tie = [F.col("gid")] if "gid" in df.columns else [F.col(c) for c in df.columns if c != f]
            df = df.orderBy(F.desc_nulls_last(f) if down else F.asc_nulls_last(f), *tie)
        elif step == "limit":
            df = df.limit(int(args[0]))
        else:
            df = df.select(*[c for c in args[0] if c in df.columns])
    return df


def run_related(w: Workspace, s: Statement) -> DataFrame:
    docs = w.all_gids()
    bonds = permitted(w, w.state.bonds, "source", "target")
    at = moment(s.at, w.clock()) if s.get("at") is not None else None
    conditional = bonds.where(F.col("condition_field").isNotNull()).select("condition_side", "condition_field", F.substring_index(F.when(F.col("condition_side") == "source", F.col("source")).otherwise(F.col("target")), ":", 1).alias("b")).distinct()
    met = None
    conditional = conditional.where(F.col("b").isin(list(w.state.buckets)))  # at most one row a side and field of a bucket
    for r in conditional.toLocalIterator():
        if r["condition_field"] in w.bucket(r["b"]).df.columns:
            d = w.documents(r["b"]).select(F.col("gid").alias("_g"), F.lit(r["condition_side"]).alias("_side"), F.lit(r["condition_field"]).alias("_field"), F.col(r["condition_field"]).cast("string").alias("_now"))
            met = d if met is None else met.unionByName(d)
    if met is not None:
        side = F.when(F.col("condition_side") == "source", F.col("source")).otherwise(F.col("target"))
        kept = bonds.columns
        bonds = bonds.join(met, (side == F.col("_g")) & (F.col("condition_side") == F.col("_side")) & (F.col("condition_field") == F.col("_field")), "left")
        bonds = bonds.withColumn("condition_field", F.when(F.col("_now").eqNullSafe(F.col("condition_value")), F.lit(None)).otherwise(F.col("condition_field"))).select(*kept)
    return graph.related(bonds, docs, s.source, s.label, at, s.candidates).select("target", "label", "bond_status")


def run_links_of(w: Workspace, s: Statement) -> DataFrame:
    own = permitted(w, w.state.links.where(F.col("source") == s.source), "source", "target")
    known = own.join(w.all_gids(), F.col("target") == F.col("gid"), "left")
    return known.where(F.col("is_url") | F.col("gid").isNotNull()).select("target", "is_url").distinct()


def run_chain(w: Workspace, s: Statement) -> DataFrame:
    start = w.spark.createDataFrame([(s.source,)], "node string")
    return graph.chain(permitted(w, w.state.bonds, "source", "target"), start, s.labels, w.clock())


def run_match(w: Workspace, s: Statement) -> DataFrame:
    out = graph.match_path(permitted(w, w.state.bonds, "source", "target"), [(a, visible(w, b)) for a, b in s.nodes], s.hops)
    return out.where(where_column(out, s.where)) if s.where else out


def run_follow(w: Workspace, s: Statement) -> DataFrame:
    start = w.spark.createDataFrame([(s.source,)], "node string")
    if s.get("at") is not None:
        edges = graph.as_of(w.state.history, moment(s.at, w.clock()))
    else:
        edges = w.state.bonds
    edges = permitted(w, edges.where(F.col("label") == s.label) if s.label else edges.limit(0), "source", "target")
    out = graph.reach(edges, start, int(s.depth), s.direction, include_start=True)
    if s.get("guided") and w.embed:
        scored = None
        for name, b in w.state.buckets.items():
            if b.embedding:
                one = search.meaning(w.documents(name), "gid", b.embedding, w.embed(s.guided), s.get("threshold", 0.2))
                scored = one if scored is None else scored.unionByName(one)
        if scored is not None:
            out = out.join(scored.withColumnRenamed("gid", "node"), "node", "left_semi" if s.get("threshold") else "left").select("node", "hop")
    out = out.orderBy("hop", "node")
    return out.limit(int(s.limit)) if s.get("limit") else out


def run_find_how(w: Workspace, s: Statement) -> DataFrame:
    return graph.changes_between(permitted(w, w.state.history, "source", "target"), s.node, s.label, moment(s.low, w.clock()), moment(s.high, w.clock()))


def run_forecast(w: Workspace, s: Statement) -> DataFrame:
    return timeseries.forecast(visible(w, s.bucket), s.value, s.over, int(s.horizon), s.unit, s.method, int(s.window))


def run_view(w: Workspace, s: Statement) -> DataFrame:
    w.state.views[s.name] = aggregate.grouped_sum_view(visible(w, s.bucket), s.by, s.field)
    return w.state.views[s.name]


def run_graph_view(w: Workspace, s: Statement) -> DataFrame:
    edges = permitted(w, w.state.bonds if s.label is None else w.state.bonds.where(F.col("label") == s.label), "source", "target")
    w.state.views[s.name] = graph.closure(edges)
    return w.state.views[s.name]


def run_listen(w: Workspace, s: Statement) -> DataFrame:
    if s.view:
        return w.state.views[s.bucket]
    log = permitted(w, w.state.audit.where(F.col("bucket") == s.bucket), "gid")
    return log if s.key is None else log.where(F.col("gid") == f"{s.bucket}:{s.key}")


def run_replica(w: Workspace, s: Statement) -> DataFrame:
    df = visible(w, s.bucket)
    df = df.where(where_column(df, s.where)) if s.where else df
    out = df.select("gid", *[c for c in (s.show or df.columns) if c != "gid"])
    w.state.views[s.name] = out
    return out


def run_pending(w: Workspace, s: Statement) -> DataFrame:
    return permitted(w, w.state.bonds, "source", "target").where("status = 'latched'").select("source", "target", "label", "created_at", "expires_at")


def run_suggest(w: Workspace, s: Statement) -> DataFrame:
    gids, found = permitted(w, w.all_gids(), "gid"), None
    for name, b in w.state.buckets.items():
        fields = [f for f, k in b.df.dtypes if k == "string" and f != b.key]
        if fields:
            one = graph.suggest_references(visible(w, name), fields, gids)
            found = one if found is None else found.unionByName(one)
        if b.embedding:
            near = search.similar_pairs(visible(w, name), "gid", b.embedding, 0.5).select(F.col("a").alias("gid"), F.col("b").alias("to"), "score")
            found = near if found is None else found.unionByName(near)
    if found is None:
        return w.spark.createDataFrame([], "a string, b string, score double")
    return graph.best_suggestions(found, w.state.bonds).orderBy(F.desc("score"), "a", "b")


def run_show(w: Workspace, s: Statement) -> DataFrame:
    what = s.what.split()[0] if s.what else "BUCKETS"
    if what in ("BUCKETS", "STATS"):
        out = None
        for name in sorted(w.state.buckets):
            one = w.documents(name).agg(F.lit(name).alias("bucket"), F.count(F.lit(1)).alias("documents"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else w.spark.createDataFrame([], "bucket string, documents long")
    if what == "BONDS":
        return permitted(w, w.state.bonds, "source", "target")
    if what == "LINKS":
        return permitted(w, w.state.links, "source", "target")
    if what == "CYCLES":
        return graph.cycles(permitted(w, w.state.bonds, "source", "target"))
    if what == "INDEXES":
        return w.spark.createDataFrame([(b, ", ".join(f)) for b, many in w.rules.indexes.items() for f in many], "bucket string, fields string")
    return w.spark.createDataFrame([(r["kind"], str(r)) for r in w.rules.listed if what.startswith(r["kind"].upper()[:4])], "kind string, rule string")


def run_describe(w: Workspace, s: Statement) -> DataFrame:
    if s.what.upper() == "BUCKETS":
        return run_show(w, Statement("show", {"what": "BUCKETS"}))
    if s.what.upper() == "MEANING":
        return w.report(text="FIND <bucket> MEANING \"<words>\" ranks by the dot product of embeddings")
    return infer_schema(w.bucket(s.what).df, w.bucket(s.what).key)


def run_peer(w: Workspace, s: Statement) -> DataFrame:
    inner = s.inner
    if s.what == "execution":
        return graph.triangles(w.state.bonds)
    if s.what == "cost":
        rows = w.documents(inner.bucket).count()
        got = cost.explain_cost(rows, [(f, op) for _, f, op, _ in inner.get("where", [])], [f for many in w.rules.indexes.get(inner.bucket, []) for f in many], bool(inner.get("order")))
        return w.report(**got)
    df = w.execute(inner)
    return w.report(plan=df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def run_undo_show(w: Workspace, s: Statement) -> DataFrame:
    return w.state.audit.orderBy(F.desc("seq"))


def run_undo(w: Workspace, s: Statement) -> DataFrame:
    """States to go back to; the workspace takes them on."""
    back = timeseries.undo_to(w.state.audit, s.seq)
    for name in {r["bucket"] for r in w.state.audit.where(F.col("seq") >= s.seq).select("bucket").distinct().toLocalIterator()}:
        b = w.bucket(name)
        own = back.where(F.startswith("gid", F.lit(f"{name}:")))
        rest = b.df.join(own.select("gid"), graph.gid(name, b.key) == F.col("gid"), "left_anti")
        old = own.where("state is not null").select(F.from_json("state", b.df.schema).alias("d")).select("d.*")
        w.bind(name, rest.unionByName(old), "UNDO")
    return back


def run_rewind(w: Workspace, s: Statement) -> DataFrame:
    return timeseries.rewind(w.state.audit.where(F.col("gid") == s.gid), moment(s.at, w.clock()))


def run_help(w: Workspace, s: Statement) -> DataFrame:
    from brindle.plans.language import READERS

    return w.spark.createDataFrame([(x,) for x in sorted(READERS)], "statement string")
