"""Labelled relationships as an edge table: joins for what is bounded, loops for what is not.

Edges have ``source``, ``target``, ``label`` and, where an operator says so,
``status``, ``created_at``, ``expires_at`` and a condition. Loops write each
round to the shared checkpoint folder and carry only their new rows.
"""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="brindle-"))
    return df.checkpoint()


def gid(bucket: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{bucket}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    turned = {"source": "target", "target": "source"}
    return edges.select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns])


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """OUT as they are, IN turned round, BOTH either way (a self link once)."""
    if direction == "OUT":
        return edges
    if direction == "IN":
        return reversed_edges(edges)
    return edges.unionByName(reversed_edges(edges.where("source <> target")))


def related(bonds: DataFrame, docs: DataFrame, source: str, label: str, at: object = None, candidates: bool = False, now: Column | None = None) -> DataFrame:
    """Targets of one hop, one row a target: active, candidate (unmet condition) or latched (no such document yet).

    at: as of that moment, created_at <= at < expires_at. A conditional bond is
    open if the named field of its target or source has the value.
    """
    hop = bonds.where((F.col("source") == source) & (F.col("label") == label) & (F.col("status") != "expired"))
    if at is not None:
        moment = F.lit(at)
        hop = hop.where((F.col("created_at") <= moment) & (F.col("expires_at").isNull() | (F.col("expires_at") > moment)))
    joined = hop.join(docs.withColumnRenamed("gid", "_gid"), F.col("target") == F.col("_gid"), "left")
    met = F.col("condition_field").isNull() | F.coalesce(F.col("condition_value") == F.col("condition_now"), F.lit(False)) if "condition_now" in docs.columns else F.col("condition_field").isNull()
    status = F.when(F.col("_gid").isNull(), "latched").when(~met, "candidate").otherwise("active")
    out = joined.withColumn("bond_status", status)
    if not candidates:
        out = out.where("bond_status <> 'candidate'")
    first = Window.partitionBy("target").orderBy("created_at", "bond_status")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_gid")


def chain(bonds: DataFrame, start: DataFrame, labels: list[str], now: object = None) -> DataFrame:
    """Distinct ends of a walk over ``labels`` in order; bonds past their end (strictly) do not count."""
    live = bonds if now is None else bonds.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))
    frontier = start.select(F.col(start.columns[0]).alias("node")).distinct()
    for label in labels:
        step = live.where(F.col("label") == label).select(F.col("source").alias("node"), "target")
        frontier = frontier.join(step, "node").select(F.col("target").alias("node")).distinct()
    return frontier


def match_path(bonds: DataFrame, nodes: list[tuple[str, DataFrame]], hops: list[tuple[str, str]]) -> DataFrame:
    """Rows of columns ``alias.field``; hops: (label, OUT|IN|BOTH). Nodes may repeat; one row a bond."""
    named = lambda alias, df: df.select(*[F.col(c).alias(f"{alias}.{c}") for c in df.columns])
    alias, df = nodes[0]
    out = named(alias, df)
    for i, ((label, direction), (to, docs)) in enumerate(zip(hops, nodes[1:])):
        edges = directed(bonds.where(F.col("label") == label).select("source", "target"), direction).toDF(f"_s{i}", f"_t{i}")
        out = out.join(edges, F.col(f"`{alias}.gid`") == F.col(f"_s{i}")).join(named(to, docs), F.col(f"_t{i}") == F.col(f"`{to}.gid`")).drop(f"_s{i}", f"_t{i}")
        alias = to
    return out


def dangling(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges whose target does not exist."""
    return edges.join(docs.select(F.col("gid").alias("target")), "target", "left_anti").select(*edges.columns)


def heal(edges: DataFrame, docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Edges with both ends; those that ``keep`` names (latched bonds, web links) stay whatever is missing."""
    known = docs.select("gid")
    free = edges.where(keep) if keep is not None else None
    bound = edges.where(~F.coalesce(keep, F.lit(False))) if keep is not None else edges
    out = bound.join(known.withColumnRenamed("gid", "source"), "source", "left_semi").join(known.withColumnRenamed("gid", "target"), "target", "left_semi").select(*edges.columns)
    return out if free is None else out.unionByName(free)


def late_binding(left: DataFrame, field: Column, right: DataFrame, allow_unresolved: bool = True) -> DataFrame:
    """fused where the target exists, else pending; fields of the target come as _joined_<name>."""
    target = right.select(*[F.col(c).alias(f"_joined_{c}") for c in right.columns])
    joined = left.withColumn("_target", field).join(target, F.col("_target") == F.col("_joined_gid"), "left" if allow_unresolved else "inner")
    return joined.withColumn("_bond_status", F.when(F.col("_target").isNull(), F.lit(None).cast("string")).when(F.col("_joined_gid").isNull(), "pending").otherwise("fused")).drop("_target")


def resolve_latches(bonds: DataFrame, docs: DataFrame, now: object) -> DataFrame:
    """Status of each bond: expired stays so, and comes first once ``now`` has reached the lease's end."""
    known = docs.select("gid")
    with_ends = bonds.join(known.withColumnRenamed("gid", "_s"), F.col("source") == F.col("_s"), "left").join(known.withColumnRenamed("gid", "_t"), F.col("target") == F.col("_t"), "left")
    over = (F.col("status") == "expired") | (F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.lit(now)))
    status = F.when(over, "expired").when(F.col("_s").isNotNull() & F.col("_t").isNotNull(), "active").otherwise("latched")
    return with_ends.withColumn("status", status).select(*bonds.columns)


def sweep(bonds: DataFrame, now: object) -> DataFrame:
    """What is left when ends of life before ``now`` are removed."""
    return bonds.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))


def latch_stats(bonds: DataFrame) -> DataFrame:
    held = F.col("status") == "latched"
    return bonds.agg(F.count(F.when(held, 1)).alias("active_latches"), F.count_distinct(F.when(held, F.col("target"))).alias("unique_targets"), F.count(F.lit(1)).alias("total_bonds"))


def exclusive(bonds: DataFrame) -> DataFrame:
    """Only the latest bond of a source and label stays active; earlier ones expire."""
    later = Window.partitionBy("source", "label").orderBy(F.desc("created_at"), F.desc("target"))
    return bonds.withColumn("status", F.when(F.row_number().over(later) == 1, F.col("status")).otherwise("expired"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None, direction: str = "OUT", include_start: bool = False) -> DataFrame:
    """(node, hop) by breadth: the fewest hops from any start, at most ``depth`` (None: until nothing is new)."""
    step = directed(edges.select("source", "target"), direction).distinct().toDF("_from", "_to")
    seen = checkpointed(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in count(1) if depth is None else range(1, depth + 1):
        found = frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:  # or the plan grows with the depth
            seen = checkpointed(seen)
    return seen if include_start else seen.where("hop > 0")


def path_authorized(edges: DataFrame, start: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """(node, authorized, length) for each goal; a start reaches itself in 0."""
    near = reach(edges, start, depth, include_start=True)
    goal = goals.select(F.col(goals.columns[0]).alias("node")).distinct()
    return goal.join(near, "node", "left").select("node", F.col("hop").isNotNull().alias("authorized"), F.col("hop").alias("length"))


#: Nodes in one array of ``closure``, about.
CHUNK = 1000


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct edges, (node, c) with the component of each of their nodes, and (cu, cv) the edges between components."""
    step = checkpointed(edges.select("source", "target").distinct())
    nodes = step.select(F.col("source").alias("node")).union(step.select("target")).distinct()
    member = checkpointed(nodes.join(cycles(step), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    between = step.join(member.toDF("source", "cu"), "source").join(member.toDF("target", "cv"), "target").where("cu <> cv")
    return step, member, checkpointed(between.select("cu", "cv").distinct())


def _between(dag: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(cu, cv): the component cv can be reached from another, cu, of ``starts`` (cu) if given.

    Semi-naive: a round joins only the last round's new pairs with the edges,
    until none is new. What is known is kept as one table a round and put
    together every few rounds, so a long path does not rewrite it each time.
    """
    step = dag.toDF("eu", "ev")
    known = new = dag if starts is None else checkpointed(dag.join(starts, "cu", "left_semi"))
    for n in count(1):
        grown = new.join(step, F.col("cv") == F.col("eu")).select("cu", F.col("ev").alias("cv")).distinct()
        new = checkpointed(grown.join(known, ["cu", "cv"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if n % 8 == 0:
            known = checkpointed(known)


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(u, v): v can be reached from u, of ``starts`` if given. Pairs of a node with itself only where it links to itself.

    Only pairs of strongly connected components are searched and kept. Their
    nodes, in arrays of about ``CHUNK``, become pairs when the result is read,
    so the disk holds no row for each pair.
    """
    step, member, dag = condensed(edges)
    loops = step.where("source = target").select(F.col("source").alias("u"), F.col("target").alias("v"))
    first = member
    if starts is not None:
        start = starts.select(F.col(starts.columns[0]).alias("node")).distinct()
        first, loops = checkpointed(member.join(start, "node", "left_semi")), loops.join(start.toDF("u"), "u", "left_semi")
    inside = member.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("cu"), F.col("c").alias("cv"))
    pairs = _between(dag, None if starts is None else first.select(F.col("c").alias("cu")).distinct()).unionByName(inside)

    def chunks(nodes: DataFrame, c: str, name: str) -> DataFrame:
        sizes = nodes.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n"))
        part = F.pmod(F.xxhash64("node"), F.col("n")).alias(f"{name}_part")
        return nodes.join(sizes, "c").groupBy(F.col("c").alias(c), part).agg(F.collect_list("node").alias(name))

    met = pairs.join(chunks(first, "cu", "us"), "cu").join(chunks(member, "cv", "vs"), "cv")
    met = met.repartition("cu", "us_part", "cv", "vs_part")  # or one task would write out all pairs of a component
    return met.select(F.explode("us").alias("u"), "vs").select("u", F.explode("vs").alias("v")).where("u <> v").unionByName(loops)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing leads to or that lead nowhere, round by round."""
    n = edges.count()
    while n:
        edges = checkpointed(edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, c): the greatest node from which each can be reached, itself included."""
    state = checkpointed(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct().withColumn("c", F.col("node")).withColumn("new", F.lit(True)))
    while True:
        sent = state.where("new").join(edges, F.col("node") == F.col("source")).groupBy("target").agg(F.max("c").alias("got"))
        state = checkpointed(state.join(sent, F.col("node") == F.col("target"), "left").select("node", F.greatest("c", "got").alias("c"), F.coalesce(F.col("got") > F.col("c"), F.lit(False)).alias("new")))
        if state.where("new").isEmpty():
            return state.select("node", "c")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node) of strongly connected components of more than one node or with a self link.

    Without the closure: edges off every cycle are trimmed, each node takes the
    greatest node that reaches it as its colour, and what reaches a colour's own
    node inside the colour is a component; it goes, and the rest follows.
    """
    loops = edges.where("source = target").select(F.col("source").alias("node")).distinct()
    left = checkpointed(edges.where("source <> target").select("source", "target").distinct())
    found = None
    while not (left := _trimmed(left)).isEmpty():
        colour = _colours(left)
        inside = left.join(colour.toDF("source", "cs"), "source").join(colour.toDF("target", "ct"), "target").where("cs = ct").select("source", "target")
        back = reach(inside, colour.where("node = c").select("node"), None, "IN", include_start=True)
        whole = checkpointed(back.select("node").join(colour, "node"))
        found = whole if found is None else found.unionByName(whole)
        gone = whole.select("node")
        left = checkpointed(left.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select("source", "target"))
    if found is None:
        return loops.select(F.col("node").alias("component"), "node")
    parts = found.groupBy("c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = found.join(parts, "c").select("component", "node")
    return members.unionByName(loops.join(members, "node", "left_anti").select(F.col("node").alias("component"), "node"))


def closes_cycle(new: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges that would close a cycle: self links, and those whose target already reaches the source.

    Asked of components, from those of the targets alone; no pair of nodes is made but the new edges.
    """
    _, member, dag = condensed(edges)
    asked = new.where("source <> target").join(member.toDF("target", "_cu"), "target").join(member.toDF("source", "_cv"), "source").select(*new.columns, "_cu", "_cv")
    asked = checkpointed(asked)
    reached = _between(dag, asked.where("_cu <> _cv").select(F.col("_cu").alias("cu")).distinct()).toDF("_cu", "_cv")
    far = asked.where("_cu <> _cv").join(reached, ["_cu", "_cv"], "left_semi")
    return new.where("source = target").unionByName(asked.where("_cu = _cv").unionByName(far).select(*new.columns))


def rejected_by_cycle_guard(new: DataFrame, pairs: DataFrame) -> DataFrame:
    """New edges that would close a cycle: self links, and those whose target already reaches the source."""
    back = pairs.select(F.col("u").alias("target"), F.col("v").alias("source"))
    loops = new.where("source = target")
    return loops.unionByName(new.where("source <> target").join(back, ["source", "target"], "left_semi").select(*new.columns))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a->b, b->c, c->a over distinct edges, all rotations; a self link gives (a, a, a).

    Each triangle is built once, from its smallest node: paths out of the
    smallest are joined with the closing edge, and the rotations follow.
    """
    e = edges.select("source", "target").distinct()
    from_low = e.where("source < target").toDF("a", "b")
    middle = e.where("source <> target").toDF("b", "c")
    closing = e.where("source > target").toDF("c", "a")
    once = from_low.join(middle, "b").where("c > a").join(closing, ["a", "c"], "left_semi")
    turned = once.select(F.explode(F.array(F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c")), F.struct(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))).alias("t")).select("t.a", "t.b", "t.c")
    loops = e.where("source = target").select(F.col("source").alias("a"), F.col("source").alias("b"), F.col("source").alias("c"))
    return turned.unionByName(loops)


def as_of(history: DataFrame, moment: object) -> DataFrame:
    """Bonds that stand at ``moment``: the last event of each (source, target, label) is not a SEVER."""
    past = history.where(F.col("event_time") <= F.lit(moment))
    last = past.groupBy("source", "target", "label").agg(F.max(F.struct("event_time", "event_id", "event_type")).alias("e"))
    return last.where("e.event_type <> 'SEVER'").select("source", "target", "label", F.col("e.event_time").alias("since"))


def changes_between(history: DataFrame, node: str, label: str, low: object, high: object) -> DataFrame:
    at_end = (F.col("source") == node) | (F.col("target") == node)
    return history.where((F.col("label") == label) & at_end & F.col("event_time").between(F.lit(low), F.lit(high))).orderBy("event_time", "event_id")


def cascade_one_level(bonds: DataFrame, drained: DataFrame) -> DataFrame:
    """Targets that go with their drained sources, one level."""
    return bonds.where("cascade").join(drained.select(F.col("gid").alias("source")), "source", "left_semi").select(F.col("target").alias("gid")).distinct()


def cascade_all(edges: DataFrame, victims: DataFrame, depth: int | None = None) -> DataFrame:
    """Record engine: whoever refers to a victim by a cascading edge is one too, to any depth."""
    back = reversed_edges(edges.where("on_delete = 'cascade'").select("source", "target"))
    return reach(back, victims, depth, include_start=True).select(F.col("node").alias("gid"))


def restricting(edges: DataFrame, victims: DataFrame) -> DataFrame:
    """References that forbid the delete: restrict edges from a survivor to a victim."""
    gone = victims.select("gid")
    held = edges.where("on_delete = 'restrict'").join(gone.withColumnRenamed("gid", "target"), "target", "left_semi")
    return held.join(gone.withColumnRenamed("gid", "source"), "source", "left_anti").select(*edges.columns)


def suggest_references(left: DataFrame, fields: list[str], docs: DataFrame) -> DataFrame:
    """Fields that hold another document's gid (0.95) or bare id (0.75), joined by value."""
    values = left.select("gid", F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("value")).where("value is not null")
    whole = values.join(docs.select(F.col("gid").alias("to"), F.col("gid").alias("value")), "value").withColumn("score", F.lit(0.95))
    bare = values.join(docs.select(F.col("gid").alias("to"), F.substring_index("gid", ":", -1).alias("value")), "value").withColumn("score", F.lit(0.75))
    bare = bare.where(F.substring_index("gid", ":", 1) != F.substring_index("to", ":", 1))
    return whole.unionByName(bare).where("gid <> to").select("gid", "to", "score")


def best_suggestions(candidates: DataFrame, bonds: DataFrame) -> DataFrame:
    """The best score of each unordered pair that no bond joins yet."""
    pair = candidates.select(F.least("gid", "to").alias("a"), F.greatest("gid", "to").alias("b"), "score").groupBy("a", "b").agg(F.round(F.max("score"), 2).alias("score"))
    known = bonds.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return pair.join(known, ["a", "b"], "left_anti")


def key_candidates(child: DataFrame, parent: DataFrame, child_name: str, parent_name: str, parent_key: str) -> DataFrame:
    """Likely references of ``child`` to ``parent``: by name, type and overlap of values.

    Name 0.4 (whole) or 0.2 (part), type 0.1, overlap up to 0.4; over 0.8 strict, over 0.5 firm.
    """
    spark, kinds = child.sparkSession, dict(child.dtypes)
    wanted = dict(parent.dtypes)[parent_key]
    keys = parent.select(F.col(parent_key).alias("v")).distinct()
    rows = None
    for field in child.columns:
        plain = field.lower().split("_", 1)[-1] if "_" in field else field.lower()
        stem = plain.removesuffix("_id").removesuffix("key").removesuffix("id").strip("_")
        named = 0.4 if stem and (parent_name.startswith(stem) or stem == parent_name.rstrip("s")) else 0.2 if stem and stem[:3] == parent_name[:3] else 0.0
        if kinds[field] != wanted or not named:
            continue
        own = child.select(F.col(field).alias("v")).where("v is not null").distinct()
        got = own.join(keys.withColumn("hit", F.lit(1)), "v", "left").agg((F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("overlap"))
        score = F.round(F.lit(named + 0.1) + F.least(F.lit(0.4), F.col("overlap") * 0.5), 4)
        row = got.select(F.lit(f"{child_name}.{field}").alias("field"), F.lit(f"{parent_name}.{parent_key}").alias("refers_to"), F.round("overlap", 4).alias("overlap"), score.alias("score"))
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        return spark.createDataFrame([], "field string, refers_to string, overlap double, score double, enforcement string")
    return rows.withColumn("enforcement", F.when(F.col("score") > 0.8, "strict").when(F.col("score") > 0.5, "firm").otherwise("soft"))

