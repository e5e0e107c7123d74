"""The workspace: named buckets, relationships, rules, and statements over them.

A bucket is a DataFrame with native columns and a ``gid`` made of its name and
key, so filters and column pruning reach the files. A change binds a new
DataFrame to the name; a transaction keeps the old bindings until it commits.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.expressions import macros, moment
from brindle.operators import graph, mutate
from brindle.operators.govern import Relations, allowed, violation
from brindle.operators.timeseries import rewind
from brindle.plans.language import Statement, parse
from brindle.streaming import interpolate

BONDS = "source string, target string, label string, status string, created_at timestamp, expires_at timestamp, condition_side string, condition_field string, condition_value string, affinity double, confidence double, through string, cascade boolean"
HISTORY = "event_id long, event_type string, event_time timestamp, source string, target string, label string"
LINKS = "source string, target string, label string, is_url boolean, created_at timestamp"
AUDIT = "seq long, ts timestamp, action string, bucket string, gid string, before string, after string"
SYSTEM = ("bonds", "links")
#: Session keys that no statement may set.
IDENTITY = ("user", "role", "auth_level", "tenant", "bypass_masks", "bypass_dls")


class RejectedWrite(ValueError):
    pass


@dataclass
class Bucket:
    df: DataFrame
    key: str
    embedding: str | None = None


@dataclass
class Rules:
    policies: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)
    masks: dict[str, list[tuple[list[str], str, bool]]] = field(default_factory=dict)
    guards: dict[str, list[dict]] = field(default_factory=dict)
    enrich: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    projections: dict[str, tuple[str, list]] = field(default_factory=dict)
    eviction: dict[str, str] = field(default_factory=dict)
    options: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, list[list[str]]] = field(default_factory=dict)
    acyclic: dict[str, str] = field(default_factory=dict)
    listed: list[dict] = field(default_factory=list)


@dataclass
class State:
    buckets: dict[str, Bucket] = field(default_factory=dict)
    rubbish: dict[str, DataFrame] = field(default_factory=dict)
    bonds: DataFrame | None = None
    links: DataFrame | None = None
    history: DataFrame | None = None
    audit: DataFrame | None = None
    views: dict[str, DataFrame] = field(default_factory=dict)
    deltas: dict[str, dict[str, DataFrame]] = field(default_factory=dict)

    def copy(self) -> State:
        return replace(self, buckets=dict(self.buckets), rubbish=dict(self.rubbish), views=dict(self.views), deltas={k: dict(v) for k, v in self.deltas.items()})


class Workspace:
    def __init__(self, spark: SparkSession, embed: Callable[[str], list[float]] | None = None, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.embed = spark, embed
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.context: dict[str, str] = {"role": "viewer"}
        empty = spark.createDataFrame
        self.state = State(bonds=empty([], BONDS), links=empty([], LINKS), history=empty([], HISTORY), audit=empty([], AUDIT))
        self.rules, self.saved, self.branch, self.seq, self.depth = Rules(), None, None, 0, 0

    # -- buckets -----------------------------------------------------------
    def add(self, name: str, df: DataFrame, key: str, embedding: str | None = None) -> Workspace:
        if name.lower() in SYSTEM or name.startswith("_"):
            raise RejectedWrite(f"{name} is reserved")
        self.state.buckets[name] = Bucket(df, key, embedding)
        return self

    def add_bonds(self, df: DataFrame) -> Workspace:
        have = dict(df.dtypes)
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit({"status": "active"}.get(f.name)).cast(f.dataType).alias(f.name) for f in self.state.bonds.schema]
        new = df.select(*cols)
        self.state.bonds = new if self.state.bonds.isEmpty() else self.state.bonds.unionByName(new)
        return self

    def session(self, **identity: str) -> Workspace:
        """Set who asks; statements cannot."""
        self.context |= identity
        return self

    def bucket(self, name: str) -> Bucket:
        if name in self.state.views:
            return Bucket(self.state.views[name], self.state.views[name].columns[0])
        if name not in self.state.buckets:
            raise KeyError(f"no bucket {name}")
        b = self.state.buckets[name]
        delta = self.state.deltas.get(self.branch or "", {}).get(name)
        return b if delta is None else replace(b, df=mutate.overlay(b.df, delta, b.key))

    def tenant_rows(self, df: DataFrame) -> DataFrame:
        """Only the session's tenant, where the bucket has a column of that name."""
        tenant = self.context.get("tenant")
        return df.where(F.col("tenant") == tenant) if tenant and "tenant" in df.columns else df

    def documents(self, name: str) -> DataFrame:
        """The bucket with its gid first."""
        b = self.bucket(name)
        return self.tenant_rows(b.df).select(graph.gid(name, b.key).alias("gid"), *b.df.columns)

    def documents_at(self, name: str, moment_: dt.datetime) -> DataFrame:
        """The bucket as it was, from its audit trail; documents without a trail are as they are now."""
        b, log = self.bucket(name), self.state.audit.where(F.col("bucket") == name)
        states = rewind(log, moment_)
        now = b.df.join(states, graph.gid(name, b.key) == F.col("gid"), "left_anti")
        then = states.where("state is not null").select(F.from_json("state", b.df.schema).alias("d")).select("d.*")
        df = self.tenant_rows(now.unionByName(then))
        return df.select(graph.gid(name, b.key).alias("gid"), *b.df.columns)

    def check_write(self, name: str, rows: DataFrame) -> None:
        """Every row must be admitted by some write policy, if there is one."""
        policies = [cond for action, cond in self.rules.policies.get(name, {}).values() if action in ("write", "all")]
        if policies:
            own = rows.select(graph.gid(name, self.bucket(name).key).alias("gid"), *rows.columns)
            if allowed(own, policies, self.context, self.relations()).count() < rows.count():
                raise RejectedWrite(f"no policy of {name} allows this write")

    def all_gids(self) -> DataFrame:
        out = None
        for name in self.state.buckets:
            g = self.documents(name).select("gid")
            out = g if out is None else out.unionByName(g)
        return out if out is not None else self.spark.createDataFrame([], "gid string")

    def relations(self) -> Relations:
        return Relations(self.state.bonds)

    def now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp")

    # -- statements --------------------------------------------------------
    def run(self, text: str) -> DataFrame:
        return self.execute(parse(text))

    def execute(self, s: Statement) -> DataFrame:
        from brindle.plans import compiler

        reader = getattr(compiler, f"run_{s.kind}", None)
        if reader:
            return reader(self, s)
        return getattr(self, f"do_{s.kind}")(s)

    def report(self, **values: object) -> DataFrame:
        names = list(values)
        return self.spark.createDataFrame([tuple(v if isinstance(v, (int, float, bool, str)) or v is None else json.dumps(v) for v in values.values())], ", ".join(f"{n} {_kind(values[n])}" for n in names))

    def bind(self, name: str, df: DataFrame, action: str) -> None:
        """Make ``df`` the bucket's new content, on the branch if one is active, and audit it if asked."""
        old = self.bucket(name)
        if self.rules.options.get(name, {}).keys() & {"audited", "versioned"}:
            log = mutate.audit_of(old.df, df, old.key)
            self.seq += 1
            self.state.audit = self.state.audit.unionByName(log.select(F.lit(self.seq).cast("long").alias("seq"), self.now().alias("ts"), "action", F.lit(name).alias("bucket"), graph.gid(name, old.key).alias("gid"), "before", "after"))
        if self.branch:
            base = self.state.buckets[name]
            new = df.exceptAll(base.df).withColumn("_deleted", F.lit(False))
            gone = base.df.join(df.select(old.key), old.key, "left_anti").select(*df.columns).withColumn("_deleted", F.lit(True))
            self.state.deltas.setdefault(self.branch, {})[name] = new.unionByName(gone)
        else:
            self.state.buckets[name] = replace(old, df=df)

    def _rows(self, name: str, documents: list[dict]) -> DataFrame:
        documents = [macros(d, self.clock()) for d in documents]
        text = [json.dumps(d) for d in documents]
        shape = None
        if name in self.state.buckets:
            known = self.bucket(name).df
            shape = known.schema
            fresh = sorted({k for d in documents for k in d} - set(known.columns))
            if not fresh:
                raw = self.spark.createDataFrame([(t,) for t in text], "t string")
                return raw.select(F.from_json("t", shape).alias("d")).select("d.*")
        raw = self.spark.createDataFrame([(t,) for t in text], "t string")
        merged = {}
        for d in documents:
            merged |= {k: v for k, v in d.items() if v is not None}
        kind = self.spark.range(1).select(F.schema_of_json(F.lit(json.dumps(merged)))).first()[0]
        out = raw.select(F.from_json("t", F.lit(kind)).alias("d")).select("d.*")
        if shape is not None:
            out = out.select(*[F.col(c).cast(shape[c].dataType).alias(c) if c in shape.names else F.col(c) for c in out.columns])
        return out

    def do_pour_many(self, s: Statement) -> DataFrame:
        return self._pour(s.bucket, [dict(d) | ({} if "_id" in d or "gid" in d else {}) for d in s.documents])

    def do_pour(self, s: Statement) -> DataFrame:
        d = dict(s.document)
        key = self.state.buckets[s.bucket].key if s.bucket in self.state.buckets else "_id"
        if s.key is not None:
            d[key] = s.key
        elif key not in d:
            d[key] = _content_key(s.bucket, d)
        if s.get("ttl"):
            d["_expires_at"] = (self.clock() + dt.timedelta(seconds=s.ttl)).isoformat()
        return self._pour(s.bucket, [d])

    def _pour(self, name: str, documents: list[dict]) -> DataFrame:
        new = self._rows(name, documents)
        broken = new.select(violation(new, [r for r in self.rules.guards.get(name, ()) if "field" in r]).alias("v")).where("v is not null").first()
        if broken:
            raise RejectedWrite(broken["v"])
        if name not in self.state.buckets:
            key = next((k for k in ("_id", "gid") if k in new.columns), new.columns[0])
            self.add(name, new, key)
            return self.report(bucket=name, poured=len(documents))
        b = self.bucket(name)
        old = b.df
        for c in new.columns:
            if c not in old.columns:
                old = old.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
        new = new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        self.check_write(name, new)
        out = mutate.upsert(old, new, b.key)
        most = self.rules.options.get(name, {}).get("max_docs")
        if most and name in self.rules.eviction and "_touched_at" in out.columns:
            out = mutate.evict(out, "_touched_at", b.key, int(most))
        if old.columns != b.df.columns:
            self.state.buckets[name] = replace(self.state.buckets[name], df=old)
        self.bind(name, out, "POUR")
        for d in documents:
            self.fire("POUR", name, d)
        return self.report(bucket=name, poured=len(documents))

    def fire(self, action: str, name: str, document: dict) -> None:
        """Run the statements that a change triggers, at most five deep."""
        for rule in self.rules.listed:
            if rule["kind"] == "trigger" and (rule["action"], rule["bucket"]) == (action, name) and self.depth < 5:
                self.depth += 1
                try:
                    self.run(interpolate(rule["template"], document))
                finally:
                    self.depth -= 1

    def do_change(self, s: Statement) -> DataFrame:
        b = self.bucket(s.bucket)
        values = {}
        for f, v in s.values.items():
            if isinstance(v, Statement):
                inner = self.execute(v)
                v = inner.agg(F.to_json(F.collect_list(F.struct(*inner.columns)))).first()[0]
            elif isinstance(v, (dict, list)):
                v = json.dumps(v)
            values[f] = F.lit(v)
        self.check_write(s.bucket, b.df.where(F.col(b.key).cast("string") == s.key))
        self.bind(s.bucket, mutate.change(b.df, F.col(b.key).cast("string") == s.key, values), "CHANGE")
        return self.report(bucket=s.bucket, changed=s.key)

    def do_drain(self, s: Statement) -> DataFrame:
        from brindle.plans.compiler import where_column

        b = self.bucket(s.bucket)
        if s.get("where"):
            hit = where_column(b.df, s.where)
        elif s.get("before") is not None:
            stamp = next((c for c in ("_created_at", "created_at", "ts") if c in b.df.columns), None)
            hit = F.col(stamp) < F.lit(moment(s.before, self.clock())) if stamp else F.lit(False)
        else:
            hit = F.lit(True) if s.get("key") is None else F.col(b.key).cast("string") == s.key
        kept, gone = mutate.drain(b.df, hit, self.now())
        gids = gone.select(graph.gid(s.bucket, b.key).alias("gid"))
        bucket = F.substring_index("target", ":", 1).alias("bucket")
        for target in [r["bucket"] for r in self.state.bonds.where("cascade").select(bucket).where(F.col("bucket").isin(list(self.state.buckets))).distinct().collect()]:  # at most the buckets
            other = self.bucket(target)
            victims = graph.cascade_one_level(self.state.bonds, gids)
            self.bind(target, other.df.join(victims, graph.gid(target, other.key) == F.col("gid"), "left_anti"), "DRAIN")
        old = self.state.rubbish.get(s.bucket)
        self.state.rubbish[s.bucket] = gone if old is None else old.unionByName(gone, allowMissingColumns=True)
        self.bind(s.bucket, kept, "DRAIN")
        if any(r["kind"] == "trigger" and r["bucket"] == s.bucket and r["action"] == "DRAIN" for r in self.rules.listed):
            for row in gone.toLocalIterator():
                self.fire("DRAIN", s.bucket, row.asDict())
        for side in ("source", "target"):
            self.state.bonds = self.state.bonds.join(gids.withColumnRenamed("gid", side), side, "left_anti").select(*self.state.bonds.columns)
        return self.report(bucket=s.bucket, drained=gone.count())

    def _salvage(self, name: str, where: Column) -> None:
        b = self.bucket(name)
        df, rest = mutate.salvage(b.df, self.state.rubbish[name], where)
        self.state.rubbish[name] = rest
        self.bind(name, df, "POUR")

    def do_salvage(self, s: Statement) -> DataFrame:
        for name in list(self.state.rubbish):
            self._salvage(name, F.lit(True) if s.key is None else F.col(self.bucket(name).key).cast("string") == s.key)
        return self.report(salvaged=s.key or "EVERYTHING")

    def do_incinerate(self, s: Statement) -> DataFrame:
        for name, df in list(self.state.rubbish.items()):
            self.state.rubbish[name] = df.limit(0) if s.key is None else df.where(F.col(self.bucket(name).key).cast("string") != s.key)
        return self.report(incinerated=s.key or "EVERYTHING")

    def do_drop_bucket(self, s: Statement) -> DataFrame:
        b = self.bucket(s.bucket)
        self.state.rubbish[s.bucket] = b.df.withColumn("_deleted_at", self.now())
        self.bind(s.bucket, b.df.limit(0), "DRAIN")
        return self.report(dropped=s.bucket)

    def do_restore_bucket(self, s: Statement) -> DataFrame:
        self._salvage(s.bucket, F.lit(True))
        return self.report(restored=s.bucket)

    # -- relationships -----------------------------------------------------
    def do_bond(self, s: Statement) -> DataFrame:
        if any("://" in t for t in s.targets):
            raise RejectedWrite("a bond's target is a document")
        gids = self.all_gids()
        if gids.where(F.col("gid") == s.source).isEmpty():
            raise RejectedWrite(f"{s.source} does not exist")
        side, cond, value = s.get("condition") or (None, None, None)
        now = self.clock()
        end = now + dt.timedelta(seconds=s.ttl) if s.get("ttl") else None
        rows = [(s.source, t, s.label, "active", now, end, side, cond, None if value is None else str(value), s.get("affinity"), s.get("confidence"), s.get("through"), bool(s.get("cascade"))) for t in s.targets]
        if s.mutual:
            rows += [(r[1], r[0], *r[2:]) for r in rows]
        new = self.spark.createDataFrame([tuple(float(v) if i in (9, 10) and v is not None else v for i, v in enumerate(r)) for r in rows], BONDS)
        label = self.rules.acyclic.get(s.source.split(":", 1)[0])
        if label is not None and (label == s.label or not label):
            if not graph.closes_cycle(new, self.state.bonds.where(F.col("label") == s.label)).isEmpty():
                raise RejectedWrite("the bond would close a cycle")
        new = graph.resolve_latches(new, gids, now)
        if s.get("exclusive"):
            same = (F.col("source") == s.source) & (F.col("label") == s.label)
            self.state.bonds = self.state.bonds.withColumn("status", F.when(same, "expired").otherwise(F.col("status")))
        self.state.bonds = self.state.bonds.unionByName(new)
        self._record("BOND", [(r[0], r[1], r[2]) for r in rows])
        return self.report(bonded=len(rows), label=s.label)

    def _record(self, event: str, edges: list[tuple[str, str, str]]) -> None:
        self.seq += 1
        rows = [(self.seq, event, self.clock(), *e) for e in edges]
        self.state.history = self.state.history.unionByName(self.spark.createDataFrame(rows, HISTORY))

    def do_sever(self, s: Statement) -> DataFrame:
        pair = ((F.col("source") == s.source) & (F.col("target") == s.target)) | ((F.col("source") == s.target) & (F.col("target") == s.source))
        hit = pair if s.label is None else pair & (F.col("label") == s.label)
        gone = [(r["source"], r["target"], r["label"]) for r in self.state.bonds.where(hit).select("source", "target", "label").collect()]
        self.state.bonds = self.state.bonds.where(~hit)
        self.state.links = self.state.links.where(~hit)
        if gone:
            self._record("SEVER", gone)
        return self.report(severed=len(gone))

    def do_link(self, s: Statement) -> DataFrame:
        now = self.clock()
        rows = [(s.source, t, s.label, t.startswith(("http://", "https://", "ftp://")), now) for t in s.targets]
        if s.mutual:
            rows += [(t, src, *rest) for src, t, *rest in rows]
        self.state.links = self.state.links.unionByName(self.spark.createDataFrame(rows, LINKS))
        return self.report(linked=len(rows))

    def do_heal(self, s: Statement) -> DataFrame:
        gids = self.all_gids()
        before = self.state.bonds.count(), self.state.links.count()
        self.state.bonds = graph.resolve_latches(graph.heal(self.state.bonds, gids, F.col("status") == "latched"), gids, self.clock())
        self.state.links = graph.heal(self.state.links, gids, F.col("is_url"))
        return self.report(bonds_removed=before[0] - self.state.bonds.count(), links_removed=before[1] - self.state.links.count())

    # -- rules -------------------------------------------------------------
    def do_policy(self, s: Statement) -> DataFrame:
        self.rules.policies.setdefault(s.bucket, {})[s.name] = (s.action, s.condition)
        return self.report(policy=s.name)

    def do_mask(self, s: Statement) -> DataFrame:
        self.rules.masks.setdefault(s.bucket, []).append((s.fields, s.condition, s.unless))
        return self.report(masked=s.fields)

    def do_drop_security(self, s: Statement) -> DataFrame:
        self.rules.policies.get(s.bucket, {}).pop(s.name, None)
        self.rules.masks[s.bucket] = [m for m in self.rules.masks.get(s.bucket, []) if s.name not in m[0]]
        return self.report(dropped=s.name)

    def do_guard(self, s: Statement) -> DataFrame:
        for r in s.rules:
            if r["kind"] == "acyclic":
                self.rules.acyclic[s.bucket] = next(iter(_quoted(r["condition"])), "")
        self.rules.guards[s.bucket] = [r for r in s.rules if r["kind"] != "acyclic"]
        return self.report(guarded=s.bucket, rules=len(s.rules))

    def do_enrich(self, s: Statement) -> DataFrame:
        self.rules.enrich.setdefault(s.bucket, []).append((s.field, s.expression))
        return self.report(enriched=s.bucket, field=s.field)

    def do_projection(self, s: Statement) -> DataFrame:
        self.rules.projections[s.name] = (s.bucket, s.where)
        return self.report(projection=s.name)

    def do_eviction(self, s: Statement) -> DataFrame:
        self.rules.eviction[s.bucket] = s.policy
        self.rules.options.setdefault(s.bucket, {}).setdefault("max_docs", 100)
        return self.report(policy=s.policy)

    def do_shape_bucket(self, s: Statement) -> DataFrame:
        self.rules.options.setdefault(s.bucket, {}).update(s.options)
        return self.report(bucket=s.bucket, options=sorted(s.options))

    def do_index(self, s: Statement) -> DataFrame:
        self.rules.indexes.setdefault(s.bucket, []).append(s.fields)
        return self.report(indexed=s.fields)

    def _listed(self, s: Statement) -> DataFrame:
        self.rules.listed.append({"kind": s.kind} | {k: v for k, v in s.args.items() if not isinstance(v, Statement)})
        return self.report(registered=s.kind)

    do_webhook = do_every = do_trigger = do_rate_limit = _listed

    def do_set(self, s: Statement) -> DataFrame:
        if s.key in IDENTITY:
            raise RejectedWrite(f"{s.key} is set by the session, not by a statement")
        if s.key == "branch":
            self.branch = s.value if s.value in self.state.deltas else None
        self.context[s.key] = s.value
        return self.report(key=s.key, value=str(s.value))

    # -- transactions and branches ------------------------------------------
    def do_begin(self, s: Statement) -> DataFrame:
        self.saved = self.state.copy()
        return self.report(transaction="begun")

    def do_commit(self, s: Statement) -> DataFrame:
        self.saved = None
        return self.report(transaction="committed")

    def do_rollback(self, s: Statement) -> DataFrame:
        if self.saved is not None:
            self.state, self.saved = self.saved, None
        return self.report(transaction="rolled back")

    def do_branch(self, s: Statement) -> DataFrame:
        self.state.deltas.setdefault(s.name, {})
        return self.report(branch=s.name)

    def do_merge(self, s: Statement) -> DataFrame:
        out = None
        for name, delta in self.state.deltas.pop(s.name).items():
            b = self.state.buckets[name]
            r = mutate.merge_report(b.df, delta, b.key).select(F.lit(name).alias("bucket"), "*")
            out = r if out is None else out.unionByName(r)
            self.state.buckets[name] = replace(b, df=mutate.overlay(b.df, delta, b.key))
        self.branch = None if self.branch == s.name else self.branch
        return out if out is not None else self.report(branch=s.name)

    def do_discard(self, s: Statement) -> DataFrame:
        self.state.deltas.pop(s.name, None)
        self.branch = None if self.branch == s.name else self.branch
        return self.report(discarded=s.name)

    def do_migrate(self, s: Statement) -> DataFrame:
        self.bind(s.bucket, mutate.migrate(self.bucket(s.bucket).df, s.source, s.target), "CHANGE")
        return self.report(migrated=s.bucket)

    def do_flow(self, s: Statement) -> DataFrame:
        from brindle.plans.compiler import where_column

        a, b = self.bucket(s.source), self.bucket(s.target)
        left, right = mutate.copy_flow(a.df, b.df, [(where_column(a.df, s.where), s.action)], a.key)
        self.bind(s.source, left, "DRAIN")
        self.bind(s.target, right.select(*b.df.columns), "POUR")
        return self.report(flow=s.action)


def _content_key(bucket: str, body: dict) -> str:
    import hashlib

    return hashlib.sha256((bucket + json.dumps(body, sort_keys=True)).encode()).hexdigest()[:16]


def _quoted(text: str) -> list[str]:
    return text.split('"')[1::2]


def _kind(v: object) -> str:
    return {bool: "boolean", int: "long", float: "double"}.get(type(v), "string")
