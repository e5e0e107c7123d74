"""The record API: find, count, agg, follow, dangling over declared relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.expressions import moment
from brindle.functions.predicates import any_element
from brindle.operators.graph import cascade_all, checkpointed, reach, restricting
from brindle.operators.search import WORDS, all_words, bm25, parse_query_string


@dataclass
class Collection:
    df: DataFrame
    key: str
    ts: str | None = None
    text: str | None = None
    #: relation name: (column, target collection)
    relations: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: relation name: cascade or restrict, what a delete of the target does
    rules: dict[str, str] = field(default_factory=dict)


class Records:
    def __init__(self) -> None:
        self.collections: dict[str, Collection] = {}

    def add(self, name: str, df: DataFrame, key: str, ts: str | None = None, text: str | None = None) -> Records:
        self.collections[name] = Collection(df, key, ts, text)
        return self

    def relate(self, name: str, relation: str, column: str, target: str, on_delete: str | None = None) -> Records:
        self.collections[name].relations[relation] = (column, target)
        if on_delete in ("cascade", "restrict"):
            self.collections[name].rules[relation] = on_delete
        return self

    def edges(self) -> DataFrame:
        out = None
        for name, c in self.collections.items():
            for relation, (column, target) in c.relations.items():
                e = c.df.where(F.col(column).isNotNull()).select(F.concat(F.lit(f"{name}/"), F.col(c.key).cast("string")).alias("source"), F.concat(F.lit(f"{target}/"), F.col(column).cast("string")).alias("target"), F.lit(f"{name}.{relation}").alias("label"))
                out = e if out is None else out.unionByName(e)
        return out

    def get(self, name: str, key: object) -> DataFrame:
        c = self.collections[name]
        return c.df.where(F.col(c.key) == F.lit(key))

    def _filtered(self, name: str, text: str | None = None, where: list[tuple[str, str, float]] = (), near: str | None = None, depth: int = 1, since: object = None, until: object = None) -> DataFrame:
        c = self.collections[name]
        df, kinds = c.df, dict(c.df.dtypes)
        test: Column = F.lit(True)
        for f, op, value in where:
            test = test & any_element(F.col(f), kinds[f], op, value)
        if since is not None:
            test = test & (F.col(c.ts) >= F.lit(_time(since, kinds[c.ts])))
        if until is not None:
            test = test & (F.col(c.ts) <= F.lit(_time(until, kinds[c.ts])))
        if text:
            test = test & all_words(df, c.text, text)
        df = df.where(test)
        if near is not None:
            spark = df.sparkSession
            around = reach(self.edges(), spark.createDataFrame([(near,)], "node string"), depth, "BOTH").where(F.startswith("node", F.lit(f"{name}/")))
            keys = around.select(F.expr(f"try_cast(substring_index(node, '/', -1) AS {kinds[c.key]})").alias(c.key))
            df = df.join(keys, c.key, "left_semi").select(*c.df.columns)
        return df

    def find(self, name: str, *, order: str = "newest", limit: int | None = 20, join: list[str] = (), **filters) -> DataFrame:
        """order: newest, oldest or score; limit None gives all rows; joins attach ``joined_<relation>`` after the limit, null if absent.

        A join named ``collection.relation`` attaches the many rows that refer to
        each, as an array sorted by key: ``joined_<collection>_<relation>``.
        """
        c = self.collections[name]
        df = self._filtered(name, **filters)
        if order == "score" and filters.get("text"):
            # by the words that the filter found, over the statistics of the whole collection
            scores = bm25(c.df, c.key, c.text, filters["text"], WORDS, prefixes=True)
            ranked = df.join(scores, c.key, "left").orderBy(F.desc_nulls_last("score"), *([F.desc(c.ts)] if c.ts else []), c.key)
        else:
            stamp = c.ts or c.key
            ranked = df.orderBy(F.desc(stamp) if order != "oldest" else F.asc(stamp), c.key)
        out = ranked if limit is None else ranked.limit(limit)
        for relation in join:
            if relation not in c.relations:  # "orders.customer" from customer: the many rows that refer here
                many, _, back = relation.partition(".")
                m = self.collections[many]
                each = m.df.select(F.col(m.relations[back][0]).alias("_k"), F.struct(m.key, *[x for x in m.df.columns if x != m.key]).alias("r"))
                each = each.join(out.select(F.col(c.key).alias("_k")).distinct(), "_k", "left_semi").groupBy("_k").agg(F.array_sort(F.collect_list("r")).alias(f"joined_{many}_{back}"))
                out = out.join(each, F.col(c.key) == F.col("_k"), "left").drop("_k")
                continue
            column, target = c.relations[relation]
            t = self.collections[target]
            other = t.df.select(F.col(t.key).alias("_k"), F.struct(*t.df.columns).alias(f"joined_{relation}"))
            out = out.join(other, F.col(column) == F.col("_k"), "left").drop("_k")
        return out

    def count(self, name: str, **filters) -> DataFrame:
        return self._filtered(name, **filters).agg(F.count(F.lit(1)).alias("count"))

    def agg(self, name: str, field_: str, **filters) -> DataFrame:
        from brindle.operators.aggregate import exact_average, exact_sum

        x = F.col(field_)
        return self._filtered(name, **filters).agg(F.count(x).alias("count"), exact_sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), exact_average(x).alias("avg"))

    def follow(self, name: str, key: object, relation: str | None = None, depth: int = 1, direction: str = "OUT", limit: int | None = 200_000) -> DataFrame:
        """(node, hop) of what exists, the start excluded, nearest first; limit None gives all."""
        edges = self.edges()
        if relation:
            edges = edges.where(F.col("label") == (relation if "." in relation else f"{name}.{relation}"))
        start = edges.sparkSession.createDataFrame([(f"{name}/{key}",)], "node string")
        known = None
        for n, c in self.collections.items():
            k = c.df.select(F.concat(F.lit(f"{n}/"), F.col(c.key).cast("string")).alias("node"))
            known = k if known is None else known.unionByName(k)
        out = reach(edges, start, depth, direction).join(known, "node", "left_semi").orderBy("hop", "node")
        return out if limit is None else out.limit(limit)

    def dangling(self, name: str, relation: str) -> DataFrame:
        c = self.collections[name]
        column, target = c.relations[relation]
        t = self.collections[target]
        return c.df.where(F.col(column).isNotNull()).join(t.df.select(F.col(t.key).alias(column)), column, "left_anti").select(c.key, column)

    def put(self, name: str, rows: DataFrame) -> Records:
        """Rows replace those of the same key; of several rows of one key the last in column order stays."""
        c = self.collections[name]
        order = Window.partitionBy(c.key).orderBy(*[F.desc_nulls_last(x) for x in rows.columns if x != c.key])
        new = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        kept = c.df.join(new.select(c.key), c.key, "left_anti").select(*c.df.columns)
        c.df = checkpointed(kept.unionByName(new, allowMissingColumns=True))
        return self

    def referring(self) -> DataFrame:
        """Edges of relations with a rule: (source, target, label, on_delete)."""
        out = None
        for name, c in self.collections.items():
            for relation, rule in c.rules.items():
                column, target = c.relations[relation]
                e = c.df.where(F.col(column).isNotNull()).select(F.concat(F.lit(f"{name}/"), F.col(c.key).cast("string")).alias("source"), F.concat(F.lit(f"{target}/"), F.col(column).cast("string")).alias("target"), F.lit(f"{name}.{relation}").alias("label"), F.lit(rule).alias("on_delete"))
                out = e if out is None else out.unionByName(e)
        return out

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        """Delete the rows of ``keys`` and what cascades from them; (gid) of all that went.

        A row that survives and refers to one that goes by a ``restrict``
        relation forbids the delete: ValueError, and nothing goes.
        """
        c = self.collections[name]
        gone = keys.select(F.concat(F.lit(f"{name}/"), F.col(keys.columns[0]).cast("string")).alias("gid")).distinct()
        edges = self.referring()
        if edges is not None:
            gone = checkpointed(cascade_all(edges, gone))
            if not restricting(edges, gone).isEmpty():
                raise ValueError(f"rows of {name} are still referred to")
        for other, o in self.collections.items():
            own = gone.where(F.startswith("gid", F.lit(f"{other}/"))).select(F.expr(f"try_cast(substring(gid, {len(other) + 2}) AS {dict(o.df.dtypes)[o.key]})").alias(o.key))
            o.df = o.df.join(own, o.key, "left_anti").select(*o.df.columns)
        return gone

    def expire(self, name: str, before: object) -> DataFrame:
        """What is left once rows older than ``before`` are deleted by the rules of their relations."""
        c = self.collections[name]
        self.delete(name, c.df.where(F.col(c.ts) < F.lit(before)).select(c.key))
        return self.collections[name].df

    def query(self, text: str) -> DataFrame:
        q = parse_query_string(text)
        given = {k: q[k] for k in ("near", "depth", "since", "until") if k in q}
        return self.find(q["in"], text=" ".join(q["words"]) or None, where=q["where"], order=q.get("order", "newest"), limit=q.get("limit", 20), **given)

    def numbers(self, name: str) -> DataFrame:
        """(field, value, key) of every number, arrays element by element; NaN and infinity left out."""
        c, out = self.collections[name], None
        for f, kind in c.df.dtypes:
            if f == c.key or not (kind in ("int", "bigint", "double", "float", "boolean") or kind.startswith("array<")):
                continue
            x = F.explode(F.col(f).cast("array<double>")) if kind.startswith("array") else F.col(f).cast("double")
            rows = c.df.select(F.lit(f).alias("field"), x.alias("value"), F.col(c.key).alias("key")).where("value is not null and not isnan(value) and abs(value) < double('inf')")
            out = rows if out is None else out.unionByName(rows)
        return out


def _time(value: object, kind: str) -> object:
    if kind.startswith("timestamp") and isinstance(value, (str, int, float)):
        at = moment(value)
        return at.replace(tzinfo=None) if kind == "timestamp_ntz" else at
    return value
