"""Keyword, vector and template search."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.arrays import cosine, dot

K1, B = 1.2, 0.75


def mentioning(df: DataFrame, text: str) -> Column:
    """Case-insensitive, anywhere in the document as JSON (keys and punctuation included)."""
    return F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(text.lower()))


def matching(schema: T.DataType, column: Column, template: object) -> Column:
    """A recursive template: scalars are equal, "*" is anything, key "*" is some value, lists are subsets."""
    if isinstance(template, str) and template == "*":
        return column.isNotNull()
    if isinstance(template, dict):
        out = F.lit(True)
        for key, value in template.items():
            if isinstance(schema, T.StructType):
                if key == "*":
                    one = F.lit(False)
                    for f in schema.fields:
                        one = one | matching(f.dataType, column.getField(f.name), value)
                    out = out & one
                elif key in schema.fieldNames():
                    out = out & matching(schema[key].dataType, column.getField(key), value)
                else:
                    out = out & F.lit(False)
            elif isinstance(schema, T.MapType):
                inner = schema.valueType
                out = out & (F.exists(F.map_values(column), lambda v: matching(inner, v, value)) if key == "*" else matching(inner, F.try_element_at(column, F.lit(key)), value))
            else:
                out = out & F.lit(False)
        return F.coalesce(out, F.lit(False))
    if isinstance(template, list):
        if not isinstance(schema, T.ArrayType):
            return F.lit(False)
        out = F.lit(True)
        for item in template:
            out = out & F.exists(column, lambda x: matching(schema.elementType, x, item))
        return F.coalesce(out, F.lit(False))
    return column.eqNullSafe(F.lit(template))


def matches_json(column: Column, template: dict, schema: T.DataType) -> Column:
    """A template over a text column that holds JSON."""
    return F.coalesce(matching(schema, F.from_json(column, schema), template), F.lit(False))


def template_schema(template: object) -> T.DataType:
    """The shape that a template asks about; keys "*" need a map."""
    if isinstance(template, dict):
        if "*" in template:
            return T.MapType(T.StringType(), template_schema(template["*"]))
        return T.StructType([T.StructField(k, template_schema(v)) for k, v in template.items()])
    if isinstance(template, list):
        return T.ArrayType(template_schema(template[0]) if template else T.StringType())
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(template), T.StringType())


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower case, split at white space."""
    words = F.explode(F.split(F.lower(text), r"\s+")).alias("term")
    return docs.select(key, words).where("term <> ''").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _equals(word: str):
    return lambda x: x == F.lit(word)


def _begins(prefix: str):
    return lambda x: F.startswith(x, F.lit(prefix))


#: Words of the record engine's text search: runs of letters and digits.
WORDS = r"[^\p{L}\p{N}]+"


def bm25(docs: DataFrame, key: str, text: str, query: str, split: str = r"\s+", prefixes: bool = False) -> DataFrame:
    """(key, score) of documents that have any of the words; with ``prefixes``, ``w*`` is any word that begins so.

    Word counts are taken per document without exploding it, so only one row a
    document is aggregated for the statistics; the text is read for them and
    once more for the scores, which is less than keeping the counts of all.
    """
    wanted = list(dict.fromkeys(re.split(r"\s+", query.strip().lower())))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), split), lambda w: w != "")
    like = [_begins(t[:-1]) if prefixes and t.endswith("*") else _equals(t) for t in wanted]
    counts = docs.select(key, words.alias("w")).select(key, F.size("w").alias("dl"), *[F.size(F.filter("w", f)).alias(f"tf{i}") for i, f in enumerate(like)])
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    any_hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        any_hit = any_hit | (tf > 0)
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counts.where(any_hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row


def all_words(docs: DataFrame, text: str, query: str) -> Column:
    """Every word occurs; ``w*`` is a prefix."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS)
    out = F.lit(True)
    for w in query.lower().split():
        out = out & (F.exists(words, _begins(w[:-1])) if w.endswith("*") else F.array_contains(words, w))
    return out


def vector_scores(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(vector) == len(query)).select(key, cosine(F.col(vector), q).alias("score")).where("score is not null")


def vector_top(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` nearest by cosine; none for a zero query."""
    return vector_scores(vectors, key, vector, query).orderBy(F.desc("score"), key).limit(k)


def meaning(vectors: DataFrame, key: str, vector: str, query: list[float], threshold: float = 0.2) -> DataFrame:
    """(key, score): dot product over ``threshold``, rounded to 3 places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, dot(F.col(vector), q).alias("s")).where(F.col("s") > threshold).select(key, F.round("s", 3).alias("score"))


def hybrid(semantic: DataFrame, keyword: DataFrame, key: str, weight: float = 0.7) -> DataFrame:
    """weight of the semantic score, the rest of the keyword score; a missing one is 0."""
    a, b = semantic.withColumnRenamed("score", "_a"), keyword.withColumnRenamed("score", "_b")
    return a.join(b, key, "full").select(key, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, queries: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """(a, b, score), a < b: pairs over a cosine threshold, block by block.

    Each vector goes to one block of rows and to every block it is compared
    with; a block pair is one matrix product on one executor.
    """
    import numpy as np
    import pandas as pd

    unit = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("blk", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    spread = unit.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("blk", o.cast("int")).alias("x"), F.greatest("blk", o.cast("int")).alias("y")))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = pdf[pdf.blk == x], pdf[pdf.blk == y]
        empty = pd.DataFrame({"a": pdf["k"][:0], "b": pdf["k"][:0], "score": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        m, n = (np.stack(s.v.to_list()) for s in (left, right))
        m, n = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (m, n))
        out = [empty]
        for i in range(0, len(m), 1024):
            s = m[i : i + 1024] @ n.T
            r, c = np.nonzero(s > threshold)
            a, b = left.k.to_numpy()[i + r], right.k.to_numpy()[c]
            keep = a < b if x == y else a != b
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[r, c][keep]}))
        return pd.concat(out)

    kind = dict(vectors.dtypes)[key]
    return spread.select("k", "v", "blk", "pair.x", "pair.y").groupBy("x", "y").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def parse_query_string(text: str) -> dict:
    """in: near: depth: since: until: limit: order: field>=number, all else words."""
    out: dict = {"where": [], "words": []}
    for part in text.split():
        named = re.fullmatch(r"(in|near|depth|since|until|limit|order):(.+)", part)
        test = re.fullmatch(r"([\w.]+)(>=|<=|!=|=|>|<)(-?\d+(?:\.\d+)?)", part)
        if named:
            out[named[1]] = int(named[2]) if named[1] in ("depth", "limit") else named[2]
        elif test:
            out["where"].append((test[1], test[2], float(test[3])))
        else:
            out["words"].append(part)
    return out


def classify_intent(df: DataFrame, text: str, keywords: dict[str, list[str]], least: float = 0.4) -> Column:
    """The intent with most of its keywords in the text; under ``least`` "ambiguous"."""
    words = F.split(F.lower(text), r"\W+")
    scores = [F.struct((F.size(F.array_intersect(words, F.array(*map(F.lit, ks)))) / float(len(ks))).alias("s"), F.lit(name).alias("n")) for name, ks in sorted(keywords.items(), reverse=True)]
    best = F.array_max(F.array(*scores))
    return F.when(best["s"] >= least, best["n"]).otherwise("ambiguous")


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Shared character pairs of two texts over all of theirs."""
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
    x, y = grams(F.lower(a)), grams(F.lower(b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def loads(text: str) -> object:
    return json.loads(text)
