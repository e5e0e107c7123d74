"""Loading and storing schemaless documents, and what their fields look like."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
CLOCK = re.compile(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$")
DATE_NAME = re.compile(r"(^|_)(date|time|timestamp|at|on|created|updated|expires?)$", re.I)
SAMPLE = 50


def load_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents as id and body VARIANT, bad lines). Blank lines are skipped; _id, then gid, is the id."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("body", F.expr("try_parse_json(value)"))
    good = parsed.where("body is not null")
    text = lambda k: F.expr(f"try_variant_get(body, '$.{k}', 'string')")
    docs = good.select(F.coalesce(text("_id"), text("gid"), F.lower(F.hex(F.xxhash64("value")))).alias("id"), "body")
    return docs, parsed.where("body is null").select(F.col("value").alias("line"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row; each cell an integer, else a number, else text, as a VARIANT."""
    raw = spark.read.csv(path, header=True)
    cell = lambda c: F.expr(f"coalesce(to_variant_object(try_cast(`{c}` AS bigint)), to_variant_object(try_cast(`{c}` AS double)), to_variant_object(`{c}`))")
    try:
        out = raw.select(*[cell(c).alias(c) for c in raw.columns])
        out.schema  # noqa: B018  analysed now
        return out
    except Exception:
        return spark.read.csv(path, header=True, inferSchema=True)


def dump_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def shred(docs: DataFrame, schema: str) -> DataFrame:
    """Bind schemaless documents to typed columns; what does not fit is null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return docs.select("id", *[F.expr(f"try_variant_get(body, '$.{n}', '{k}')").alias(n) for n, k in fields])


def value_kind(name: str, value: object) -> str:
    """The displayed type of one value."""
    if isinstance(value, dict):
        return "object"
    if isinstance(value, (list, tuple)):
        return "array"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if hasattr(value, "isoformat"):
        return "date"
    if isinstance(value, str):
        s = value.strip()
        if ISO.match(s):
            return "date"
        if CLOCK.match(s):
            return "time"
        if s.lower() in ("true", "false"):
            return "boolean"
        if re.fullmatch(r"[+-]?\d+", s):
            return "integer"
        if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", s):
            return "float"
        return "string"
    if isinstance(value, (int, float)) and DATE_NAME.search(name) and 1e8 <= abs(value) <= 1e13:
        return "date"
    return "integer" if isinstance(value, int) else "float"


def widen(a: str, b: str) -> str:
    """What two values of a field make together: null and text yield, an integer becomes a float."""
    if a == b:
        return a
    for weak in ("null", "string"):
        if a == weak:
            return b
        if b == weak:
            return a
    return "float" if {a, b} == {"integer", "float"} else a


def infer_schema(df: DataFrame, order: str) -> DataFrame:
    """(field, kind) from the first 50 rows by ``order``; names with a leading _ are left out."""
    kinds: dict[str, str] = {}
    for row in df.orderBy(order).limit(SAMPLE).collect():  # a bounded sample
        for name, value in row.asDict(recursive=True).items():
            if not name.startswith("_"):
                kind = value_kind(name, value)
                kinds[name] = widen(kinds[name], kind) if name in kinds else kind
    rows = [(n, "string" if k == "null" else k) for n, k in kinds.items()]
    return df.sparkSession.createDataFrame(rows, "field string, kind string")
