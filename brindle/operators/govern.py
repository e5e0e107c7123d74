"""Row policies, field masks and validation rules as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.graph import path_authorized

NUMBER = r"^-?\d+(\.\d+)?$"


@dataclass
class Relations:
    """What conditions over bonds look at."""

    bonds: DataFrame | None = None


def flagged(df: DataFrame, text: str, context: dict[str, str], relations: Relations, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the condition holds for the row.

    Conditions over the session alone fold to a literal; those over bonds join
    a set of reachable documents; the rest compare fields.
    """
    text = text.strip()
    m = re.fullmatch(r"my\s+role\s*(!=|=|==|is)\s*\"?([\w-]+)\"?", text, re.I)
    if m:
        same = context.get("role", "viewer") == m[2]
        return df.withColumn(name, F.lit(same != (m[1] == "!=")))
    m = re.fullmatch(r"EXISTS\s+PATH\s*\(@?(\w+)\)\s*-\s*\[\"?([\w-]+)\"?(\*?)(\d*)\]\s*->\s*\(doc\)", text, re.I)
    if m:
        depth = int(m[4] or 5) if m[3] else 1
        edges = relations.bonds.where(F.col("label") == m[2])
        start = df.sparkSession.createDataFrame([(context.get(m[1], ""),)], "node string")
        return _joined(df, path_authorized(edges, start, df.select("gid"), depth).where("authorized").select(F.col("node").alias("gid")), name)
    m = re.fullmatch(r"bonded\s+as\s+\"([^\"]+)\"\s+to\s+my\s+(\w+)", text, re.I)
    if m:
        me, own = context.get(m[2], ""), relations.bonds.where(F.col("label") == m[1])
        near = own.where(F.col("target") == me).select(F.col("source").alias("gid")).union(own.where(F.col("source") == me).select(F.col("target").alias("gid"))).distinct()
        return _joined(df, near, name)
    return df.withColumn(name, compare_condition(df, text, context))


def _joined(df: DataFrame, allowed: DataFrame, name: str) -> DataFrame:
    return df.join(allowed.select(F.col("gid"), F.lit(True).alias("_ok")), "gid", "left").withColumn(name, F.coalesce("_ok", F.lit(False))).drop("_ok").select(*df.columns, name)


def compare_condition(df: DataFrame, text: str, context: dict[str, str]) -> Column:
    """field op @context (text, any case), @context op literal, field op literal (numbers if both are)."""
    m = re.fullmatch(r"(@?[\w.]+)\s*(==|!=|>=|<=|>|<|is\s+not|is)\s*(@\w+|\"[^\"]*\"|'[^']*'|[\w.\-]+)", text.strip(), re.I)
    if not m:
        return F.lit(False)
    op = re.sub(r"\s+", " ", m[2].lower())
    op = {"is": "==", "is not": "!="}.get(op, op)
    value = m[3]
    right = str(context.get(value[1:], "")) if value.startswith("@") else value.strip("\"'")
    if m[1].startswith("@"):
        left = str(context.get(m[1][1:], "")).lower()
        return F.lit({"==": left == right.lower(), "!=": left != right.lower()}.get(op, False))
    if m[1] not in df.columns:
        return F.lit(False)
    field = F.col(m[1]).cast("string")
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    plain = ops[op](F.lower(field), F.lit(right.lower()))
    if not value.startswith("@") and re.fullmatch(NUMBER, right):
        number = field.try_cast("double")
        plain = F.when(number.isNotNull(), ops[op](number, F.lit(float(right)))).otherwise(plain)
    return F.coalesce(plain, F.lit(False))


def allowed(df: DataFrame, conditions: list[str], context: dict[str, str], relations: Relations) -> DataFrame:
    """Rows that any of the conditions admits; no condition at all admits every row."""
    if not conditions:
        return df
    out, names = df, []
    for i, c in enumerate(conditions):
        names.append(f"_allow{i}")
        out = flagged(out, c, context, relations, names[-1])
    some = F.lit(False)
    for n in names:
        some = some | F.col(n)
    return out.where(some).select(*df.columns)


def masked(df: DataFrame, fields: list[str], condition: str, context: dict[str, str], relations: Relations, unless: bool = False) -> DataFrame:
    """The fields become null where the condition holds (UNLESS: where it does not)."""
    if context.get("bypass_masks"):
        return df
    out = flagged(df, condition, context, relations, "_mask")
    hide = ~F.col("_mask") if unless else F.col("_mask")
    return out.withColumns({f: F.when(~hide, F.col(f)) for f in fields if f in df.columns}).select(*df.columns)


def violation(df: DataFrame, rules: list[dict]) -> Column:
    """The first broken rule of each row, else null.

    Rules: {field, kind: required | forbidden | type | in | compare | length, value, op}.
    """
    kinds, broken = dict(df.dtypes), []
    for r in rules:
        f, kind = r["field"], r["kind"]
        there = F.col(f).isNotNull() if f in kinds else F.lit(False)
        x = F.col(f) if f in kinds else F.lit(None)
        ops = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}
        if kind == "required":
            bad = ~there
        elif kind == "forbidden":
            bad = there
        elif kind == "type":
            own = kinds.get(f, "")
            good = {"string": own == "string", "number": own in ("int", "bigint", "double", "float", "smallint", "tinyint") or own.startswith("decimal"), "boolean": own == "boolean", "list": own.startswith("array")}[r["value"]]
            bad = there & F.lit(not good)
        elif kind == "in":
            bad = there & ~x.isin(*r["value"])
        elif kind == "length":
            bad = there & ~ops[r["op"]](F.length(x.cast("string")), F.lit(r["value"]))
        else:
            bad = there & ~ops[r["op"]](x, F.lit(r["value"]))
        broken.append(F.when(bad, F.lit(f"{kind}:{f}")))
    return F.coalesce(*broken) if broken else F.lit(None).cast("string")
