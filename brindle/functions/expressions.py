"""Arithmetic of virtual fields and of write-time macros, without ``eval``."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|\"([^\"]*)\"|'([^']*)'|([A-Za-z_][\w.]*)|(==|!=|>=|<=|[-+*/()<>,]))")


class ExpressionError(ValueError):
    pass


def compile_expression(text: str, columns: dict[str, str], now: Column | None = None) -> Column:
    """A whitelist: fields (unknown: null), numbers, strings, + - * /, comparisons, NOW() and CONCAT(...)."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek() -> str:
        return tokens[pos][5] if pos < len(tokens) and tokens[pos][5] else ""

    def take(symbol: str = "") -> re.Match:
        nonlocal pos
        if pos >= len(tokens) or symbol and tokens[pos][5] != symbol:
            raise ExpressionError(f"expected {symbol or 'a value'} in {text!r}")
        pos += 1
        return tokens[pos - 1]

    def comparison() -> Column:
        left = additive()
        if peek() in ("==", "!=", ">=", "<=", "<", ">"):
            op, right = take()[5], additive()
            return {"==": left.eqNullSafe(right), "!=": ~left.eqNullSafe(right), ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
        return left

    def additive() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take()[5] == "+" else left - product()
        return left

    def product() -> Column:
        left = unary()
        while peek() in ("*", "/"):
            if take()[5] == "*":
                left = left * unary()
            else:
                right = unary().cast("double")
                left = F.try_divide(left.cast("double"), right)
        return left

    def unary() -> Column:
        if peek() == "-":
            take()
            return -unary()
        if peek() == "(":
            take()
            inner = comparison()
            take(")")
            return inner
        m = take()
        if m[1]:
            return F.lit(float(m[1]) if "." in m[1] else int(m[1]))
        if m[2] is not None or m[3] is not None:
            return F.lit(m[2] if m[2] is not None else m[3])
        if not m[4]:
            raise ExpressionError(f"unexpected {m[5]!r} in {text!r}")
        if peek() == "(":
            take()
            args = []
            while peek() != ")":
                args.append(comparison())
                if peek() == ",":
                    take()
            take(")")
            return call(m[4].upper(), args)
        return F.col(f"`{m[4]}`") if m[4] in columns else F.lit(None)

    def call(name: str, args: list[Column]) -> Column:
        if name == "NOW" and not args:
            return now if now is not None else F.unix_timestamp().cast("double")
        if name == "CONCAT":
            return F.concat(*[F.coalesce(a.cast("string"), F.lit("")) for a in args])
        raise ExpressionError(f"unknown function {name}")

    out = comparison()
    if pos != len(tokens):
        raise ExpressionError(f"left over after {text!r}")
    return out


def macros(value: object, now: dt.datetime) -> object:
    """Replace _date_, _time_ and _dtz_ in strings, at any depth."""
    if isinstance(value, str):
        for name, shown in (("_date_", now.strftime("%Y-%m-%d")), ("_time_", now.strftime("%H:%M:%S")), ("_dtz_", now.isoformat())):
            value = value.replace(name, shown)
        return value
    if isinstance(value, dict):
        return {k: macros(v, now) for k, v in value.items()}
    return [macros(v, now) for v in value] if isinstance(value, list) else value


def moment(text: str | int | float, now: dt.datetime | None = None) -> dt.datetime:
    """ISO dates, epoch seconds or milliseconds, and a few words, in UTC."""
    now = now or dt.datetime.now(dt.timezone.utc)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    words = {"now": now, "today": midnight, "yesterday": midnight - dt.timedelta(days=1), "last week": midnight - dt.timedelta(days=7), "last month": midnight - dt.timedelta(days=30)}
    if isinstance(text, str) and text.lower() in words:
        return words[text.lower()]
    try:
        number = float(text)
        return dt.datetime.fromtimestamp(number / 1000 if number > 1e11 else number, dt.timezone.utc)
    except ValueError:
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
