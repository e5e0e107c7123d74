"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered whole, ``### role: text</turn>`` and a line end for
each turn, and encoded once. The spans of the turns and those of the tokens
are both sorted, so each assistant span finds its tokens by binary search; the
loss mask is the intersection of the two.

Texts can hold anything: the backslash and the characters with which a control
string begins are written as a backslash and a letter, so no control string can
occur inside a turn, and reading back undoes exactly that.

Defined cases: null text and null role are empty; turns of one number are
ordered by role, then text; null turn numbers come first; a null conv_id is a
conversation of its own. Extra columns are ignored. Memory: one conversation.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
LETTERS = {v[1]: k for k, v in ROLE_ESCAPES.items()}
LEARNED = "assistant"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
FORMATTED = "conv_id long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str, escapes: dict[str, str] = ESCAPES) -> str:
    for char, code in escapes.items():  # the backslash comes first
        text = text.replace(char, code)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: LETTERS[m[1]], text) if "\\" in text else text


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of what is learned, sorted."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, ROLE_ESCAPES)}{MIDDLE}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(MIDDLE)
        yield unescape(role), unescape(text)


@functools.lru_cache(maxsize=2)
def tokenizer(file: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(file)
    out.encode_special_tokens = True
    return out


def loss_mask(formatted: str, spans: list[tuple[int, int]], file: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mask by token, starts and ends of what is under the mask)."""
    got = tokenizer(file).encode(formatted, add_special_tokens=False)
    ends = np.maximum.accumulate(np.array([e for _, e in got.offsets], np.int64)) if got.offsets else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends  # tokens tile the text, whatever blanks the offsets leave out
    mask, lows, highs = np.zeros(len(ends), bool), [], []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        mask[i:j] = True
        lows.append(np.maximum(starts[i:j], a))
        highs.append(np.minimum(ends[i:j], b))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return got.ids, mask, join(lows), join(highs)


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """From rows sorted by conversation and turn, over the borders of batches."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    for conv, own in groupby(rows, lambda r: r[0]):
        yield conv, [(role or "", text or "") for _, role, text in own]


def _digest_rows(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[tuple]:
    for conv, turns in conversations(batches):
        formatted, spans = render(turns)
        _, mask, lows, highs = loss_mask(formatted, spans, file)
        whole, n = hashlib.sha256(), 0
        for role, text in read_back(formatted):
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n += 1
        learned = unescape("".join([formatted[a:b] for a, b in zip(lows.tolist(), highs.tolist())]))
        yield conv, n, whole.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted), len(mask), int(mask.sum())


def _format_rows(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[tuple]:
    for conv, turns in conversations(batches):
        formatted, spans = render(turns)
        ids, mask, lows, highs = loss_mask(formatted, spans, file)
        yield conv, formatted, ids, mask.tolist(), lows.tolist(), highs.tolist()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 200) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _by_conversation(turns: DataFrame) -> DataFrame:
    own = turns.select("conv_id", "turn", "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _file(file: str | None) -> str:
    if file:
        return file
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_conversations(turns: DataFrame, file: str | None = None) -> DataFrame:
    """Each conversation formatted, with ids, mask by token, and mask by character."""
    file, ints = _file(file), pa.list_(pa.int64())
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_starts", ints), ("loss_ends", ints)])
    return _by_conversation(turns).mapInArrow(lambda x: _batched(_format_rows(x, file), schema), FORMATTED)


def digests(turns: DataFrame, file: str | None = None) -> DataFrame:
    """What is read back from each formatted conversation."""
    file = _file(file)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
    return _by_conversation(turns).mapInArrow(lambda x: _batched(_digest_rows(x, file), schema), DIGESTS)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_chars(text: str, more: str = "") -> str:
    """SQL for the length of an escaped text."""
    return " + ".join([f"length({text})", *(f"length({text}) - length(replace({text}, '{c}', ''))" for c in "\\#<" + more)])


OP5_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + 2 + 8 + {_escaped_chars("role", ":")} + {_escaped_chars("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
