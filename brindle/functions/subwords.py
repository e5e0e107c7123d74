"""A byte-pair style tokenizer learned from word counts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"


def word_counts(docs: DataFrame, text: str, most: int = 100_000) -> dict[str, int]:
    """The most frequent words, at most ``most``."""
    w = docs.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''").groupBy("w").count()
    return {r["w"]: r["count"] for r in w.orderBy(F.desc("count"), "w").limit(most).collect()}


class SubwordTokenizer:
    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {m: i for i, m in enumerate(merges)}
        symbols = sorted({s for m in merges for s in (*m, "".join(m))})
        self.ids = {s: i + 1 for i, s in enumerate(symbols)}
        self.symbols = {i: s for s, i in self.ids.items()}

    @classmethod
    def learn(cls, counts: dict[str, int], merges: int) -> SubwordTokenizer:
        words = {w: [*w, END] for w in counts}
        learned = []
        for _ in range(merges):
            pairs: Counter = Counter()
            for w, parts in words.items():
                for p in zip(parts, parts[1:]):
                    pairs[p] += counts[w]
            if not pairs:
                break
            best = min(pairs, key=lambda p: (-pairs[p], p))
            learned.append(best)
            words = {w: _merge(parts, best) for w, parts in words.items()}
        return cls(learned)

    def pieces(self, word: str) -> list[str]:
        parts = [*word, END]
        while pairs := [p for p in zip(parts, parts[1:]) if p in self.rank]:
            parts = _merge(parts, min(pairs, key=self.rank.get))
        return parts

    def encode(self, text: str) -> list[int]:
        """Unknown symbols are 0."""
        return [self.ids.get(p, 0) for w in text.lower().split() for p in self.pieces(w)]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.symbols.get(i, "?") for i in ids).replace(END, " ").strip()


def _merge(parts: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(parts):
        if tuple(parts[i : i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out
