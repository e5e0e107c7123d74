"""Byte and word repeats against brute force."""

import hashlib
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from brindle.llm import debruijn, queries, suffixes, windows


def brute_bytes(rows, window=50):
    seen, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            seen[w] = min(seen.get(w, doc), doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - window + 1 if doc is not None else 0):
            if seen[raw[i : i + window]] < doc:
                gone[i] += 1
                gone[i + window] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        spans = int(np.diff(np.concatenate([[0], mask.astype(int)])).clip(0).sum())
        out.setdefault(doc, set()).add((len(raw), int(mask.sum()), hashlib.sha256(kept).hexdigest(), spans))
    return out


def brute_words(rows, window=20):
    seen, out = {}, {}
    split = lambda t: (t or "").encode().split()
    for doc, text in (r for r in rows if r[0] is not None):
        w = split(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(seen.get(k, (doc, i)), (doc, i))
    for doc, text in rows:
        w = split(text)
        gone = np.zeros(len(w) + 1, int)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if seen[tuple(w[i : i + window])] < (doc, i):
                gone[i] += 1
                gone[i + window] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        out.setdefault(doc, set()).add((len(w), int(mask.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, mask) if not g)).hexdigest()))
    return out


def check(got, want, *columns):
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(tuple(r[c] for c in columns))
    assert found == want


def pairs_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


BYTES = ("n_bytes", "n_removed", "kept_sha256", "n_spans")
WORDS = ("n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("more", [{}, {"bits": 3}, {"hot_kinds": 1}])  # as it is; hashes that collide; every gram split
def test_bytes(families, more):
    got = suffixes.removed(families, replace(suffixes.BYTES, **more)).collect()
    check(got, brute_bytes(pairs_of(families)), *BYTES)
    assert sum(r.n_removed for r in got) > 0 and len(got) == families.count()


def test_bytes_odd(odd, empty):
    got = suffixes.removed(odd).collect()
    assert len(got) == odd.count()
    check(got, brute_bytes(pairs_of(odd)), *BYTES)
    assert suffixes.removed(empty).count() == 0


@pytest.mark.parametrize("more", [{}, {"bits": 3}, {"hot_kinds": 1}])
def test_words(families, more):
    got = debruijn.removed(families, replace(debruijn.WORDS, **more)).collect()
    check(got, brute_words(pairs_of(families)), *WORDS)
    assert sum(r.n_removed for r in got) > 0 and len(got) == families.count()


def test_words_odd(odd, empty):
    got = debruijn.removed(odd).collect()
    assert len(got) == odd.count()
    check(got, brute_words(pairs_of(odd)), *WORDS)
    assert debruijn.removed(empty).count() == 0


def test_compaction_decides(families, monkeypatch):
    """Without chains nothing is removed; with uncompacted paths as chains the words are the same."""
    whole = debruijn.chains
    monkeypatch.setattr(debruijn, "chains", lambda found: whole(found).limit(0))
    assert sum(r.n_removed for r in debruijn.removed(families).collect()) == 0


def test_windows_of_colliding_hashes(monkeypatch):
    rng = np.random.default_rng(9)
    shared = bytes(rng.integers(97, 123, 80).astype(np.uint8))
    pieces = [bytes(rng.integers(97, 123, 9).astype(np.uint8)) + shared[k : k + 55] for k in (0, 0, 3, 0, 9)]
    gram, doc, at = np.zeros(5, np.int64), np.arange(5), np.array([i << 20 | 20 << 12 | 14 << 4 | windows.OPEN for i in range(5)])
    want = suffixes.covered_windows(gram, doc, at, pieces)
    assert want.any()
    monkeypatch.setattr(suffixes, "MASK", np.uint64(1))
    assert (suffixes.covered_windows(gram, doc, at, pieces) == want).all()


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op10_debruijn_substring_dedup", "op3_embedding_near_duplicates"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_segments_of_a_long_text(monkeypatch, families):
    monkeypatch.setattr(windows, "SEGMENT", 200)  # in this process alone: the pure functions
    text = b"".join(bytes([97 + i * i % 23]) for i in range(1500))
    cut = [(a, u) for _, _, a, u in windows.segments(iter([_batch(text)]), suffixes.BYTES)]
    covered = {a + i for a, u in cut for i in range(len(u) - 49)}
    assert covered == set(range(1451)) and all(len(u) <= 200 for _, u in cut)


def _batch(text):
    import pyarrow as pa

    return pa.record_batch([pa.array([1]), pa.array([1], pa.int32()), pa.array([text])], names=["doc_id", "tag", "text"])


def test_pieces_hold_every_window_once():
    rng = np.random.default_rng(1)
    units = rng.integers(97, 101, 3000).astype(np.uint64)
    ends = np.array([700, 720, 1900, 3000])
    p = windows.pieces_of(units, ends, suffixes.BYTES)
    held = [s + i for s, n in zip(p["start"], p["windows"]) for i in range(n)]
    begins = [0, 700, 720, 1900]
    assert sorted(held) == [i for a, b in zip(begins, ends) for i in range(a, b - 49)] and len(set(held)) == len(held)
    packed = windows.packed({c: p[c] for c, _ in windows.WIDTHS}, np.array([5, 6, 7, 8]), np.array([-1, 2, 3, 4]), np.searchsorted(ends, p["start"], "right"))
    again = windows.unpacked(packed)
    assert (again["start"] == p["start"]).all() and (again["text"].view(np.uint64) == p["text"]).all() and set(again["tag"]) <= {-1, 2, 3, 4}


def test_suffix_order():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 2000).astype(np.uint8)
    s = suffixes.Suffixes(raw, 50)
    at = rng.integers(0, 1900, 400)
    idx = s.order(at, np.zeros(400, int), np.full(400, 400))
    keys = [raw[i : i + 50].tobytes() for i in at[idx]]
    assert keys == sorted(keys)


def test_cut_text_is_whole_characters(spark, odd):
    out = suffixes.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {(r.doc_id, r.n_chars): r.text for r in out.where("doc_id in (10, 11)").collect()}
    assert any(k[0] == 11 and len(t) < 60 for k, t in rows.items())


def test_chains_compact(spark):
    """A chain of 70 paths is one; a path that also stands alone, or goes on otherwise, ends a chain."""
    rows = [(d, 0, 3 * k, 3, 100 + k, 101 + k if k < 69 else None) for d in (1, 2) for k in range(70)]
    rows += [(1, 0, 900, 3, 7, 8), (1, 0, 903, 3, 8, None), (2, 0, 900, 3, 7, 9), (2, 0, 903, 3, 9, None), (3, 0, 0, 3, 8, None), (3, 0, 9, 3, 9, None)]
    found = spark.createDataFrame(rows, "doc_id long, tag long, start long, edges long, path long, next long")
    got = {r.path: (r.chain, r.ahead) for r in debruijn.chains(found).collect()}
    assert all(got[100 + k] == (100, 3 * k) for k in range(70)) and all(got[p] == (p, 0) for p in (7, 8, 9))


def _judged(spec, texts):
    cut = windows.cut_pieces(iter([pa_batch(texts)]), spec, [0])
    batches = list(windows.judge_pieces(cut, spec))
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "path")))]
    return rows


def pa_batch(texts):
    import pyarrow as pa

    n = len(texts)
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "tag", "text"])


def test_open_pieces_can_share_a_window():
    """Texts that share 16 to 30 bytes ask for nothing; every window of 50 shared by differing stretches is between open or settled pieces."""
    rng = np.random.default_rng(4)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    gram = noise(30)
    assert not _judged(suffixes.BYTES, [noise(200) + gram + noise(200) for _ in range(40)])
    shared = noise(58)
    texts = [noise(60) + shared[rng.integers(0, 5) :] + noise(60) for _ in range(30)]
    held = {}
    for doc, at, _ in _judged(suffixes.BYTES, texts):
        for i in range(at >> 4 & 255):
            held.setdefault(doc, set()).add((at >> 20) + i)
    where = {}
    for doc, t in enumerate(texts):
        for i in range(len(t) - 49):
            where.setdefault(t[i : i + 50], []).append((doc, i))
    common = [x for v in where.values() if len(v) > 1 for x in v]
    assert common and all(i in held[doc] for doc, i in common)


def test_shuffles_of_open_pieces_go_first(families, monkeypatch):
    """The texts of open pieces are compared in a table of its own, before the rest is read again."""
    made, whole = [], suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df, name, *a: made.append(name) or whole(df, name, *a))
    state = suffixes.repeats(families)
    assert made == ["compared"] and "binary" not in {t for c, t in state.dtypes if c != "text"}
