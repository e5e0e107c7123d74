"""SimHash, embeddings and families against brute force."""

from itertools import combinations

import numpy as np
import xxhash

from brindle.llm import embeddings, simhash
from brindle.llm import families as fam
from brindle.llm.common import components


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(families):
    rows = {r.doc_id: r.text for r in families.select("doc_id", "text").collect()}
    fp = {d: brute_fingerprint(t) for d, t in rows.items()}
    want = roots(rows, [(a, b) for a, b in combinations(rows, 2) if bin(fp[a] ^ fp[b]).count("1") <= 3])
    got = simhash.near_duplicates(families).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fp and {r.doc_id: r.component_id for r in got} == want


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_find_every_pair_within_three():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = rng.integers(0, 2**63, dtype=np.uint64)
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        keys = [set(simhash.anchors(np.array([v]))[0].tolist()) for v in (x, y)]
        assert keys[0] & keys[1] and len(keys[0]) <= 32


def test_hot_anchor_gives_a_forest(spark):
    base = 0x123456789ABCDEF
    many = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})[:1500]
    prints = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(many)], "doc_id long, fp long")
    got = simhash.families(prints).collect()
    want = roots(range(len(many)), [(a, b) for a in range(len(many)) for b in range(a) if bin(many[a] ^ many[b]).count("1") <= 3][:400_000])
    assert len(got) == len(many) and len({r.component_id for r in got}) <= len(set(want.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components(edges, "t").collect()}
    assert got == roots({x for e in chain for x in e}, chain)
    assert components(edges.limit(0), "t").count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(250, 64)))
    out = list(centres)
    for c in centres[:40]:
        for spread in (0.01, 0.02, 0.03):
            out.append(unit(c + spread * rng.normal(size=64)))
    out += [c.copy() for c in centres[:5]] + [2 * centres[6]]
    return np.array(out, np.float32)


def test_embeddings_recall_and_exactness(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(u))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    want = roots(range(len(u)), zip(*np.nonzero(near)))
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0, 0.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect())
    links = {k[1]: n for k, n, _ in got if not k[0]}
    assert len(got) == len(rows) and links[0] == 3 and links[9] == 3 and all(links[i] == 0 for i in (2, 3, 4, 5, 6, 7, 8))
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.where("vec_id = 2")).first().n_links == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_family(families):
    rows = {r.doc_id: r.text for r in families.select("doc_id", "text").collect()}
    s = {d: shingles(t) for d, t in rows.items()}
    pairs = [(a, b) for a, b in combinations(sorted(rows), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = {d for d, r in roots(rows, pairs).items() if d == r}
    kept = {r.doc_id for r in fam.one_of_each(families).collect()}
    assert want <= kept  # a document without near copies never goes
    assert len(kept - want) <= 0.05 * len(rows)


def test_one_of_each_odd(odd, empty):
    out = fam.one_of_each(odd)
    assert out.columns == odd.columns
    ids = sorted(r.doc_id for r in out.where("doc_id is not null").collect())
    assert 1 not in ids and 0 in ids and 9 not in ids and ids.count(3) == 1
    assert out.where("doc_id is null").count() == 2
    assert fam.one_of_each(empty).count() == 0


def kept_by_brute_force(rows):
    s = {d: shingles(t) for d, t in rows.items()}
    pairs = [(a, b) for a, b in combinations(sorted(rows), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    return {d for d, r in roots(rows, pairs).items() if d == r}


def kept_by_search(spark, rows):
    return {r.doc_id for r in fam.one_of_each(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")).collect()}


def test_pairs_are_verified_before_thinning(spark):
    first = [f"w{i * 7919 % 1000}" for i in range(200)]
    other = list(np.random.default_rng(5).permutation(first))
    rows = {0: " ".join(first), 1: " ".join(other), 2: " ".join([*other[:-2], other[-1], other[-2]])}
    assert kept_by_search(spark, rows) == kept_by_brute_force(rows) == {0, 1}


def test_appended_and_cut_copies_are_found(spark):
    rng = np.random.default_rng(6)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage, rows = make(40), {}
    for _ in range(40):
        w = make(int(rng.integers(80, 300)))
        w[10:10] = passage  # common to all, in the way of a search
        n = len(w)
        copies = [w, w + make(n * 8 // 100), make(n * 15 // 100) + w, w + make(n * 20 // 100), w[: n * 90 // 100], w[n * 18 // 100 :], w[: n * 60 // 100]]
        for c in rng.permutation(len(copies)):
            rows[len(rows)] = " ".join(copies[c])
    want = kept_by_brute_force(rows)
    assert 40 < len(want) < 160
    assert kept_by_search(spark, rows) == want


def test_embeddings_of_every_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e198]), (2, [0.0, 1e-200]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.1, 1.0, 0.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == {(0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 2, 3), (4, 2, 3), (5, 2, 3)}
