"""Long repeated word sequences through a compacted de Bruijn graph.

Every 20 consecutive words are an edge, from their first 19 words to their
last 19. Edges that share their anchor (see ``windows``) and follow each other
in a text come as one path, a stretch that either occurs again as a whole or,
where paths of one anchor differ, is cut into the runs of edges that other
paths have too (compared on their words). The graph of repeats holds paths that
occur at least twice, with the source coordinates (document, first word) of
every occurrence.

A branch ends a chain: path p and the path q behind it compact if every
occurrence of p goes on with q and every occurrence of q comes from p. Spark
joins compact whole chains by pointer doubling, as many rounds as the longest
chain needs, so all occurrences of a chain are whole. The chains decide: the
occurrence of a chain with the smallest (doc_id, first word) stays, the words of
all others go. Each occurrence is then verified on its source coordinates: the
words that stand there are digested (128 bits), and occurrences of one chain
must agree, else its paths are taken apart and compared on their words.

A word is removed if an edge over it also starts earlier (in a smaller doc_id,
or earlier in the document), judged on the input. Defined cases: a null text
has no words; texts under 20 words lose none to other rows; rows with one
doc_id are documents of their own, none earlier than the other at one place; a
row with a null doc_id neither loses nor causes a loss. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize, salt_of, shuffle_partitions, table
from brindle.llm.windows import CHECKS, KEY, OPEN, Units, by_gram, check_columns, digests, judged, lists, role_of, send_open, tagged, verified, with_places

EDGE_WORDS = 20
#: Tasks that the occurrences of one chain are dealt to.
SALTS = 16
RUN = "doc_id long, tag long, at long, path long"


def word_numbers(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


WORDS = Units(EDGE_WORDS, 4, True, bytes.split, word_numbers, b" ".join)


def run_batches(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The runs of edges that open paths of one gram share, at every place, from rows sorted by gram.

    A run goes on as long as its edges occur equally often and always behind
    one another, so that a run is met whole wherever one of its edges is.
    """
    import xxhash

    for t in by_gram(batches, most):
        edges_of, count, pairs = [], {}, {}
        for piece in t.column("piece").to_pylist():
            words = piece.split()
            edges = [b" ".join(words[i : i + EDGE_WORDS]) for i in range(len(words) - EDGE_WORDS + 1)]
            edges_of.append(edges)
            for e in edges:
                count[e] = count.get(e, 0) + 1
            for pair in zip(edges, edges[1:]):
                pairs[pair] = pairs.get(pair, 0) + 1
        out = []
        for doc, tag, at, edges in zip(*(t.column(c).to_pylist() for c in ("doc_id", "tag", "at")), edges_of):
            i = 0
            while i < len(edges):
                j, n = i + 1, count[edges[i]]
                while j < len(edges) and n == count[edges[j]] == pairs[edges[j - 1], edges[j]]:
                    j += 1
                if n > 1:
                    out.append((doc, tag, ((at >> 20) + i) << 20 | (j - i) << 4 | OPEN, xxhash.xxh64_intdigest(b"\n".join(edges[i:j])) >> 1))
                i = j
        cols = list(zip(*out)) or [()] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "tag", "at", "path"])


def occurrences(base: DataFrame, suspects: DataFrame | None = None, units: Units = WORDS) -> DataFrame:
    """(doc_id, tag, start, edges, path, next): every occurrence of repeated paths, with the path right behind it."""
    n = shuffle_partitions(base.sparkSession)
    known = judged(base, units, suspects)
    sent = with_places(base, known.where(role_of() == OPEN), "inner").select(*KEY, "text", "ats").mapInArrow(lambda x: send_open(x, units), "gram long, doc_id long, tag long, at long, piece binary")
    runs = sent.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run_batches, RUN)
    # whole paths and runs make two layers; only paths of one layer follow each other
    places = known.where(role_of() != OPEN).unionByName(runs).select(*KEY, F.shiftright("at", 20).alias("start"), F.shiftright("at", 4).bitwiseAND(255).alias("edges"), "path", (role_of() == OPEN).alias("run"))
    order = Window.partitionBy(*KEY, "run").orderBy("start")
    behind = F.when(F.lead("start").over(order) == F.col("start") + F.col("edges"), F.lead("path").over(order))
    return materialize(places.repartition(n, *KEY, "run").dropDuplicates([*KEY, "run", "start"]).withColumn("next", behind).drop("run"), "occurrences")


def chains(found: DataFrame) -> DataFrame:
    """(path, chain, ahead, edges) for every path: the first path of its chain and the edges from there to it."""
    counts = materialize(found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("edges").alias("edges")), "paths")
    hops = found.where("next is not null").groupBy("path", "next").agg(F.count(F.lit(1)).alias("m"))
    hops = hops.join(counts, "path").where("n = m").select("path", "next", "m", "edges")
    hops = hops.join(counts.select(F.col("path").alias("next"), F.col("n").alias("of_next")), "next").where("m = of_next")
    settled, going = None, materialize(hops.select(F.col("next").alias("path"), F.col("path").alias("chain"), F.col("edges").alias("ahead")), "chains")
    while going.take(1):
        then = going.select(F.col("path").alias("_path"), F.col("chain").alias("_chain"), F.col("ahead").alias("_ahead"))
        if settled is not None:
            then = then.unionByName(settled.select(F.col("path").alias("_path"), F.col("chain").alias("_chain"), F.col("ahead").alias("_ahead")))
        went = materialize(going.join(then, F.col("chain") == F.col("_path"), "left").select("path", F.coalesce("_chain", "chain").alias("chain"), (F.col("ahead") + F.coalesce("_ahead", F.lit(0))).alias("ahead"), F.col("_path").isNull().alias("whole")), "chains")
        now = went.where("whole").drop("whole")
        settled, going = now if settled is None else settled.unionByName(now), went.where("NOT whole").drop("whole")
    out = counts.select("path", F.col("path").alias("chain"), F.lit(0).cast("long").alias("ahead"), "edges")
    if settled is not None:
        moved = settled.select("path", F.col("chain").alias("_chain"), F.col("ahead").alias("_ahead"))
        out = out.join(moved, "path", "left").select("path", F.coalesce("_chain", "chain").alias("chain"), F.coalesce("_ahead", "ahead").alias("ahead"), "edges")
    return materialize(out, "chains")


def spans(found: DataFrame, chain: DataFrame) -> DataFrame:
    """(doc_id, tag, start, edges, chain, gone): the occurrences of chains that occur again; the first stays."""
    heads = found.select(*KEY, "start", "path").join(chain.where("ahead = 0").select("path", "chain"), "path")
    whole = chain.groupBy("chain").agg(F.max(F.col("ahead") + F.col("edges")).alias("edges"))
    first = heads.groupBy("chain").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").join(whole, "chain")
    # a chain that very many places share is dealt to several tasks
    heads = heads.withColumn("salt", salt_of("doc_id", "start", buckets=SALTS))
    first = first.select("chain", "first", "edges", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return heads.join(first, ["chain", "salt"]).select(*KEY, "start", "edges", "chain", (F.struct("doc_id", "start") > F.col("first")).alias("gone"))


def digest_batches(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in f"{DIGESTS}, {CHECKS}".split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            out, paths, found = [], [], []
            for doc, text, start, edges, chain, gone in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")), *(lists(part.column(c)) for c in ("starts", "edges", "chains", "gone"))):
                words = text.split()
                edge, stop, gone = np.zeros(len(words) + 1, np.int32), start + edges - 1 + EDGE_WORDS, gone.astype(bool)
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, stop[gone], -1)
                away = np.cumsum(edge[:-1]) > 0
                kept = words if not away.any() else [words[k] for k in np.flatnonzero(~away).tolist()]
                out.append((doc, len(words), int(away.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
                paths.append(chain)
                found.append(digests([b" ".join(words[a:b]) for a, b in zip(start.tolist(), stop.tolist())]))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([*cols, *check_columns(paths, found)], names=names)


DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removed(docs: DataFrame, units: Units = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    base = tagged(docs)

    def build(suspects: DataFrame | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        found = occurrences(base, suspects, units)
        chain = chains(found)
        own = spans(found, chain).groupBy(*KEY).agg(F.collect_list(F.struct("start", "edges", "chain", "gone")).alias("s"))
        state = base.join(own, KEY, "left").select(*KEY, "text", F.col("s.start").alias("starts"), F.col("s.edges").alias("edges"), F.col("s.chain").alias("chains"), F.transform("s.gone", lambda x: x.cast("long")).alias("gone"))
        wrong_paths = lambda wrong: chain.join(wrong.withColumnRenamed("path", "chain"), "chain", "left_semi").select("path")
        return state.mapInArrow(digest_batches, f"{DIGESTS}, {CHECKS}"), wrong_paths

    return verified(docs.sparkSession, build, "removed")


def op10_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
edge AS (SELECT *, string_agg(w, ' ') OVER near AS e, count(*) OVER near AS n FROM word WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (SELECT doc_id, i, w, n = 20 AND row_number() OVER (PARTITION BY n, e ORDER BY doc_id, i) > 1 AS starts FROM edge),
marked AS (SELECT doc_id, i, w, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
docs AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN docs USING (doc_id)
"""
