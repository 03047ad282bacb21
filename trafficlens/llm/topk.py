"""Operator 3: exact top-k search by norm-bucketed retrieval.

Vectors are grouped by length into buckets.  For a query with a lower bound on its k-th score, each bucket has a local
cosine threshold, bound / (|query| * longest vector of the bucket): above 1 the bucket is skipped; high thresholds prune
by the query's largest coordinates; low ones prune by length.  What survives is verified by its integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, meet, sent, table

#: Vectors of a bucket and queries of a block: what one task holds at once.
BUCKET_ROWS, BLOCK_ROWS = 4096, 512
#: Ranges of length per factor e: a bucket's longest vector is at most about 3 % longer than its shortest.
RANGES_PER_E = 32
#: From this local cosine threshold on, a bucket is pruned by coordinates instead of by length.
COORDINATE_FROM = 0.35
#: Coordinates of a query that coordinate pruning looks at.
FOCUS = 16
#: Largest component for which products are exact in double precision (integers take over beyond it).
EXACT = 1 << 20
#: Scores are longs; larger ones count as these.
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): components floor(scale * x); rows that are null or hold a null or non-finite component are left out."""
    x = F.col(vec_col).cast("array<double>")
    sound = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale))
    return df.where(F.col(vec_col).isNotNull()).where(sound).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """All vectors of a bucket, longest first, as one row."""
    rows = rows.sort_values(["norm", "id"], ascending=[False, True])
    m = np.stack(rows["v"].to_numpy()).astype("<i8")
    return pd.DataFrame({"ids": [rows["id"].to_numpy("<i8").tobytes()], "m": [m.tobytes()], "dim": [m.shape[1]], "top": [rows["norm"].iloc[0]]})


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products; those that a long can't hold are the least or greatest long."""
    top, other = (float(np.abs(x.astype(float)).max(initial=0)) for x in (m, q))
    if max(top, other) < EXACT:
        return (m.astype(float) @ q.astype(float)).astype(np.int64)
    if top * other * max(1, len(q)) < 1 << 62:
        return m @ q
    return np.array([min(max(int(s), LEAST), MOST) for s in m.astype(object) @ q.astype(object)], np.int64)


def search_block(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of the block its best candidates (ids, scores) in this bucket, none of which is below its bound."""
    f = m.astype(float)
    norm = np.sqrt((f * f).sum(1))  # longest first
    for i, qid in enumerate(qids):
        qf = q[i].astype(float)
        length = float(np.sqrt((qf * qf).sum()))
        local = -np.inf if bound[i] == -np.inf else bound[i] / max(length * norm[0], 1e-300)
        if local > 1 + 1e-9:
            continue
        if local >= COORDINATE_FROM:  # what the focus gives plus the most that the rest can give
            focus = np.argsort(-np.abs(qf))[:FOCUS]
            part = f[:, focus]
            rest = np.sqrt(np.maximum(norm**2 - (part * part).sum(1), 0)) * np.sqrt(max(length**2 - (qf[focus] ** 2).sum(), 0))
            keep = np.flatnonzero(part @ qf[focus] + rest >= bound[i] - 1e-6 * abs(bound[i]) - 1)
        elif bound[i] > 0:  # the leading rows that are long enough
            keep = np.arange(np.searchsorted(-norm, -(bound[i] / max(length, 1e-300)) * (1 - 1e-9), side="right"))
        else:
            keep = np.arange(len(ids))
        keep = keep[ids[keep] != qid]
        if len(keep):
            scores = _products(m[keep], q[i])
            good = scores >= bound[i] - 1e-9 * abs(bound[i])  # a bound is a double, a score may be more exact
            keep, scores = keep[good], scores[good]
            at = _best(scores, ids[keep], k)
            yield int(qid), ids[keep][at], scores[at]


def _searcher(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, m = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.m, "<i8")
                qids, q = np.frombuffer(r.qids, "<i8"), np.frombuffer(r.qm, "<i8")
                m, q = m.reshape(len(ids), r.dim), q.reshape(len(qids), r.dim)
                got = list(search_block(ids, m, qids, q, np.frombuffer(r.bounds, "<f8"), k))
                if got:
                    yield pd.DataFrame({"query_id": np.repeat([g[0] for g in got], [len(g[1]) for g in got]), "vec_id": np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])})

    return run


PAIRS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries: (id, v array<long>) -> query_id, rank (from 1), vec_id, score: each query's k highest integer
    inner products over all vectors but its own id, ties to the smaller vec_id.

    A query id stands for one query: of queries that repeat an id, the least vector (compared component by component)
    counts.  Candidates that repeat an id are separate candidates; those of the query's own id are no candidates.
    A query meets only vectors of its dimension; vectors without components have score 0 with each other.  Scores are exact
    and kept in the range of a long.  Queries are cut into blocks and vectors into buckets of bounded size,
    so a common vector or length never gathers in one task, and a block meets a bucket only if some query of it can
    still score there.  Where all vectors are about equally long, no bucket can be skipped by length: every block then
    meets every bucket, and the pruning by coordinates inside a bucket does the work.  Null vectors and vectors without a
    query's dimension take no part; further columns are not read; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    rows = materialise(vectors.withColumn("norm", norm).withColumn("dim", F.size("v")))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    queries = materialise(queries.withColumn("norm", norm).withColumn("dim", F.size("v")))
    n_queries = queries.count()
    if not n_queries or rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Buckets: geometric ranges of length, cut further where a range is crowded.
    crowd = rows.withColumn("part", F.coalesce(F.floor(F.ln("norm") * RANGES_PER_E), F.lit(-1 << 30)))
    counts = sent(materialise(crowd.groupBy("dim", "part").agg(F.count("*").alias("n"))))
    crowd = crowd.join(counts, ["dim", "part"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int"))
    buckets = materialise(crowd.repartition("dim", "part", "sub").groupBy("dim", "part", "sub").applyInPandas(lambda key, pdf: _pack(pdf).assign(bucket=f"{key[1]}.{key[2]}"), "ids binary, m binary, dim int, top double, bucket string"))

    # A first bound for each query: its k-th score in the bucket of the longest vectors of its dimension.
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // BLOCK_ROWS)))).cast("int"))

    def packed(qs: DataFrame, bound: str) -> DataFrame:
        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.stack(pdf["v"].to_numpy()).astype("<i8")
            return pd.DataFrame({"dim": [key[0]], "block": key[1], "qids": [pdf["id"].to_numpy("<i8").tobytes()], "qm": [m.tobytes()], "bounds": [pdf[bound].to_numpy("<f8").tobytes()], "slack": [(pdf[bound] / np.maximum(pdf["norm"], 1e-300)).min()]})

        return materialise(qs.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, qids binary, qm binary, bounds binary, slack double"))

    def searched(asked: DataFrame, of: DataFrame) -> DataFrame:
        """A block skips the buckets whose longest vector is too short for all its queries."""
        pairs = asked.select("dim", "block", "slack").join(of.select("dim", "bucket", "top"), "dim").where(F.col("slack") <= F.col("top") * (1 + 1e-9))
        pairs = materialise(pairs.select("dim", "block", "bucket"))
        return meet(pairs, asked, ["dim", "block"], of, ["dim", "bucket"]).mapInPandas(_searcher(k), PAIRS)

    longest = buckets.groupBy("dim").agg(F.max_by("bucket", F.struct("top", "bucket")).alias("bucket"))
    first = buckets.join(longest, ["dim", "bucket"])
    seeds = materialise(searched(packed(blocks.withColumn("bound", F.lit(float("-inf"))), "bound"), first))
    bounds = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bound"))
    bounded = blocks.join(bounds.withColumnRenamed("query_id", "id"), "id", "left").fillna(float("-inf"), ["bound"])
    # A stated query set against all rows, in blocks.
    others = buckets.join(longest, ["dim", "bucket"], "left_anti")
    found = seeds.union(searched(packed(bounded, "bound"), others))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024.0)
    return top_k(vectors, vectors.where(F.col("id") % 100 == 0), 10)


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
