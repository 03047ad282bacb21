"""Operator 8: embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions.  In each sorted projection a pair collides if one value lies in
the window centred on the other; pairs with enough collisions, a count calibrated to the recall wanted at the
threshold, are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, meet, sent, table

PROJECTIONS = 24
#: Directions by which the vectors are also dealt into cells; a pair must lie in the same or adjoining cells.
CELL_DIRECTIONS = 2
#: Half a window, and the width of a cell, in standard deviations of a pair's difference at the threshold.
HALF_WINDOW, CELL = 1.6, 4.5
#: Share of the pairs at the threshold that must pass the count.
RECALL = 0.9995
BLOCK_ROWS = 1024


def directions(dim: int, seed: int = 8) -> np.ndarray:
    """Random orthonormal directions (as many as there can be, then a further set), one per column."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(sets, axis=1)[:, :PROJECTIONS]


def calibrated_count(half_window: float = HALF_WINDOW, n: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest count that pairs at the threshold reach with probability `recall`."""
    p = math.erf(half_window / math.sqrt(2))
    tail, c = 0.0, n + 1
    while tail < recall and c:
        c -= 1
        tail += math.comb(n, c) * p**c * (1 - p) ** (n - c)
    return c


def spread(dim: int, threshold: float) -> float:
    """Standard deviation of the difference of two projections of a pair at the threshold."""
    return math.sqrt((2 - 2 * threshold) / dim)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs of two blocks of unit vectors."""
    d = directions(x.shape[1])
    half = HALF_WINDOW * spread(x.shape[1], threshold)
    px, py = x @ d, y @ d
    hits = np.zeros((len(x), len(y)), np.int8)
    for j in range(d.shape[1]):
        order = np.argsort(py[:, j], kind="stable")
        values = py[order, j]
        low, high = np.searchsorted(values, px[:, j] - half, "left"), np.searchsorted(values, px[:, j] + half, "right")
        if (high - low).sum() * 4 < len(x) * len(y):  # few: step through the windows
            n = high - low
            rows = np.repeat(np.arange(len(x)), n)
            cols = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            hits[rows, cols] += 1
        else:
            hits += np.abs(px[:, j, None] - py[None, :, j]) <= half
    i, j = np.nonzero(hits >= need)
    keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[keep], j[keep]


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each position reaches by the links (i, j)."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, other = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.ids2, "<i8")
                x, y = np.frombuffer(r.m, "<f8").reshape(len(ids), -1), np.frombuffer(r.m2, "<f8").reshape(len(other), -1)
                times, times2 = np.frombuffer(r.times, "<i8"), np.frombuffer(r.times2, "<i8")
                i, j = linked(x, y, threshold, calibrated_count())
                if r.block == r.block2:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                # One row per vector, never one per pair: how many vectors it links to here, and what it reaches.
                both = np.concatenate([ids, other]) if r.block != r.block2 else ids
                j = j + (len(ids) if r.block != r.block2 else 0)
                copies = np.concatenate([times, times2]) if r.block != r.block2 else times
                n = np.bincount(i, copies[j], len(both)) + np.bincount(j, copies[i], len(both))
                some = np.flatnonzero(n)
                yield pd.DataFrame({"id": both[some], "n": n[some].astype("int64"), "root": _roots(both, i, j)[some]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors: vec_id, embedding, label -> vec_id, n_links, component_id, kept, one row per input row.

    Only vectors of equal, non-null labels (and equal dimension) are compared.  A vector that is null, zero or holds
    null or non-finite components, or whose vec_id is null, links with nothing and is a component of its own.  Equal
    vectors are gathered before the search and count as each other's links, so copies cost nothing however many they
    are; repeated rows are copies.  Rows that repeat a vec_id with another vector or label are vectors of their own, and their
    components don't join through the id.  Other columns are not read, whatever their names; an empty table gives no rows.  A full cell is cut into blocks that are compared pair by pair: nothing is capped.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    sound = sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "label", e.alias("e"), sound.alias("sound")).withColumn("h", F.when(F.col("sound"), F.xxhash64("e"))).withColumn("g", F.when(F.col("sound"), F.hash(F.reverse("e"))))
    rows = materialise(rows)
    copies = rows.where("sound").groupBy("label", "h", "g").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("times"), F.min_by("e", "vec_id").alias("e"))
    copies = materialise(copies.withColumn("id", F.monotonically_increasing_id()))  # ids of vectors may repeat

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["e"].map(len)
            for dim, part in pdf.groupby(dims, sort=False):
                m = np.stack(part["e"].to_numpy()).astype("<f8")
                m = m / np.abs(m).max(1, keepdims=True)
                m /= np.sqrt((m * m).sum(1, keepdims=True))
                c = np.floor(m @ directions(dim)[:, :CELL_DIRECTIONS] / (CELL * spread(dim, threshold))).astype("int32")
                c = np.pad(c, ((0, 0), (0, max(0, CELL_DIRECTIONS - c.shape[1]))))
                yield pd.DataFrame({"label": part["label"], "dim": dim, "x": c[:, 0], "y": c[:, 1], "id": part["id"], "times": part["times"], "u": [v.tobytes() for v in m]})

    kind = vectors.schema["label"].dataType.simpleString()
    dealt = materialise(copies.select("label", "id", "times", "e").mapInPandas(cells, f"label {kind}, dim int, x int, y int, id long, times long, u binary"))
    cell = ["label", "dim", "x", "y"]
    counts = sent(materialise(dealt.groupBy(*cell).agg(F.count("*").alias("n"))))
    dealt = dealt.join(counts, cell).withColumn("sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"label": [key[0]], "dim": key[1], "x": key[2], "y": key[3], "block": f"{key[2]}.{key[3]}.{key[4]}", "ids": pdf["id"].to_numpy("<i8").tobytes(), "times": pdf["times"].to_numpy("<i8").tobytes(), "m": b"".join(pdf["u"])})

    blocks = materialise(dealt.repartition(*cell, "sub").groupBy(*cell, "sub").applyInPandas(pack, f"label {kind}, dim int, x int, y int, block string, ids binary, times binary, m binary"))
    # Each pair of adjoining cells once: the cell itself, and half of its neighbours.
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    names = blocks.select(*cell, "block")
    around = names.withColumn("d", F.explode(near)).withColumn("x", F.col("x") + F.col("d.dx")).withColumn("y", F.col("y") + F.col("d.dy"))
    pairs = around.join(names.withColumnRenamed("block", "block2"), cell).where("d.dx <> 0 or d.dy <> 0 or block <= block2")
    pairs = materialise(pairs.select("label", "dim", "block", "block2"))
    left = blocks.drop("x", "y")
    right = blocks.select("label", "dim", *(F.col(c).alias(f"{c}2") for c in ("block", "ids", "times", "m")))
    both = meet(pairs, left, ["label", "dim", "block"], right, ["label", "dim", "block2"])
    found = materialise(both.select("block", "ids", "times", "m", "block2", "ids2", "times2", "m2").mapInPandas(_compare(threshold), "id long, n long, root long"))

    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = copies.select("label", "h", "g", "id", "least", "times").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = materialise(classes)
    tops = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    classes = classes.join(tops, "root", "left")
    classes = classes.select(F.col("label").alias("l"), F.col("h").alias("h2"), F.col("g").alias("g2"), (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("top", "least").alias("component_id"))
    classes = materialise(classes)
    # Copies of one vector may be many: the rows are spread by salt, and each class goes to all salts.
    salts = 16
    salted = rows.drop("e").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    classes = classes.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = salted.join(classes, (F.col("label") == F.col("l")) & (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")) & (F.col("salt") == F.col("salt2")), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r(node, reach) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS m FROM r GROUP BY node)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c ON c.node = e.vec_id
"""
