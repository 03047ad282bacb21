"""Operator 11: hard-negative mining by Fagin's threshold algorithm.

Candidates lie in blocks of one label, each with one list per dimension that is sorted by that component.  For an anchor the
lists are read from the top where its component is positive and from the bottom where it is negative; every row met is
scored by random access.  The anchor's product with the values last read bounds all rows not met yet, and reading stops
once that threshold is strictly below the k-th score of each of the anchor's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, meet, sent, table

#: Rows of a candidate block, and anchors of an anchor block: what one task holds at once.
BLOCK_ROWS, ANCHORS = 4096, 256
#: Rows read from each list at first; each further step reads twice as many.
FIRST_STEP = 16
#: Scores are longs; larger ones count as these.
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
#: Longs that can be added without overflow.
SAFE = 1 << 62


def _wide(m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers whose products are exact: doubles or longs where those suffice, else Python's integers."""
    bound = float(np.abs(m.astype(float)).max(initial=0)) * float(np.abs(a.astype(float)).max(initial=0)) * max(1, m.shape[1])
    kind = float if bound < 1 << 52 else np.int64 if bound < SAFE else object
    return m.astype(kind), a.astype(kind)


def _longs(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(s, LEAST), MOST) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _bound(m: np.ndarray, at: np.ndarray, used: np.ndarray, anchor: np.ndarray) -> int:
    """The anchor's product with the values last read, one from each list."""
    return int((m[at, used] * anchor[used]).sum())


def threshold_search(ids: np.ndarray, m: np.ndarray, orders: np.ndarray, anchor: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low[w] <= score <= high[w]) the ids and scores of its k best rows of this block, other than the row
    `own`: highest score first, ties by id.  `orders[j]` are the rows by rising component j; m and anchor are of one kind.
    `low` may be an earlier bound on the k-th score: rows below it aren't wanted."""
    used, n = np.flatnonzero(anchor != 0), len(ids)
    lists = np.where((anchor[used] > 0)[:, None], orders[used][:, ::-1], orders[used])
    met, rows, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor, depth, step = low.copy(), 0, FIRST_STEP
    while depth < n and len(low):
        end = min(n, depth + step)
        if len(used):
            read = lists[:, depth:end]
            if depth == 0 and _bound(m, read[:, 0], used, anchor) < floor.min():
                break  # the rows on top bound all rows: the block holds nothing wanted
            now = np.zeros(n, bool)
            now[read] = True
            new = np.flatnonzero(now & ~met)
        else:
            new, end = np.arange(n), n  # an anchor of zeros: all scores are 0
        met[new] = True
        new = new[ids[new] != own]
        rows = np.concatenate([rows, new])
        scores = np.concatenate([scores, _longs(m[new] @ anchor)])
        depth, step = end, step * 2
        if depth < n:
            for w in range(len(low)):
                inside = scores[(scores >= low[w]) & (scores <= high[w])]
                if len(inside) >= k:
                    floor[w] = max(floor[w], np.partition(inside, len(inside) - k)[len(inside) - k])
            if _bound(m, read[:, -1], used, anchor) < floor.min():
                break
    found = []
    for a, b in zip(low, high, strict=True):
        at = np.flatnonzero((scores >= a) & (scores <= b))
        at = at[np.lexsort((ids[rows[at]], -scores[at]))[:k]]
        found.append((ids[rows[at]], scores[at]))
    return found


def _small(m: np.ndarray) -> np.ndarray:
    """In the narrowest of three widths that holds all components."""
    top = int(np.abs(m.astype(float)).max(initial=0))
    return m.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _pack_rows(pdf: pd.DataFrame) -> dict:
    pdf = pdf.sort_values("id")
    m = np.stack(pdf["v"].to_numpy()).astype("<i8")
    small = _small(m)
    orders = np.argsort(m, axis=0, kind="stable").T.astype("<u2")
    return {"ids": [pdf["id"].to_numpy("<i8").tobytes()], "m": [small.tobytes()], "width": [small.itemsize], "orders": [orders.tobytes()]}


def candidate_blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Blocks of one label and dimension with their sorted lists: label, dim, block, ids, m, width, orders."""
    counts = sent(materialise(rows.groupBy("label", "dim").agg(F.count("*").alias("n"))))
    dealt = rows.join(counts, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "v", "copy"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pack_rows(pdf)).assign(label=key[0], dim=key[1], block=key[2])

    out = f"label {kind}, dim int, block int, ids binary, m binary, width int, orders binary"
    return materialise(dealt.repartition("label", "dim", "block").groupBy("label", "dim", "block").applyInPandas(pack, out))


FOUND = "anchor_id long, window int, id long, score long"


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = np.frombuffer(r.ids, "<i8")
                m = np.frombuffer(r.m, f"<i{r.width}").reshape(len(ids), r.dim)
                orders = np.frombuffer(r.orders, "<u2").reshape(r.dim, len(ids))
                anchors = np.frombuffer(r.anchors, "<i8")
                a = np.frombuffer(r.am, "<i8").reshape(len(anchors), r.dim)
                owner, low, high, window = (np.frombuffer(x, "<i8") for x in (r.owner, r.low, r.high, r.window))
                wide, a = _wide(m, a)
                out = []
                for i, anchor in enumerate(anchors):
                    at = np.flatnonzero(owner == i)
                    if len(at):
                        found = threshold_search(ids, wide, orders, a[i], anchor, low[at], high[at], k)
                        out += [pd.DataFrame({"anchor_id": anchor, "window": np.int32(window[w]), "id": x, "score": s}) for w, (x, s) in zip(at, found, strict=True) if len(x)]
                if out:
                    yield pd.concat(out)

    return run


def _asked(anchors: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    """Anchor blocks of one label and dimension with their windows: label, dim, ablock, anchors, am, owner, window, low, high.
    windows: anchor_id, window, low, high, several for an anchor."""
    rows = anchors.join(windows.groupBy("anchor_id").agg(F.collect_list(F.struct("window", "low", "high")).alias("w")), F.col("id") == F.col("anchor_id"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flat = [(i, w["window"], w["low"], w["high"]) for i, ws in enumerate(pdf["w"]) for w in ws]
        owner, window, low, high = (np.array(x, "<i8").tobytes() for x in zip(*flat, strict=True))
        am = np.stack(pdf["v"].to_numpy()).astype("<i8").tobytes()
        return pd.DataFrame({"label": [key[0]], "dim": key[1], "ablock": key[2], "anchors": pdf["id"].to_numpy("<i8").tobytes(), "am": am, "owner": owner, "window": window, "low": low, "high": high})

    out = f"label {kind}, dim int, ablock int, anchors binary, am binary, owner binary, window binary, low binary, high binary"
    return materialise(rows.groupBy("label", "dim", "ablock").applyInPandas(pack, out))


def _meet(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each window in each candidate block."""
    met = meet(materialise(pairs.select("label", "dim", "ablock", "other", "block")), asked, ["label", "dim", "ablock"], blocks.withColumnRenamed("label", "other"), ["other", "dim", "block"])
    return met.mapInPandas(_search(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100)) -> DataFrame:
    """rows, anchors: (id, label, v array<long>).  For each anchor and each of its `positives` best rows of its own label,
    the k best rows of other labels whose score is at least least[0] / least[1] and at most most[0] / most[1] of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    Scores are integer inner products, kept in the range of a long; higher ones come first, ties by the smaller id.  Rows
    whose id, label or v is null take no part.  Rows that repeat an id are separate candidates, an anchor's own id is none;
    of anchors that repeat an id the least (v, label) counts.  Rows meet anchors of their own dimension only; vectors
    without components have score 0 with each other.  A positive whose score is negative has an empty window, an anchor
    without positives no rows; so has an empty table.  Other columns are not read, whatever their names.

    The anchors are a stated query set against all rows, in blocks: a label with most of the rows is cut into blocks by hash,
    blocks are dealt to tasks by pair, and each task's answer is k rows a window.  Bounds found in one block of other
    labels spare the rest the reading of their lists where possible; no list, candidate or window is capped.
    """
    kind = rows.schema["label"].dataType.simpleString()
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows, anchors = (df.where(sound).select(F.col("id").cast("long").alias("id"), "label", "v", F.size("v").alias("dim")) for df in (rows, anchors))
    # A row that repeats can be wanted max(k, positives) times at most, however often it is there.
    copies = rows.groupBy("id", "label", "v", "dim").agg(F.count("*").alias("times"))
    rows = materialise(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(max(k, positives))).cast("int")))).drop("times"))
    chosen = materialise(anchors.groupBy("id").agg(F.min(F.struct("v", "label", "dim")).alias("x")).select("id", "x.*"))
    counts = sent(materialise(chosen.groupBy("label", "dim").agg(F.count("*").alias("n"))))
    chosen = chosen.join(counts, ["label", "dim"]).withColumn("ablock", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ANCHORS)).cast("int"))
    blocks = candidate_blocks(rows, kind)
    names = blocks.select(F.col("label").alias("other"), "dim", "block")

    whole = chosen.select(F.col("id").alias("anchor_id"), F.lit(0).alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    asked = _asked(chosen, whole, kind)
    same = asked.join(names, "dim").where("label = other")
    best = materialise(_best(_meet(same, asked, blocks, positives), positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score")))

    # The whole and the rest of the positive's score by the share's divisor: nothing overflows.
    def part(share: tuple[int, int], up: int) -> Column:
        return F.expr(f"{share[0]} * (positive_score div {share[1]}) + ({share[0]} * (positive_score % {share[1]}) + {up}) div {share[1]}")

    edges = best.where("positive_score >= 0").select("anchor_id", F.col("positive_rank").alias("window"), part(least, least[1] - 1).alias("low"), part(most, 0).alias("high"))
    windows = materialise(edges.where("low <= high"))
    asked = _asked(chosen, windows, kind)
    others = asked.select("label", "dim", "ablock").join(names, "dim").where("label <> other")
    # One block of another label first: its k-th scores are bounds for the others.
    first = others.groupBy("label", "dim", "ablock").agg(F.min(F.struct("other", "block")).alias("f")).select("label", "dim", "ablock", "f.other", "f.block")
    first = materialise(first)
    seeds = materialise(_meet(first, asked, blocks, k))
    bounds = seeds.groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    raised = windows.join(bounds, ["anchor_id", "window"], "left").select("anchor_id", "window", F.greatest("low", "kth").alias("low"), "high")
    rest = others.join(first, ["label", "dim", "ablock", "other", "block"], "left_anti")
    found = seeds.union(_meet(rest, _asked(chosen, raised, kind), blocks, k))
    negatives = _best(found, k).select("anchor_id", F.col("window").alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(negatives, ["anchor_id", "positive_rank"]).select(*(c.split()[0] for c in RESULT.split(", ")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    sound = table(spark, sf_dir, "embeddings").where(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    rows = sound.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(x, lambda e: F.floor(e * 256.0)).alias("v"))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


OP11_SQL = """
WITH e AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT id, (min({'v': v, 'label': label})).v AS v, (min({'v': v, 'label': label})).label AS label FROM e WHERE id % 100 = 0 GROUP BY id),
s AS (SELECT a.id AS anchor_id, e.id, a.label = e.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM a JOIN e ON a.id <> e.id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id)::INT AS positive_rank FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score, positive_rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE positive_rank <= 5)
SELECT * FROM n WHERE rank <= 10
"""
