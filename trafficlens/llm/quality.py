"""Operator 1: quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text.  Every pair of a preferred and a rejected document
says that the difference of their features should point to the preferred one: the weights minimise the logistic loss
of those differences.  A quantile of the strengths of all labelled rows then divides good from bad.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialise, table

#: Labelled rows that the weights are fitted on, about (chosen by hash), and pairs made of each.
FIT_ROWS, PAIRS = 20_000, 4
#: The score at the threshold.
CUT = 0.3
FEATURES = ("log_words", "upper", "digits", "marks", "symbols", "other_bytes", "spaces", "word_length", "variety", "common_word", "echo", "same_lines", "bare_marks", "log_symbols", "log_echo", "log_upper", "log_variety")

_UPPER, _DIGIT, _MARK, _SYMBOL, _SPACE = (np.array([f(chr(i)) for i in range(256)]) for f in (lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in ".,;:!?'\"()-", lambda c: c.isascii() and c.isprintable() and not c.isalnum() and c not in ".,;:?'\"()- ", lambda c: c in " \t\n\r\v\f"))


def features(text: str | None) -> list[float]:
    """Of the whole text; a null text counts as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    words = (text or "").split()
    n, w = max(1, len(raw)), max(1, len(words))
    count = np.bincount(raw, minlength=256)
    upper, digits, marks, symbols, spaces = (float(count[x].sum()) / n for x in (_UPPER, _DIGIT, _MARK, _SYMBOL, _SPACE))
    times = Counter(words)
    variety = math.log1p(len(times)) / math.log1p(w)
    common = max(0, max(times.values(), default=0) - 1) / w
    echo = sum(map(str.__eq__, words, words[1:])) / w
    lines = (text or "").split("\n")
    same = 1 - len(set(lines)) / len(lines)
    bare = sum(times[x] for x in times if not x[0].isalnum() and not x[-1].isalnum()) / w
    low = lambda x: math.log(x + 0.002)
    return [math.log1p(len(words)), upper, digits, marks, symbols, float(count[128:].sum()) / n, spaces, min(60.0, n / w), variety, common, echo, same, bare, low(symbols), low(echo), low(upper), low(1 - min(1.0, variety))]


def featurise(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the carried columns, one column per feature)."""
    kept = ["doc_id", *carry]
    names = [*kept, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, rows.T)], names=names)

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the strength: logistic loss on the differences of pairs (preferred, rejected), by Newton's method."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    most = max(len(good), len(bad))
    rng = np.random.default_rng(1)
    i = np.concatenate([rng.permutation(np.resize(good, most)) for _ in range(PAIRS)])
    j = np.concatenate([rng.permutation(np.resize(bad, most)) for _ in range(PAIRS)])
    d = z[i] - z[j]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def best_level(s: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the strengths at which labels 0 and 1 are told apart best (balanced accuracy)."""
    order = np.argsort(s, kind="stable")
    bad, good = np.cumsum(y[order] == 0), np.cumsum(y[order] == 1)
    ok = bad / max(1, bad[-1]) + 1 - good / max(1, good[-1])
    ok[np.append(s[order][1:] == s[order][:-1], False)] = -1  # no cut between ties
    return float((np.argmax(ok) + 1) / len(s))


def _slope(s: np.ndarray, y: np.ndarray, at: float) -> float:
    """How steeply the score rises at the threshold, by the likelihood of the labels."""
    grid = np.geomspace(0.05, 20, 40) / (s.std() + 1e-9)
    base = math.log(CUT / (1 - CUT))
    loss = [np.logaddexp(0, -np.where(y == 1, 1, -1) * (base + a * (s - at))).mean() for a in grid]
    return float(grid[int(np.argmin(loss))])


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns of docs, score (0 to 1, higher: better), predicted (1 if score >= 0.3), one row per
    document.

    `labels` has doc_id and quality; rows whose quality is neither 0 nor 1 are ignored, and `learn` (on doc_id) says
    which may be learnt from.  About FIT_ROWS of them fit the weights; the threshold is a quantile over all of them.
    Without rows of both labels there is nothing to rank, and every score is 0.5.  Null and empty texts are scored as
    texts without words; equal texts get equal scores; repeated rows are each scored, and learnt from once; an empty table gives none.  A text
    of any length is read whole, and further columns of docs and labels are not read, whatever their names.
    """
    x = materialise(featurise(docs, carry))
    known = labels.where(F.col("quality").isin(0, 1)).where(F.lit(True) if learn is None else learn)
    known = materialise(x.join(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), "doc_id").drop(*carry).dropDuplicates())
    share = FIT_ROWS / max(1, known.count())
    # Chosen by what a row holds, which is there once: rows that repeat an id don't come to the driver all together.
    chosen = F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(1_000_003)) / 1_000_003.0 < share
    fit = known.where(chosen).toPandas().sort_values(["doc_id", *FEATURES])
    y, m = fit["quality"].to_numpy(int), fit[list(FEATURES)].to_numpy(float)
    if len(set(y)) < 2:
        return x.select("doc_id", *carry, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    w = fit_pairs(m, y)
    strength = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w, strict=True)), F.lit(0.0))
    cut = known.agg(F.percentile_approx(strength, F.lit(best_level(m @ w, y)), F.lit(100_000)).alias("c")).first()["c"]
    # The quantile is itself the last rejected row: the middle of the gap above it divides.
    above = known.where(strength > cut).agg(F.min(strength).alias("a")).first()["a"]
    cut = cut if above is None else (cut + above) / 2
    logit = F.lit(math.log(CUT / (1 - CUT))) + F.lit(_slope(m @ w, y, cut)) * (strength - F.lit(cut))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), logit))))
    return x.select("doc_id", *carry, score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
