"""Pairs of texts whose shingle sets are alike.

Bands of MinHash values yield candidates, whose values are compared a few at a time: a pair goes as soon as the posterior
probability that its similarity reaches the threshold falls below a tolerance.  What survives forms families; inside a
family all texts meet, in bins of small families or as pairs of blocks, and the pairs that the same comparison leaves are
verified on the whole shingle sets.  So links are counted without a row for each pair, however large a family is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, meet, sent

#: Probability below which a candidate is dropped.
TOLERANCE = 1e-4
#: Buckets of up to so many texts give pairs; the texts of larger ones form one family.
SMALL = 24
#: Texts and shingles of a block, and texts of a bin of small families, about.
BLOCK_ROWS, BLOCK_SHINGLES, BIN_ROWS = 512, 2_000_000, 128
#: Pairs that a task holds at once.
PAIRS_AT_ONCE = 1 << 18
SUMMARY = "id long, n long, root long"


@dataclass(frozen=True)
class Scheme:
    """`shingles` gives 64-bit hashes of the shingles of all texts and how many belong to each; a signature has `bands`
    bands of `band` values, of which `step` are compared at a time."""

    shingles: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    bands: int
    band: int
    step: int
    threshold: float = 0.8

    @property
    def hashes(self) -> int:
        return self.bands * self.band

    def signatures(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """MinHash values [texts, hashes], of each the lower 16 bits (different values are equal in them once in 65,536
        times); all ones for a text without shingles."""
        rng = np.random.default_rng(2)
        a, b = rng.integers(1, 1 << 31, self.hashes, dtype=np.uint32) * 2 + 1, rng.integers(0, 1 << 32, self.hashes, dtype=np.uint32)
        out = np.full((len(n), self.hashes), 0xFFFF, np.uint16)
        some = np.flatnonzero(n)
        if len(some):
            starts = (np.cumsum(n) - n)[some]
            x = (h >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                for k in range(self.hashes):
                    out[some, k] = np.minimum.reduceat(x * a[k] + b[k], starts) & np.uint32(0xFFFF)
        return out

    def fewest_matches(self) -> dict[int, int]:
        """After n compared values, the fewest matches with which a pair stays: with a uniform prior, the posterior
        probability of a similarity of at least t after m of n matches is P(Binomial(n + 1, t) <= m)."""
        t, out = self.threshold, {}
        for n in range(self.step, self.hashes + 1, self.step):
            tail, m = 0.0, -1
            while tail < TOLERANCE:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out[n] = m
        return out

    def prune(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (i of a, j of b) that incremental comparison leaves."""
        matches = np.zeros(len(i), np.int32)
        for n, least in self.fewest_matches().items():
            if len(i):
                matches += (a[i, n - self.step : n] == b[j, n - self.step : n]).sum(1, dtype=np.int32)
                keep = matches >= least
                i, j, matches = i[keep], j[keep], matches[keep]
        return i, j

    def links(self, sig: np.ndarray, sets: list[np.ndarray], sig2: np.ndarray, sets2: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose Jaccard similarity reaches the threshold."""
        i, j = self.prune(sig, sig2, i, j)
        common = overlaps(sets, sets2, i, j)
        size, size2 = np.array([len(s) for s in sets], np.int64), np.array([len(s) for s in sets2], np.int64)
        keep = common >= self.threshold * (size[i] + size2[j] - common) - 1e-9
        return i[keep], j[keep]

    def read(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Signatures and shingle sets."""
        h, n = self.shingles(texts)
        return self.signatures(h, n), [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


def overlaps(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets: one by one if pairs are few, else by products of 0/1 matrices over
    slices of the shingles."""
    if len(i) <= 2 * (len(x) + len(y)):
        return np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    all_x, all_y = np.concatenate([x[p] for p in rows]), np.concatenate([y[q] for q in cols])
    shared = np.intersect1d(all_x, all_y)
    total = np.zeros((len(rows), len(cols)), np.float32)
    for part in np.array_split(shared, max(1, -(-len(shared) // 8192))):
        m = []
        for flat, sets, some in ((all_x, x, rows), (all_y, y, cols)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1) if len(part) else np.zeros(len(flat), np.int64)
            hit = part[at] == flat if len(part) else np.zeros(len(flat), bool)
            one = np.zeros((len(some), max(1, len(part))), np.float32)
            one[np.repeat(np.arange(len(some)), [len(sets[p]) for p in some])[hit], at[hit]] = 1
            m.append(one)
        total += m[0] @ m[1].T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def summary(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """One row per text with links here, never one per pair: their number and the smallest id that they reach."""
    n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(n)
    return pd.DataFrame({"id": ids[some], "n": n[some].astype("int64"), "root": root[some]})


def _matrix(sigs: pd.Series, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(-1, scheme.hashes)


def _survivors(scheme: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = np.arange(len(pdf))
                keep, _ = scheme.prune(_matrix(pdf["sig"], scheme), _matrix(pdf["sig2"], scheme), at, at)
                yield pdf[["a", "b"]].iloc[keep]

    return run


def _bin(scheme: Scheme):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs of many small families."""
        pdf = pdf.sort_values("family", kind="stable")
        sig, sets = scheme.read(pdf["text"].tolist())
        size = np.unique(pdf["family"].to_numpy(), return_counts=True)[1]
        pairs = [np.triu_indices(n, 1) for n in size]
        first = np.repeat(np.cumsum(size) - size, [len(p[0]) for p in pairs])
        i, j = scheme.links(sig, sets, sig, sets, *(np.concatenate([p[k] for p in pairs]) + first for k in (0, 1)))
        return summary(pdf["id"].to_numpy(), i, j)

    return run


def _block(scheme: Scheme):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, sets = scheme.read(pdf["text"].tolist())
        sizes = np.array([len(s) for s in sets], "<i8")
        return pd.DataFrame({"family": pdf["family"].iloc[:1], "block": pdf["sub"].iloc[:1], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "sigs": [sig.tobytes()], "sizes": [sizes.tobytes()], "sets": [np.concatenate(sets).tobytes()]})

    return run


def _blocks(scheme: Scheme):
    def side(r: object, mark: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sets = np.split(np.frombuffer(getattr(r, "sets" + mark), "<u8"), np.cumsum(np.frombuffer(getattr(r, "sizes" + mark), "<i8"))[:-1])
        return np.frombuffer(getattr(r, "ids" + mark), "<i8"), np.frombuffer(getattr(r, "sigs" + mark), "<u2").reshape(-1, scheme.hashes), sets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                (ids, sig, sets), (ids2, sig2, sets2) = side(r, ""), side(r, "2")
                same, found = r.block == r.block2, []
                step = max(1, PAIRS_AT_ONCE // len(ids2))
                for at in range(0, len(ids), step):
                    i, j = (x.ravel() for x in np.mgrid[at : min(at + step, len(ids)), 0 : len(ids2)])
                    i, j = (i[i < j], j[i < j]) if same else (i, j)
                    found.append(scheme.links(sig, sets, sig2, sets2, i, j))
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if len(i):
                    yield summary(ids if same else np.concatenate([ids, ids2]), i, j if same else j + len(ids))

    return run


def find_links(texts: DataFrame, fetch: Callable[[DataFrame], DataFrame], scheme: Scheme) -> DataFrame:
    """texts: id (unique), n (shingles, about), sig -> (id, n, root): for each text with links a few rows, whose n add up
    to the number of its links and whose roots are texts of its component.  `fetch` gives (id, text) for a table of ids.

    A hot bucket never gathers in one task: its minimum and size combine before the shuffle, its texts go into blocks of
    bounded size, and the pairs of blocks are spread evenly over tasks."""
    wide = 2 * scheme.band
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * wide + 1, wide)) for k in range(scheme.bands)))
    members = texts.where("n > 0").select("id", F.explode(keys).alias("bucket"))
    # Most buckets hold one text: they are counted by themselves, and only the others' texts are gathered.
    shared = sent(materialise(members.groupBy("bucket").count().where("count > 1").select("bucket")))
    members = materialise(members.join(shared, "bucket"))
    full = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size"))
    members = materialise(members.join(full, "bucket"))

    small = members.where(F.col("size") <= SMALL)
    left, right = small.select("bucket", F.col("id").alias("a")), small.select("bucket", F.col("id").alias("b"))
    pairs = left.join(right, "bucket").where("a < b").select("a", "b").distinct()
    sigs = texts.join(sent(materialise(small.select("id").distinct())), "id", "left_semi").select(F.col("id").alias("a"), "sig")
    sigs = materialise(sigs)
    signed = pairs.join(sigs, "a").join(sigs.select(F.col("a").alias("b"), F.col("sig").alias("sig2")), "b")
    alike = signed.mapInPandas(_survivors(scheme), "a long, b long")
    led = members.where(F.col("size") > SMALL).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    families = components(materialise(alike.union(led))).withColumnRenamed("node", "id").withColumnRenamed("root", "family")

    families = materialise(families)
    families = materialise(texts.select("id", F.col("n").alias("shingles")).join(sent(families), "id"))
    sizes = families.groupBy("family").agg(F.count("*").alias("rows"), F.sum("shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES))
    families = materialise(families.select("id", "family").join(sizes.select("family", parts.alias("parts")), "family"))
    total = families.count()
    found = materialise(fetch(families.select("id")).join(families, "id"))

    bins = F.pmod(F.xxhash64("family"), F.lit(max(1, total // BIN_ROWS))).cast("int")
    in_bins = found.where("parts = 1").withColumn("bin", bins).select("bin", "family", "id", "text").groupBy("bin").applyInPandas(_bin(scheme), SUMMARY)
    if families.where("parts > 1").isEmpty():
        return materialise(in_bins)
    large = found.where("parts > 1").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = materialise(large.select("family", "sub", "id", "text").groupBy("family", "sub").applyInPandas(_block(scheme), "family long, block int, ids binary, sigs binary, sizes binary, sets binary"))
    other = blocks.select("family", *(F.col(c).alias(f"{c}2") for c in ("block", "ids", "sigs", "sizes", "sets")))
    names = blocks.select("family", "block")
    meetings = materialise(names.join(names.withColumnRenamed("block", "block2"), "family").where("block <= block2"))
    in_blocks = meet(meetings, blocks, ["family", "block"], other, ["family", "block2"]).drop("family").mapInPandas(_blocks(scheme), SUMMARY)
    return materialise(in_bins.union(in_blocks))
