"""Operator 2: n-gram Jaccard join with Bayesian candidate pruning.

Copies of a text (equal but for case and white space) form one class.  The classes' five-word shingles get MinHash
signatures, whose bands yield candidates.  A candidate pair's MinHash values are compared a few at a time, and it is
dropped as soon as the posterior probability that its similarity reaches the threshold falls below a tolerance; what
survives is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, row_key, sent, table
from .near_pairs import Scheme, find_links

WORDS = 5
#: 25 bands of 5 values: a pair at similarity 0.8 shares no band with probability 5e-5.
BANDS, BAND = 25, 5
#: MinHash values compared at a time.
STEP = 25
CHARS_AT_ONCE = 4_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts (given as words), and how many belong to each; a text of one to four
    words is one shingle."""
    place: dict[str, int] = {}
    flat = np.array([place.setdefault(w, len(place)) for ws in texts for w in ws], np.int64)
    n = np.array(list(map(len, texts)), np.int64)
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in place], np.uint64)[flat] if len(flat) else np.zeros(0, np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS - 1, np.uint64)])
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), np.uint64)
        for k in range(WORDS):
            there = inside + k < n[owner]
            total += np.where(there, _scramble(padded[k : k + len(h)] + _MIX[k]) * _MIX[(k + 1) % WORDS], np.uint64(k + 1))
        total = _scramble(total)
    whole = (inside + WORDS <= n[owner]) | (inside == 0)
    return total[whole], np.bincount(owner[whole], minlength=len(n))


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars < CHARS_AT_ONCE):
            chars += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def text_key(words: list[str]) -> tuple[int, int]:
    """128 bits of a text as words, as two signed numbers."""
    k = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "replace"))
    return (k & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (k >> 64) - (1 << 63)


SCHEME = Scheme(lambda texts: shingles([t.lower().split() for t in texts]), BANDS, BAND, STEP)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128 bits that equal texts share), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(t.lower().split()) for t in batch.column("text").to_pylist()]
            low, high = (pa.array(k, pa.int64()) for k in (zip(*keys, strict=True) if keys else ([], [])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), low, high, batch.column("text")], names=["doc_id", "k1", "k2", "text"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, text string")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, dk, k1, k2 (null for a null text), n shingles, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, to in batches_of(texts):
                words = [(t or "").lower().split() for t in texts[at:to]]
                keys = [(None, None) if t is None else text_key(w) for t, w in zip(texts[at:to], words, strict=True)]
                h, n = shingles(words)
                sig = SCHEME.signatures(h, n)
                low, high = (pa.array(k, pa.int64()) for k in zip(*keys, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in ("doc_id", "dk")), low, high, pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "dk", "k1", "k2", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, dk long, k1 long, k2 long, n long, sig binary")


def near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept, dk (key of the row's id and text): one row per row of docs.

    class_id is the smallest doc_id reachable by links, n_links the number of other texts whose five-word shingle sets
    have a Jaccard similarity of at least the threshold, n_copies the rows with this same text (but for case and white
    space), and kept marks the document that stands for its class.

    A null text or null doc_id links with nothing and is kept, class_id being its own doc_id; texts without words are
    copies of each other only; a text of one to four words is a single shingle.  Repeated rows are copies, and all copies of
    the kept text with the kept doc_id are kept.  Rows that share a doc_id but not the text are texts by themselves.  An empty table
    gives an empty result; long texts are read whole; further columns of docs are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("dk"))
    rows = materialise(sign(docs))
    texts = rows.where("k1 is not null and doc_id is not null").groupBy("k1", "k2")
    texts = materialise(texts.agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.min("n").alias("n"), F.min("sig").alias("sig")))

    def fetch(ids: DataFrame) -> DataFrame:
        firsts = materialise(texts.select("first", F.col("k1").alias("id")).join(ids, "id", "left_semi"))
        found = docs.where("text is not null").drop("dk").join(sent(firsts.select(F.col("first").alias("doc_id")).distinct()), "doc_id")
        return keyed(found).select(F.col("k1").alias("id"), "text").join(sent(ids), "id", "left_semi").dropDuplicates(["id"])

    links = find_links(texts.select(F.col("k1").alias("id"), "n", "sig"), fetch, replace(SCHEME, threshold=threshold))
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = texts.select("k1", "k2", "first", "n_copies").join(counts.withColumnRenamed("id", "k1"), "k1", "left").join(roots.withColumnRenamed("node", "k1"), "k1", "left")
    classes = materialise(classes)
    text = F.struct("first", "k1", "k2")
    least = classes.where("root is not null").groupBy("root").agg(F.min(text).alias("least"))
    leads = F.coalesce(F.col("least") == text, F.lit(True)).alias("leads")
    classes = classes.join(least, "root", "left").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "n_copies", "n_links", F.coalesce("least.first", "first").alias("class"), leads)
    classes = materialise(classes)
    # One text may have a third of all rows: the rows are spread by salt, and each class goes to all salts.
    salts = 16
    salted = rows.select("doc_id", "dk", "k1", "k2").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    classes = classes.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = salted.join(classes, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & (F.col("salt") == F.col("salt2")) & F.col("doc_id").isNotNull(), "left")
    class_id = F.coalesce("class", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce((F.col("doc_id") == class_id) & F.coalesce("leads", F.lit(True)), F.lit(True)).alias("kept"), "dk")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).drop("dk")
