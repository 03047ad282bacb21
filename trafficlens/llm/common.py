"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import components, materialise, shared_dir

__all__ = ["SENT_ROWS", "components", "crc_mod", "materialise", "meet", "row_key", "sent", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of up to so many rows of a few numbers each (some 60 MB) may be sent to all executors.
SENT_ROWS = 2_000_000


def sent(df: DataFrame, cells: int = 0) -> DataFrame:
    """A written table of numbers, marked for sending to all executors if it is small; a larger one is joined by
    shuffle.  `cells`: what the arrays of all its rows hold."""
    return F.broadcast(df) if df.count() + cells <= SENT_ROWS else df


#: Pairs of blocks that a task compares, and the most tasks over which they are spread.
PAIRS_A_TASK, MOST_TASKS = 8, 20_000


def meet(pairs: DataFrame, left: DataFrame, left_on: list[str], right: DataFrame, right_on: list[str]) -> DataFrame:
    """One row per pair of blocks with the columns of both.  `pairs` is a written table of distinct pairs of names.
    Blocks go to the pairs they are in, and the pairs are spread evenly over as many tasks as their number asks for: the
    blocks of a hot group never gather in one task, and few bytes don't make few tasks of much work."""
    n = min(MOST_TASKS, max(1, -(-pairs.count() // PAIRS_A_TASK)))
    a, b = (pairs.join(blocks, on).repartition(n, *pairs.columns) for blocks, on in ((left, left_on), (right, right_on)))
    return a.join(b, pairs.columns)


def row_key() -> Column:
    """64-bit key of a document's row: its doc_id and text, either of which may be null or repeat."""
    return F.xxhash64("doc_id", "text")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(0))
