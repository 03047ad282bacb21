"""What is found in requests, looked for once in each distinct content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, small

#: The fields in which the scanners look.
FIELDS = ("raw_path", "path", "raw_query", "headers", "body", "body_encoding")


#: Fields by which rows without a content are spread.
SPREAD = ("seq", "event_id", "rid", "ts", "ip")


def joined(log: DataFrame, content: Column, found: DataFrame) -> DataFrame:
    """log with what is found in its contents.  Rows without one (half of a log) have no key, and would all be one task's:
    they are spread by what else they hold."""
    few = small(found, "__text")
    found = found.drop("rid", "__text")
    if few:
        return log.join(F.broadcast(found), content == F.col("__content"), "left").drop("__content")
    others = F.xxhash64(F.lit(0), *(c for c in SPREAD if c in log.columns))
    left = log.withColumn("__of", content).withColumn("__key", F.when(F.col("__of").isNull(), others).otherwise(F.xxhash64("__of")))
    right = found.withColumn("__at", F.xxhash64("__content")).hint("merge")
    return left.join(right, (F.col("__key") == F.col("__at")) & (F.col("__of") == F.col("__content")), "left").drop("__content", "__of", "__key", "__at")


def contents_found(log: DataFrame, where: Column, find: Callable[[DataFrame], DataFrame]) -> tuple[Column, DataFrame]:
    """The content of a row of the log (null where `where` doesn't hold), and a written table: __content, __text (its length
    counts for sized()), rid and the columns that `find` gives."""
    asked = F.coalesce(where, F.lit(False))
    content = F.struct(*(c for c in FIELDS if c in log.columns))
    seen = log.where(asked).select(content.alias("__content")).distinct()
    # Written, as the ids must not change between two readings.
    seen = materialise(seen.withColumn("rid", F.monotonically_increasing_id().cast("string")))
    found = materialise(seen.join(find(seen.select("rid", "__content.*")), "rid").withColumn("__text", F.to_json("__content")))
    return F.when(asked, content), found


def with_found(log: DataFrame, where: Column, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """log with the columns that `find` gives, for its rows for which `where` holds; null for the others.

    find: requests (rid and FIELDS) -> one row per rid in which there is anything.  It is given each distinct content once,
    under an id of its own; the log is neither grouped nor ordered.
    """
    content, found = contents_found(log, where, find)
    return joined(log, content, found)


def written_with_found(log: DataFrame, where: Column, find: Callable[[DataFrame], DataFrame], *needless: str) -> DataFrame:
    """with_found() without the columns `needless`, as a written table, for several readers.

    If what is found is few rows, the log is written with an id in its place, and each reader joins those of the columns that
    it needs: written for every row, they take far longer than the log.
    """
    content, found = contents_found(log, where, find)
    if not small(found, "__text"):
        return materialise(joined(log, content, found).drop(*needless))
    ids = found.select("__content", F.col("rid").cast("long").alias("__found"))
    plain = materialise(log.join(F.broadcast(ids), content == F.col("__content"), "left").drop("__content", *needless))
    found = found.drop("__content", "__text").withColumn("__found", F.col("rid").cast("long")).drop("rid")
    return plain.join(F.broadcast(found), "__found", "left").drop("__found")
