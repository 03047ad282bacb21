"""Writers: published days and their manifest, actor records, JSON documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stream string, day string, path string, rows bigint, dropped bigint, malformed bigint, bytes bigint, sha256 string, exported_at string"


#: Events of a published part file: a file is hashed by one task.
PART_ROWS = 1_000_000


def write_published(df: DataFrame, root: str) -> None:
    """Compact gzip JSON lines under stream=/day=; nulls stay.  A day that is written again replaces what an earlier,
    unfinished run left of it; other days stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "day")
    writer.option("compression", "gzip").option("ignoreNullFields", "false").option("maxRecordsPerFile", PART_ROWS).json(root)


def published_days(spark: SparkSession, root: str, days: list[tuple[str, str]]) -> DataFrame:
    """stream, day, path, bytes, sha256 of the given days only: the folder, the size of its part files and a hash of their
    hashes in the order of their names."""
    folders = [f"{root}/stream={stream}/day={day}" for stream, day in days]
    if not folders:
        return spark.createDataFrame([], "stream string, day string, path string, bytes bigint, sha256 string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folders)
    each = files.select(F.regexp_extract("path", "stream=([^/]*)", 1).alias("stream"), F.regexp_extract("path", "day=([^/]*)", 1).alias("day"), F.regexp_extract("path", "^(.*)/", 1).alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda x: x["hash"]), "")
    return each.groupBy("stream", "day").agg(F.min("path").alias("path"), F.sum("bytes").alias("bytes"), F.sha2(hashes, 256).alias("sha256"))


def update_manifest(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """One entry per stream and day, sorted; new entries replace old ones.  Write the data before the manifest."""
    stamped = new.withColumn("exported_at", F.lit(now.isoformat(timespec="seconds"))).select(*old.columns)
    return old.join(new.select("stream", "day"), ["stream", "day"], "left_anti").select(*old.columns).unionByName(stamped).orderBy("stream", "day")


def write_actors(records: DataFrame, path: str, payload_only: bool = False) -> None:
    """Actor records as JSON lines, by actor."""
    kept = records.where("reached_payload") if payload_only else records
    kept.orderBy("actor").write.option("ignoreNullFields", "false").json(path)


def write_digest(digest: DataFrame, path: str) -> None:
    """The one row of a digest as one JSON document."""
    digest.coalesce(1).write.option("ignoreNullFields", "false").json(path)
