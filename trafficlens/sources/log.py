"""Readers of the event log and of address ranges."""

from __future__ import annotations

import ipaddress
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..schema import FIELDS
from ..shared import materialise, sized

#: Names of day files: stream prefix, day, compression.  A day may come in numbered chunks (2026-01-01.0003.jsonl).
FILE = r"(?:^|/)(tls-)?(\d{4}-\d{2}-\d{2})(?:\.\d+)?\.jsonl(\.gz)?$"
#: The day of such a name.
DAY = r"(\d{4}-\d{2}-\d{2})(?:\.\d+)?\.jsonl"
CORRUPT = "_corrupt_record"
#: What makes a path a pattern.
GLOB = "*?[{"
#: Renames that are under way at once.
MOVES = 16
#: Lines of a chunk of a landed day.
CHUNK_LINES = 5_000_000
#: Tasks that write one landed day: making files takes longer than writing them.
LANES = 4
#: Bytes of a compacted file, about.
FILE_BYTES = 128 << 20
#: Folder of a silver table in which a compaction puts its files before they take their places.
PACKED = "_packed"


def files_of(reader: DataFrameReader, path: str) -> DataFrame:
    """What the reader makes of a folder, a file, or a pattern.  Of a pattern of names in one folder the folder is listed
    once; given as a pattern, Spark would list every file by itself."""
    folder, _, name = path.rpartition("/")
    if folder and set(name) & set(GLOB) and not set(folder) & set(GLOB):
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and seq of every non-blank line; seq sorts by day in the file name, then file name, then line.

    A gzip file is one block; a plain file is split, and its blocks sort by their start.  The last part of seq holds
    only within one reading: write the log before it is read twice.
    """
    lines = files_of(spark.read.format("text"), path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    day = F.regexp_extract("file", DAY, 1)
    seq = F.struct(F.when(day != "", day).otherwise(F.col("file")).alias("day"), "file", "block", F.monotonically_increasing_id().alias("line"))
    return lines.where(F.trim("value") != "").select(F.col("value").alias("line"), seq.alias("seq"), day.alias("day"))


def parse(lines: DataFrame) -> DataFrame:
    """The event's fields, `raw` (the whole line as VARIANT, for unknown keys) and what could not be read."""
    schema = f"{FIELDS}, {CORRUPT} string"
    event = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = [c for c in lines.columns if c != "line"]
    return lines.select(*kept, "line", event.alias("e"), F.try_parse_json("line").alias("raw")).select(*kept, "e.*", "raw", "line")


def lines_of(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """read_lines() of these day files (a written table of file, stream) alone, with `stream`: lines of other files are never
    parsed."""
    names = sized(files.select(F.col("file").alias("__file"), "stream"), "__file")
    return read_lines(spark, path).join(names, F.col("seq.file") == F.col("__file")).drop("__file")


def is_malformed(raw: Column, line: Column) -> Column:
    """Not JSON at all.  Valid JSON that is not an object is dropped without counting as malformed."""
    return raw.isNull() & (F.trim(line) != "null")


def is_event(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))


def read_log(spark: SparkSession, path: str, kinds: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Every event of the directory's or glob's *.jsonl* files, in the order of `seq`; malformed lines are skipped.

    `files` (from day_files) keeps those files only, so that of a day's plain and compressed copies one is read.
    """
    log = parse(read_lines(spark, path)).where(is_event(F.col("raw")))
    if files is not None:
        log = log.join(files.select(F.col("file").alias("f")), F.col("seq.file") == F.col("f"), "left_semi")
    return log.where(F.col("kind").isin(*kinds)) if kinds else log


def with_malformed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, counts): per file the malformed lines, and those that are JSON but no event."""
    every = parse(read_lines(spark, path))
    bad = every.groupBy("seq.file").agg(F.count_if(is_malformed(F.col("raw"), F.col("line"))).alias("malformed"), F.count_if(~is_malformed(F.col("raw"), F.col("line")) & ~is_event(F.col("raw"))).alias("not_events"))
    return every.where(is_event(F.col("raw"))), bad


def lacks(raw: Column, field: str) -> Column:
    """The logged line has no such key; a null under it is not missing."""
    value = F.variant_get(raw, f"$.{field}", "variant")
    return value.isNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """file, stream, day, gz, bytes: the day files of a directory; a plain file beats its compressed twin, foreign names
    are ignored."""
    names = files_of(spark.read.format("binaryFile"), path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return choose_files(names)


def choose_files(names: DataFrame) -> DataFrame:
    parsed = names.where(F.col("file").rlike(FILE)).withColumns({"stream": F.when(F.regexp_extract("file", FILE, 1) != "", "tls").otherwise("events"), "day": F.regexp_extract("file", FILE, 2), "gz": F.regexp_extract("file", FILE, 3) != ""})
    first = F.row_number().over(W.partitionBy(F.regexp_replace("file", r"\.gz$", "")).orderBy("gz"))
    return parsed.withColumn("k", first).where("k = 1").drop("k")


def land_days(lines: DataFrame, root: str, most: int = CHUNK_LINES) -> None:
    """(stream, day, line) -> day files under root, each in chunks of at most `most` lines; for tests, imports and queries.

    The lines are written where nobody looks for a log, then each part gets its name by one rename, so a reader never sees
    half a file.  Of a day that is landed again the new chunks replace the old ones of the same numbers.
    """
    spark = lines.sparkSession
    staged = f"{root}/_landing-{uuid.uuid4().hex}"
    lanes = lines.repartition("stream", "day", F.pmod(F.xxhash64("line"), F.lit(LANES)))
    lanes.write.partitionBy("stream", "day").option("maxRecordsPerFile", most).text(staged)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f["path"] for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(staged).select("path").collect())
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = {f.getPath().getName() for f in fs.listStatus(path(root))}
    number: dict[str, int] = {}

    def named(part: str) -> tuple[str, str]:
        stream, day = re.search(r"/stream=([^/]*)/day=([^/]*)/", part).groups()
        name = f"{'tls-' if stream == 'tls' else ''}{day}"
        number[name] = number.get(name, -1) + 1
        return part, f"{name}.{number[name]:06d}.jsonl"

    def move(part: str, name: str) -> None:
        to = path(f"{root}/{name}")
        if name in there:
            fs.delete(to, False)
        if not fs.rename(path(part), to):
            raise OSError(f"could not name {part}")

    # A rename takes the driver a few calls, and a large day has thousands of chunks.
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, *zip(*map(named, parts), strict=True))) if parts else None
    fs.delete(folder, True)


def pending_days(files: DataFrame, manifest: DataFrame, now: datetime, lag_minutes: int = 60) -> DataFrame:
    """Files of days that are over by the lag and not in the manifest (stream, day)."""
    over = (F.to_timestamp("day") + F.expr("INTERVAL 1 DAY") + F.make_dt_interval(mins=F.lit(lag_minutes))) <= F.lit(now)
    return files.where(over).join(manifest.select("stream", "day"), ["stream", "day"], "left_anti")


def lifecycle_plan(names: DataFrame, compress_after: int, delete_after: int, today: date) -> DataFrame:
    """file, action (`delete`, `compress` or null) by age in days; today's file always stays.  A negative number turns
    an action off."""
    own = names.where(F.col("file").rlike(FILE)).withColumn("age", F.datediff(F.lit(today), F.to_date(F.regexp_extract("file", FILE, 2))))
    gone = (F.lit(delete_after) >= 0) & (F.col("age") > delete_after)
    packed = (F.lit(compress_after) >= 0) & (F.col("age") >= max(1, compress_after)) & (F.regexp_extract("file", FILE, 3) == "")
    return own.select("file", "age", F.when(gone, "delete").when(packed, "compress").alias("action"))


def to_silver(log: DataFrame, out: str) -> None:
    """One table, partitioned by kind and day, so that later reads prune both."""
    log.drop("line").write.mode("append").partitionBy("kind", "day").parquet(out)


def compact_days(spark: SparkSession, silver: str, days: list[str], target: int = FILE_BYTES) -> None:
    """Packs the many small files of finished days of the silver table, in the order of their names, into files of about
    `target` bytes (more by one small file at most), kind by kind; one task writes one file, so no kind is one task.

    The packed rows are first written whole beside the table, and then each folder of the table gives way to its packed
    one.  A run that is lost is repeated: before the packed copy is whole nothing has changed, after it the next run of
    this function, for whatever days, finishes what was left.  Days without files are skipped.  The table is partitioned
    by kind and day alone.  Rows keep their values, not their order across files.
    """
    finish_compaction(spark, silver)
    wanted = spark.read.parquet(silver).where(F.col("day").cast("string").isin(days))
    bins = materialise(file_bins(wanted, target))
    last = bins.agg(F.max("bin")).first()[0]
    if last is None:
        return
    # bins is a written table of one row a file: Spark sends it to all executors if its size allows.
    rows = wanted.withColumn("__file", F.col("_metadata.file_path")).join(bins.select(F.col("file").alias("__file"), F.col("bin").alias("__bin")), "__file").drop("__file")
    rows.repartitionById(last + 1, "__bin").drop("__bin").write.mode("overwrite").partitionBy("kind", "day").parquet(f"{silver}/{PACKED}")
    finish_compaction(spark, silver)


def finish_compaction(spark: SparkSession, silver: str) -> None:
    """Puts a whole packed copy, if there is one, in the place of its days; one that isn't whole is written again later."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    packed = path(f"{silver}/{PACKED}")
    fs = packed.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(packed, "_SUCCESS")):
        return
    for kind in (f.getPath() for f in fs.listStatus(packed) if f.isDirectory()):
        for day in (f.getPath() for f in fs.listStatus(kind) if f.isDirectory()):
            to = path(f"{silver}/{kind.getName()}/{day.getName()}")
            fs.delete(to, True)
            if not fs.rename(day, to):
                raise OSError(f"could not move {day} to {to}")
    fs.delete(packed, True)


def file_bins(table: DataFrame, target: int) -> DataFrame:
    """file, bin of a table partitioned by kind and day: files in the order of their names fill bins of about `target`
    bytes, none over two kinds or days; bins are numbered from 0.  What is ordered here is one row a file."""
    files = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "kind", "day").distinct()
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("kind", "day").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("part", F.floor(before / target))
    numbered = files.select("kind", "day", "part").distinct().withColumn("bin", F.row_number().over(W.orderBy("kind", "day", "part")) - 1)
    return files.join(numbered, (files["kind"].eqNullSafe(numbered["kind"])) & (files["day"].eqNullSafe(numbered["day"])) & (files["part"] == numbered["part"])).select("file", F.col("bin").cast("int").alias("bin"))


# -- address ranges


@F.pandas_udf(T.StructType([T.StructField("lo", T.BinaryType()), T.StructField("hi", T.BinaryType()), T.StructField("cidr", T.StringType())]))
def _bounds(cidrs: pd.Series) -> pd.DataFrame:
    def bounds(text: str) -> tuple[bytes | None, bytes | None, str | None]:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return None, None, None
        return address_key(net[0]), address_key(net[-1]), str(net)

    return pd.DataFrame([bounds(c) for c in cidrs], columns=["lo", "hi", "cidr"])


def address_key(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bytes:
    """Version and value: sorts like the address, and the versions never mix."""
    return bytes([address.version]) + address.packed.rjust(16, b"\0")


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """operator, idx, cidr, lo, hi of a file {"operators": {operator: [cidr]}}; invalid blocks are dropped."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "operators map<string,array<string>>").alias("v"))
    return ranges_of(text.select(F.explode("v.operators").alias("operator", "cidrs")))


def ranges_of(lists: DataFrame) -> DataFrame:
    """(operator, cidrs) -> operator, idx, cidr, lo, hi.  An operator's list is dealt by its blocks, so no list is one task."""
    return blocks_of(lists.select("operator", F.posexplode("cidrs").alias("idx", "c")).repartition("operator", "idx"))


def blocks_of(blocks: DataFrame) -> DataFrame:
    """(operator, idx, c) -> operator, idx, cidr, lo, hi: the same of blocks that come one a row, so that a list of any length
    is no row; idx is what sorts an operator's blocks."""
    each = blocks.withColumn("b", _bounds("c"))
    return each.where("b.lo is not null").select("operator", "idx", "b.cidr", "b.lo", "b.hi")


def fetched_prefixes(payloads: DataFrame) -> DataFrame:
    """(operator, payload JSON text) -> operator, cidr: the prefixes under any of their names."""
    keys = ("ipv4Prefix", "ipv6Prefix", "ipv4prefix", "ipv6prefix", "prefix")
    entry = payloads.select("operator", F.explode(F.from_json("payload", "prefixes array<map<string,string>>")["prefixes"]).alias("p"))
    every = F.filter(F.array(*(F.try_element_at("p", F.lit(k)) for k in keys)), lambda x: x.isNotNull())
    return entry.select("operator", F.explode(every).alias("cidr"))


def merge_ranges(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """old (operator, cidrs), fetched (operator, cidr) -> operator, cidrs, changed: the sorted distinct fetched blocks;
    an operator for which nothing was fetched keeps its own."""
    new = fetched.groupBy("operator").agg(F.array_sort(F.collect_set("cidr")).alias("new"))
    both = old.join(new, "operator", "full")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("cidrs"))
    return both.select("operator", F.coalesce("new", "cidrs").alias("cidrs"), changed.alias("changed"))
