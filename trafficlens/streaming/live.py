"""The operators over a growing log."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from io import StringIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import rules as fixed
from ..sources.log import DAY, is_event, parse


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of new files under a path.  A stream has no line order: sort by (ts, rid, kind).  Land closed chunks with
    rising modification times, as the source sees files, not appended lines."""
    lines = spark.readStream.format("text").load(path).where(F.trim("value") != "")
    named = lines.select(F.col("value").alias("line"), F.lit(None).cast("string").alias("seq"), F.regexp_extract("_metadata.file_name", DAY, 1).alias("day"))
    log = parse(named).where(is_event(F.col("raw"))).drop("raw", "line", "seq")
    return log.withColumn("ts", F.try_to_timestamp("ts"))


def daily_counts(stream: DataFrame, late: str = "60 minutes") -> DataFrame:
    """day, kind, events; a day closes when the watermark is past its midnight, later events are dropped and show in the
    query's progress."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("day"), "kind", "events")


def rolling_digest(stream: DataFrame, days: int, late: str = "60 minutes") -> DataFrame:
    """Per day and the days before it: events, requests, credential attempts, about how many actors."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"))
    found = windows.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "credential").alias("credential_attempts"), F.approx_count_distinct("actor").alias("actors"))
    return found.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "events", "requests", "credential_attempts", "actors")


def day_sketches(stream: DataFrame, late: str = "60 minutes", k: int = 12) -> DataFrame:
    """day, events, requests, credential_attempts, actors: a row when a day closes; `actors` is a sketch of 2**k registers
    (some kilobytes, relative error about 1.04 / 2**(k / 2)), which days of any number can merge (`merge_days`)."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    found = days.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "credential").alias("credential_attempts"), F.hll_sketch_agg("actor", k).alias("actors"))
    return found.select(F.col("w.start").alias("day"), "events", "requests", "credential_attempts", "actors")


def merge_days(sketches: DataFrame, days: int) -> DataFrame:
    """since, until, events, requests, credential_attempts, actors (about): windows of the days up to each day, made of
    day_sketches alone, so that no event is read again when the window moves."""
    each = sketches.withColumn("until", F.explode(F.sequence(F.date_trunc("day", "day") + F.expr("INTERVAL 1 DAY"), F.date_trunc("day", "day") + F.make_dt_interval(F.lit(days)), F.expr("INTERVAL 1 DAY"))))
    total = each.groupBy("until").agg(F.sum("events").alias("events"), F.sum("requests").alias("requests"), F.sum("credential_attempts").alias("credential_attempts"), F.hll_sketch_estimate(F.hll_union_agg("actors")).alias("actors"))
    return total.select((F.col("until") - F.make_dt_interval(F.lit(days))).alias("since"), "until", "events", "requests", "credential_attempts", "actors")


def count_late(stream: DataFrame, counts: str, checkpoint: str, late: timedelta = timedelta(minutes=60)) -> DataStreamWriter:
    """The writer of a table counts/batch= (seen, day, late): the greatest time each micro-batch saw, and per day how many of
    its events came after an earlier micro-batch had gone past the day's end by `late`, when the day was closed.

    A micro-batch that is repeated after a crash replaces its own rows and sees the same earlier ones, so nothing is
    counted twice.  Batches without late events keep one row (day null); events without a time are never late.
    """

    def count(batch: DataFrame, number: int) -> None:
        spark, shape = batch.sparkSession, "seen timestamp, day date, late long, batch long"
        batch = batch.select("ts")
        path = spark._jvm.org.apache.hadoop.fs.Path(counts)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        before = spark.read.schema(shape).parquet(counts).where(F.col("batch") < number).agg(F.max("seen")).first()[0] if there else None
        closed = F.lit(before - late if before is not None else None).cast("timestamp")
        day = F.to_date("ts")
        is_late = (F.date_add(day, 1).cast("timestamp") <= closed) & F.col("ts").isNotNull()
        by_day = batch.groupBy(F.when(is_late, day).alias("day")).agg(F.max("ts").alias("seen"), F.count("*").alias("n"))
        rows = by_day.select("seen", "day", F.when(F.col("day").isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("late"), F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts)

    return stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)


def dedupe_claims(stream: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Each (ip, claimed) once per ttl."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["ip", "claimed"])


def live_read_fetch(reads: DataFrame, hits: DataFrame, max_delay: str = "1 day") -> DataFrame:
    """Trap hits beside the policy read that minted their token, at most max_delay earlier."""
    r = reads.where("kind = 'policy_read'").select(F.col("token").alias("read_token"), F.col("ts").alias("read_ts"), F.col("ip").alias("reader_ip")).withWatermark("read_ts", max_delay)
    h = hits.where("kind = 'trap_hit'").select("token", F.col("ts").alias("fetch_ts"), F.col("ip").alias("fetcher_ip")).withWatermark("fetch_ts", "10 minutes")
    return r.join(h, F.expr(f"token = read_token AND fetch_ts >= read_ts AND fetch_ts <= read_ts + INTERVAL {max_delay}")).drop("read_token")


FETCHES = "token string, fetch_ts timestamp, fetcher_ip string, pairs long, split long"


def _in_reach(reads: pd.DataFrame, hits: pd.DataFrame, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per hit the reads (both: t in microseconds, ip) at most `reach` before it, and those of another address."""
    n = len(reads)
    code, _ = pd.factorize(pd.concat([reads["ip"], hits["ip"]], ignore_index=True))
    order = np.argsort(reads["t"].to_numpy(), kind="stable")
    times, ips = reads["t"].to_numpy()[order], code[:n][order]
    low, high = np.searchsorted(times, hits["t"].to_numpy() - reach, "left"), np.searchsorted(times, hits["t"].to_numpy(), "right")
    known = np.append(0, np.cumsum(ips >= 0))
    # Reads by address and place in time, as one number; addresses that are null (-1) differ from none.
    keys = np.sort(ips.astype(np.int64) * (n + 1) + np.arange(n))
    own = code[n:].astype(np.int64) * (n + 1)
    same = np.searchsorted(keys, own + high, "left") - np.searchsorted(keys, own + low, "left")
    return high - low, np.where(code[n:] >= 0, known[high] - known[low] - same, 0)


def live_read_fetch_counts(reads: DataFrame, hits: DataFrame, max_delay: timedelta = timedelta(days=1), late: timedelta = timedelta(days=1)) -> DataFrame:
    """token, fetch_ts, fetcher_ip, pairs, split: per trap hit how many policy reads minted its token at most max_delay
    earlier, and how many of them from another address, by sorting instead of a row for every pair.

    Rows add up: reads that come in a later micro-batch than a hit give it another row.  A token's state is its reads and
    hits as far back as the watermark (`late`) and max_delay let them still meet; it is sorted in one task.
    """
    reach = max_delay // timedelta(microseconds=1)
    wait = int((late + max_delay).total_seconds() * 1000)
    empty = pd.DataFrame({"t": np.array([], np.int64), "ip": np.array([], object)})

    def load(text: str) -> pd.DataFrame:
        return pd.read_json(StringIO(text), orient="split", dtype={"t": "int64", "ip": "object"}, convert_dates=False, precise_float=True)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_reads, old_hits = map(load, state.get) if state.exists else (empty, empty)
        new = pd.concat(list(batches), ignore_index=True)
        new_reads, new_hits = (new.loc[new["is_read"] == r, ["t", "ip"]].reset_index(drop=True) for r in (True, False))
        every_read = pd.concat([old_reads, new_reads], ignore_index=True)
        for told, asking in ((every_read, new_hits), (new_reads, old_hits)):
            if len(told) and len(asking):
                pairs, split = _in_reach(told, asking, reach)
                some = pairs > 0
                yield pd.DataFrame({"token": key[0], "fetch_ts": pd.to_datetime(asking["t"][some], unit="us"), "fetcher_ip": asking["ip"][some], "pairs": pairs[some], "split": split[some]})
        # What the watermark has passed comes no more: reads can meet hits from it on, hits reads from max_delay before it.
        passed = state.getCurrentWatermarkMs() * 1000
        every_hit = pd.concat([old_hits, new_hits], ignore_index=True)
        kept_reads, kept_hits = every_read[every_read["t"] >= passed - reach], every_hit[every_hit["t"] >= passed]
        state.update(tuple(x.reset_index(drop=True).to_json(orient="split", index=False) for x in (kept_reads, kept_hits)))
        state.setTimeoutTimestamp(max(int(new["t"].max()) // 1000, state.getCurrentWatermarkMs()) + wait)

    side = lambda df, kind, is_read: df.where((F.col("kind") == kind) & F.col("token").isNotNull() & F.col("ts").isNotNull()).select("token", "ts", F.unix_micros("ts").alias("t"), "ip", F.lit(is_read).alias("is_read"))
    both = side(reads, "policy_read", True).union(side(hits, "trap_hit", False)).withWatermark("ts", f"{int(late.total_seconds())} seconds")
    return both.groupBy("token").applyInPandasWithState(run, FETCHES, "reads string, hits string", "append", GroupStateTimeout.EventTimeTimeout)


def _rank(pdf: pd.DataFrame) -> pd.Series:
    """The stage that each event by itself proves."""
    hunt = pdf["kind"] == "hunt"
    rank = pd.Series(0, pdf.index)
    rank[hunt & (pdf["family"].notna() | pdf["web_attack"].notna())] = 1
    rank[hunt & pdf["decoy_served"].eq(True)] = 2
    rank[hunt & pdf["stage"].eq(True)] = 3
    rank[(pdf["kind"] == "credential") | hunt & pdf["web_attack"].isin(["sqli", "php_rce_attempt"]) | pdf["payload"].eq(True)] = 4
    return rank


def live_sessions(stream: DataFrame, ttl: timedelta = timedelta(days=30)) -> DataFrame:
    """actor, ts, stage, events: a row whenever an actor reaches a higher stage than before (and its first).

    An actor's state is two numbers, so a hot actor costs no more than others, and is dropped when the actor has been
    silent for `ttl` of the stream's running time: it then begins anew.
    """
    wait = int(ttl.total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, events = state.get if state.exists else (-1, 0)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "kind"], kind="stable")
            rank = _rank(pdf).to_numpy()
            risen = np.maximum.accumulate(np.append(best, rank))
            at = np.flatnonzero(risen[1:] > risen[:-1])
            if len(at):
                yield pd.DataFrame({"actor": key[0], "ts": pdf["ts"].to_numpy()[at], "stage": [fixed.STAGES[r] for r in rank[at]], "events": events + at + 1})
            best, events = int(risen[-1]), events + len(pdf)
        state.update((best, events))
        state.setTimeoutDuration(wait)

    has = set(stream.columns)
    carried = [F.size(c) > 0 for c in ("attacks", "honeytokens") if c in has] + ([(F.size("indicators.wallets") > 0) | (F.size("indicators.pools") > 0) | (F.size("indicators.urls") > 0) | (F.size("indicators.miners") > 0)] if "indicators" in has else [])
    payload = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(True)) for c in carried], F.lit(False))
    slim = stream.where("actor <> ''").select("actor", "ts", "kind", "family", "web_attack", "decoy_served", "stage", payload.alias("payload"))
    return slim.groupBy("actor").applyInPandasWithState(run, "actor string, ts timestamp, stage string, events long", "best int, events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_defied(stream: DataFrame, ttl: timedelta = timedelta(days=30)) -> DataFrame:
    """client, ts, path: forbidden fetches after the client's first read of a robots file, as they come.

    The stream needs client, ts, kind, standard, path and forbidden (the verdict of the rules for its request).  A
    client's state is the time of its first read, and is dropped when the client has been silent for `ttl` of the stream's
    running time.  Fetches are held against the reads that have come by the end of their micro-batch, so a task holds one
    client's forbidden fetches of one micro-batch; a read that comes in a later one doesn't call them back.
    """
    wait = int(ttl.total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        held = []
        for pdf in batches:
            reads = pdf.loc[pdf["kind"].isin(["policy_read", "trap_hit"]) & pdf["standard"].isin(fixed.ROBOTS_STANDARDS), "ts"].min()
            if pd.notna(reads) and (first is None or reads < first):
                first = reads
            held.append(pdf.loc[pdf["kind"].eq("request") & pdf["forbidden"].eq(True), ["ts", "path"]])
        if first is None:
            return
        state.update((first.value // 1000,))
        state.setTimeoutDuration(wait)
        for fetches in held:
            after = fetches[fetches["ts"] > first]
            if len(after):
                yield pd.DataFrame({"client": key[0], "ts": after["ts"], "path": after["path"]})

    slim = stream.where("client is not null").select("client", "ts", "kind", "standard", "path", "forbidden")
    return slim.groupBy("client").applyInPandasWithState(run, "client string, ts timestamp, path string", "first long", "append", GroupStateTimeout.ProcessingTimeTimeout)


@contextmanager
def only_data(spark: SparkSession) -> Iterator[None]:
    """Streams started inside run no batch without new data.  State that ends by running time asks for such batches for
    ever, so a stream that should stop when it has read what is there (availableNow) must be started so."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_silver_batch(batch: DataFrame, number: int, silver: str, source: str = "log") -> None:
    """A micro-batch as silver/kind=/day=/batch=: what an earlier attempt at the same batch wrote there is replaced, so a
    stream that is stopped between its data and its commit gives each row once when it starts again."""
    rows = batch.withColumns({"day": F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")), "kind": F.coalesce("kind", F.lit("unknown")), "batch": F.lit(f"{source}-{number:012d}")})
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("kind", "day", "batch").parquet(silver)


def to_silver(stream: DataFrame, silver: str, checkpoint: str, source: str = "log") -> DataStreamWriter:
    """The writer of a stream of events into the silver table; start it with a trigger of your choice.  `source` tells
    apart the batches of streams that write to one table.  Reads of the table prune kind and day."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_silver_batch(batch, number, silver, source)).option("checkpointLocation", checkpoint)
