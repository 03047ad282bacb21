"""What grows with the log, and what must not."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens import catalog, catalog_tables  # noqa: F401  (the second adds to the first)
from trafficlens.operators import identity, indicators
from trafficlens.plans import publish
from trafficlens.plans import sql as sql_plan
from trafficlens.sources import log as source
from trafficlens.sources import sinks
from trafficlens.streaming import live


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that the scan writes on its way."""
    rows = []
    real = indicators.materialise

    def counted(df: DataFrame) -> DataFrame:
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(indicators, "materialise", counted)
    return rows


def test_scan_goes_by_texts(spark, written):
    """A text is scanned once however many requests hold it, and no table of requests is written, or sent, on the way."""
    texts = F.when(F.col("id") % 2 == 0, "wget http://a.test/x").otherwise("hello")
    parts = spark.range(20_000).select((F.col("id") % 10_000).cast("string").alias("rid"), (F.col("id") >= 10_000).cast("int").alias("pos"), F.when(F.col("id") < 5, None).otherwise("query").alias("location"), texts.alias("text"), F.when(F.col("id") >= 5, True).alias("urls"))
    out = indicators.scan(parts)
    assert max(written) <= 4
    got = out.agg(F.count("*"), F.count_if(F.size("downloaders") == 1), F.count_if(F.size("urls") == 1), F.count_if(F.size("indicator_locations") == 2), F.count_if(F.size("wallets") == 0)).first()
    assert tuple(got) == (5_000, 5_000, 5_000, 5_000, 5_000)
    # Where it is not known whether a URL may be a payload (a header without a name), it is none.
    assert indicators.scan(parts.where("rid < '5' and rid in ('0', '2', '4') and pos = 0")).where(F.size("urls") > 0).isEmpty()


EVENTS = [("policy_read", "t1", "s", 0, "a"), ("policy_read", "t1", None, 5, None), ("trap_hit", "t1", None, 6, "a"), ("trap_hit", "t1", None, 7, None), ("trap_hit", "t1", None, 8, "b"), ("policy_read", "t2", "s", 0, "a"), ("trap_hit", "t1", None, 60 * 24 + 3, "a"), ("trap_hit", None, None, 9, "a"), ("policy_read", "t1", "s", 7, "b"), ("trap_hit", "t1", None, 2, "c")]


def events(spark, rows):
    of = spark.createDataFrame(rows, "kind string, token string, standard string, minute int, ip string")
    return of.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + F.lit(1_700_000_000)))


def test_read_fetch_counts(spark):
    """The counts are those of the pairs, also where addresses or standards are unknown, and no pair is made."""
    log = events(spark, EVENTS)
    pairs = sql_plan.read_fetch(log).groupBy("token", "read_standard").agg(F.count("*").alias("pairs"), F.count_if(F.col("reader_ip") != F.col("fetcher_ip")).alias("split"))
    assert sorted(map(str, sql_plan.read_fetch_counts(log).collect())) == sorted(map(str, pairs.collect()))
    many = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "policy_read").otherwise("trap_hit").alias("kind"), F.lit("t").alias("token"), F.lit("s").alias("standard"), (F.col("id") % 10).cast("string").alias("ip"))
    assert tuple(sql_plan.read_fetch_counts(many).first()) == ("t", "s", 10**10, 10**10)


def test_live_read_fetch_counts(spark, tmp_path):
    """Two micro-batches, with a read that comes after its fetch, count what the pairs of the whole log are."""
    log = events(spark, EVENTS)
    for n, rows in enumerate((EVENTS[::2], EVENTS[1::2])):
        events(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    found = live.live_read_fetch_counts(stream(), stream())
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("token").agg(F.sum("pairs"), F.sum("split")).collect()
    pairs = live.live_read_fetch(log, log)
    want = pairs.groupBy("token").agg(F.count("*"), F.count_if(F.col("reader_ip") != F.col("fetcher_ip"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_blocks_of_one_list_are_dealt(spark):
    """An operator's list is not parsed by one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lists = spark.range(1).select(F.lit("op").alias("operator"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.concat(F.lit("10."), i.cast("string"), F.lit(".0.0/16"))).alias("cidrs"))
        dealt = source.ranges_of(lists).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(dealt) > 1 and sum(r["n"] for r in dealt) == 256
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pattern_of_names_lists_the_folder(spark, tmp_path):
    """A pattern is a filter of one folder's names, so the reader is given one path; other files are left alone."""
    for name in ("2024-01-01.000000.jsonl", "2024-01-01.000001.jsonl", "notes.txt"):
        (tmp_path / name).write_text('{"kind": "hunt"}\n')
    assert source.read_log(spark, f"{tmp_path}/*.jsonl*").count() == 2
    found = source.files_of(spark.read.format("text"), f"{tmp_path}/*.jsonl*")
    assert len(found.inputFiles()) == 2 and "pathGlobFilter" not in found.columns


def test_publishing_goes_by_pending_lines(spark, tmp_path, monkeypatch):
    """Lines of days that are not due or done are not parsed, the others once; texts that hold no token are searched once."""
    parsed, searched = [], []
    parse, tokens = source.parse, publish.issued_tokens
    monkeypatch.setattr(source, "parse", lambda lines: parsed.append(lines.count()) or parse(lines))
    monkeypatch.setattr(publish, "issued_tokens", lambda texts, key: searched.append(texts.where("text <> ''").count()) or tokens(texts, key))
    (tmp_path / "src").mkdir()
    for day, n in (("2026-01-01", 3), ("2026-01-09", 5)):
        (tmp_path / "src" / f"{day}.jsonl").write_text('{"kind": "request", "rid": "1", "path": "/%41", "headers": []}\n' * n + "junk\n")
    src, dst, now = f"{tmp_path}/src/*.jsonl*", str(tmp_path / "dst"), datetime(2026, 1, 9, 12)
    manifest = sinks.MANIFEST
    first = publish.materialise(publish.publish(spark, src, dst, spark.createDataFrame([], manifest), b"k" * 32, "salt", now))
    assert parsed == [4] and searched == [3, 3]  # the second search is of what decoding makes of the texts
    assert [(r.day, r.rows, r.malformed) for r in first.collect()] == [("2026-01-01", 3, 1)]
    assert publish.publish(spark, src, dst, first, b"k" * 32, "salt", now).count() == 1 and parsed == [4]


def test_blocks_come_one_a_row(spark, monkeypatch):
    """No row holds an operator's whole list, whose length grows with the table."""
    given, match_range = [], identity.match_range
    monkeypatch.setattr(identity, "match_range", lambda claims, ranges: given.append(ranges) or match_range(claims, ranges))
    assert catalog.QUERIES["G1_many_blocks"](spark, "/root/testdata/sf0.001").count() > 0
    assert "collect_list" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
