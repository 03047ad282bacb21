"""Jobs over files: landing, compaction and publication that are lost halfway; late events; forked content."""

import json
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import families
from trafficlens.plans import publish
from trafficlens.plans import sql as sql_plan
from trafficlens.shared import shared_dir
from trafficlens.sources import log as source
from trafficlens.streaming import live


def rows_of(spark, silver):
    return sorted(map(tuple, spark.read.parquet(silver).select("kind", F.col("day").cast("string"), "n", "text").collect()))


def sizes(root):
    return {p.parent.relative_to(root).as_posix(): sorted(f.stat().st_size for f in p.parent.glob("*.parquet")) for p in root.rglob("*.parquet")}


def test_compaction(spark, tmp_path):
    silver = tmp_path / "silver"
    log = spark.range(20_000).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 3 > 0, "request").otherwise("hunt").alias("kind"), F.when(F.col("id") % 2 == 0, "2026-01-01").otherwise("2026-01-02").alias("day"))
    log.repartition(24).write.partitionBy("kind", "day").parquet(str(silver))
    before, small = rows_of(spark, str(silver)), sizes(silver)
    target = 3 * max(map(max, small.values()))
    bins = source.file_bins(spark.read.parquet(str(silver)), target).collect()
    assert len(bins) == sum(map(len, small.values())) and {b.bin for b in bins} == set(range(max(b.bin for b in bins) + 1))

    source.compact_days(spark, str(silver), ["2026-01-01", "2026-03-03"], target)
    after = sizes(silver)
    assert rows_of(spark, str(silver)) == before
    for place, files in after.items():
        if place.endswith("2026-01-02"):
            assert files == small[place]
        else:
            assert 2 <= len(files) <= -(-sum(small[place]) // target) and max(files) <= target + max(small[place])
    source.compact_days(spark, str(silver), [], target)
    assert sizes(silver) == after

    # Lost while packing: what there is has no mark of being whole, and is written anew.
    (silver / source.PACKED / "kind=hunt" / "day=2026-01-02").mkdir(parents=True)
    (silver / source.PACKED / "kind=hunt" / "day=2026-01-02" / "part-0.parquet").write_text("half")
    source.compact_days(spark, str(silver), ["2026-01-02"])
    assert rows_of(spark, str(silver)) == before and {len(f) for p, f in sizes(silver).items() if p.endswith("02")} == {1}

    # Lost between the old folder and the new one: the next run, whatever its days, puts the packed copy in its place.
    place = silver / "kind=hunt" / "day=2026-01-01"
    whole = silver / source.PACKED / "kind=hunt"
    whole.mkdir(parents=True)
    place.rename(whole / "day=2026-01-01")
    (silver / source.PACKED / "_SUCCESS").touch()
    source.compact_days(spark, str(silver), [])
    assert rows_of(spark, str(silver)) == before and not (silver / source.PACKED).exists()


def test_chunked_days(spark, tmp_path):
    names = [("2026-01-01.000000.jsonl",), ("2026-01-01.000000.jsonl.gz",), ("2026-01-01.000001.jsonl.gz",), ("tls-2026-01-01.7.jsonl",), ("2026-01-02.jsonl.gz",), ("2026-01-02.jsonl",), ("2026-01-02.x.jsonl",)]
    chosen = source.choose_files(spark.createDataFrame(names, "file string")).collect()
    assert {(r.file, r.stream, r.day, r.gz) for r in chosen} == {("2026-01-01.000000.jsonl", "events", "2026-01-01", False), ("2026-01-01.000001.jsonl.gz", "events", "2026-01-01", True), ("tls-2026-01-01.7.jsonl", "tls", "2026-01-01", False), ("2026-01-02.jsonl", "events", "2026-01-02", False)}
    lines = spark.range(100).select(F.when(F.col("id") % 4 == 0, "tls").otherwise("events").alias("stream"), F.lit("2026-01-01").alias("day"), F.format_string('{"kind": "k", "rid": "%d", "own": {"x": %d}}', "id", "id").alias("line"))
    source.land_days(lines, str(tmp_path / "log"), 10)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "log").glob("*.jsonl")) == 100 and len(list((tmp_path / "log").glob("tls-*"))) >= 3
    sql_plan.register_events_view(spark, str(tmp_path / "log"), "landed_events")
    found = spark.sql("SELECT count(DISTINCT rid) AS n, sum(variant_get(raw, '$.own.x', 'int')) AS s, count(status) AS none, min(day) AS day FROM landed_events").first()
    assert tuple(found) == (100, 4950, 0, "2026-01-01")


def test_publication_in_two_phases(spark, tmp_path):
    src, dst, key, now = tmp_path / "src", str(tmp_path / "dst"), b"k" * 32, datetime(2026, 1, 9, 12)
    src.mkdir()
    for day in ("2026-01-01", "2026-01-09"):
        (src / f"{day}.jsonl").write_text("".join(json.dumps({"kind": "request", "rid": str(i), "ts": f"{day}T01:00:00Z", "ip": "1.1.1.1", "path": "/", "headers": []}) + "\n" for i in range(3)))
    read = lambda: sorted((r.day, r.rid) for r in publish.read_published(spark, dst, "rid string").collect())
    assert read() == [] and publish.unfinished(spark, dst) == []
    publish.publish(spark, f"{src}/*.jsonl*", f"{dst}/runs/one", publish.committed(spark, dst), key, "salt", now)
    assert read() == [] and publish.unfinished(spark, dst) == ["one"]
    manifest = publish.publish_run(spark, f"{src}/*.jsonl*", dst, "two", key, "salt", now)
    assert [(r.day, r.rows) for r in manifest.collect()] == [("2026-01-01", 3)] and read() == [("2026-01-01", str(i)) for i in range(3)]
    publish.discard(spark, dst, "one")
    with pytest.raises(ValueError, match="two"):
        publish.discard(spark, dst, "two")
    later = publish.publish_run(spark, f"{src}/*.jsonl*", dst, "three", key, "salt", datetime(2026, 1, 10, 2))
    assert {r.day for r in later.collect()} == {"2026-01-01", "2026-01-09"} and len(read()) == 6
    again = publish.publish_run(spark, f"{src}/*.jsonl*", dst, "three", key, "salt", datetime(2026, 2, 1))
    assert again.count() == 2 and publish.unfinished(spark, dst) == [] and len(read()) == 6


def test_late_counts_and_a_replay(spark, tmp_path):
    source_dir, counts, state = tmp_path / "in", str(tmp_path / "late"), str(tmp_path / "state")
    stamp = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_timestamp("t").alias("ts"))
    deliveries = [("2026-01-01 10:00", "2026-01-03 00:59"), ("2026-01-01 11:00", "2026-01-02 11:00", "2026-01-03 02:00", None), ("2026-01-02 12:00", "2026-01-01 12:00", "2026-01-01 13:00", "2026-01-03 03:00")]

    def total():
        return {(r.batch, str(r.day)): r.late for r in spark.read.parquet(counts).where("day is not null").collect()}

    for n, some in enumerate(deliveries):
        stamp(*some).coalesce(1).write.mode("append").parquet(str(source_dir))
        live.count_late(spark.readStream.schema("ts timestamp").parquet(str(source_dir)), counts, state).trigger(availableNow=True).start().awaitTermination(60)
        if n == 1:
            # 2 January ends at midnight and is closed an hour after: 00:59 hadn't gone past that, 02:00 had.
            assert total() == {(1, "2026-01-01"): 1}
    assert total() == {(1, "2026-01-01"): 1, (2, "2026-01-01"): 2, (2, "2026-01-02"): 1}
    # The last micro-batch once more, as after a lost commit.
    (tmp_path / "state" / "commits" / "2").unlink()
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    live.count_late(spark.readStream.schema("ts timestamp").parquet(str(source_dir)), counts, state).trigger(availableNow=True).start().awaitTermination(60)
    assert total() == {(1, "2026-01-01"): 1, (2, "2026-01-01"): 2, (2, "2026-01-02"): 1}


def test_sketches_merge(spark):
    log = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(F.col("id") / 20_000) * 86_400).alias("ts"), F.concat(F.lit("a"), (F.col("id") % 20_000 + F.floor(F.col("id") / 20_000) * 10_000).cast("string")).alias("actor"), F.lit("request").alias("kind"))
    days = log.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("events"), F.count("*").alias("requests"), F.lit(0).alias("credential_attempts"), F.hll_sketch_agg("actor", 12).alias("actors"))
    found = {r.until: r for r in live.merge_days(days, 2).collect()}
    exact = {2: 20_000, 3: 30_000, 4: 30_000, 5: 20_000}
    assert {u.day: r.events for u, r in found.items()} == {2: 20_000, 3: 40_000, 4: 40_000, 5: 20_000}
    assert all(abs(r.actors - exact[u.day]) < 0.06 * exact[u.day] for u, r in found.items())


def test_forks(spark):
    rows = [(1, "request", "/docs/p001/00.html", None, "a", 10), (2, "request", "/docs/p002/00.html", "p001", "a", 12), (3, "request", "/docs/p002/01.html", "p001", "b", None), (4, "request", "/docs/p001/00.html", "", "a", 5), (5, "request", "/docs/p003/00.html", None, "a", 7), (6, "request", "/", None, "z", 1), (7, "hunt", "/docs/p001/00.html", None, "a", 1), (8, "request", "/docs/p001/00.html", None, None, 1), (9, "request", None, None, "a", 1)]
    log = spark.createDataFrame(rows, "seq long, kind string, path string, fork_of string, content_hash string, bytes long")
    got = {r.family: tuple(r)[1:] for r in families.fork_families(log).collect()}
    assert got == {"p001": (4, 2, 2, 2, 17, 1), "p003": (1, 1, 1, 0, 0, 0)}
    assert families.fork_families(log.limit(0)).collect() == []


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
