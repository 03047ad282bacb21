import json
import os
import time
from contextlib import nullcontext
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.streaming import live


def land(folder, n, events):
    """A closed chunk, with rising modification times."""
    path = folder / f"2026-01-0{n}.jsonl"
    path.write_text("".join(json.dumps(e) + "\n" for e in events))
    os.utime(path, (1_767_225_600 + n * 60,) * 2)


def run(df, tmp_path, name, mode="append", ends=False):
    """`ends`: a stream whose state ends by running time."""
    with live.only_data(df.sparkSession) if ends else nullcontext():
        return table_of(df, tmp_path, name, mode)


def table_of(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


@pytest.fixture
def log(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.fileSource.log.cleanupDelay", "60000")
    folder = tmp_path / "log"
    folder.mkdir()
    at = lambda d, h, m=0: f"2026-01-0{d}T{h:02d}:{m:02d}:00Z"
    land(folder, 1, [
        {"kind": "policy_read", "ts": at(1, 1), "actor": "A", "ip": "1", "token": "t1", "standard": "robots", "ua": "a"},
        {"kind": "request", "ts": at(1, 2), "actor": "A", "ip": "2", "path": "/internal/x", "ua": "a"},
        {"kind": "trap_hit", "ts": at(1, 3), "actor": "A", "ip": "2", "token": "t1", "standard": "llms", "ua": "a"},
        {"kind": "request", "ts": at(1, 0), "actor": "B", "ip": "3", "path": "/internal/x", "ua": "b"},
        {"kind": "identity", "ts": at(1, 1), "ip": "1", "claimed": "GPTBot"},
        {"kind": "identity", "ts": at(1, 1, 5), "ip": "1", "claimed": "GPTBot"},
    ])
    land(folder, 2, [{"kind": "hunt", "ts": at(2, 1), "actor": "A", "family": "git"}, {"kind": "hunt", "ts": at(2, 2), "actor": "A", "family": "git", "decoy_served": True}, {"kind": "hunt", "ts": at(2, 3), "actor": "A", "family": "git"}])
    land(folder, 4, [{"kind": "credential", "ts": at(4, 1), "actor": "B", "user": "u"}])
    land(folder, 5, [{"kind": "request", "ts": at(8, 1), "actor": "C", "path": "/"}])
    return live.stream_log(spark, str(folder))


def test_days_close(log, tmp_path):
    rows = {(r.day.day, r.kind): r.events for r in run(live.daily_counts(log), tmp_path, "days")}
    assert rows[1, "request"] == 2 and rows[2, "hunt"] == 3 and rows[4, "credential"] == 1
    assert not any(day == 8 for day, _ in rows)  # still open


def test_rolling(log, tmp_path):
    rows = {r.until: r.events for r in run(live.rolling_digest(log, 2), tmp_path, "rolling")}
    assert rows[datetime(2026, 1, 3)] == 9 and rows[datetime(2026, 1, 4)] == 3


def test_claims_once(log, tmp_path):
    claims = log.where("kind = 'identity'").select("ts", "ip", "claimed")
    assert len(run(live.dedupe_claims(claims), tmp_path, "claims")) == 1


def test_stages_rise(log, tmp_path):
    rows = run(live.live_sessions(log), tmp_path, "stages", ends=True)
    by = lambda a: [r.stage for r in sorted(rows, key=lambda r: r.ts) if r.actor == a]
    assert by("A") == ["seen", "probed", "decoy_served"] and by("B") == ["seen", "payload"] and by("C") == ["seen"]


def test_read_then_fetch(log, tmp_path):
    (r,) = run(live.live_read_fetch(log, log), tmp_path, "fetches")
    assert (r.token, r.reader_ip, r.fetcher_ip) == ("t1", "1", "2")


def test_defied(log, tmp_path):
    s = log.where("ua is not null").selectExpr("ua AS client", "ts", "kind", "standard", "path", "coalesce(path like '/internal/%', false) AS forbidden")
    (r,) = run(live.live_defied(s), tmp_path, "defied", ends=True)
    assert (r.client, r.path) == ("a", "/internal/x")


def test_reads_that_come_late(spark, tmp_path):
    """A read counts for the fetches of its own micro-batch and later ones; equal times aren't after."""
    folder = tmp_path / "late"
    folder.mkdir()
    at = lambda m: f"2026-01-01T00:{m:02d}:00Z"
    fetch = lambda m, ua="a": {"kind": "request", "ts": at(m), "path": f"/internal/{m}", "ua": ua}
    read = lambda m, ua="a": {"kind": "policy_read", "ts": at(m), "standard": "robots", "ua": ua}
    stream = live.stream_log(spark, str(folder)).selectExpr("ua AS client", "ts", "kind", "standard", "path", "coalesce(path like '/internal/%', false) AS forbidden")
    want = [([fetch(1), fetch(9), fetch(3, "b")], []), ([fetch(8), fetch(5), read(5)], [8]), ([fetch(6), fetch(4)], [6]), ([read(3), read(50, "b"), fetch(4)], [4]), ([fetch(2)], []), ([fetch(7), read(0)], [7])]
    seen = []
    for n, (events, new) in enumerate(want, 1):
        land(folder, n, events)
        # Each run goes on from the state of the one before.
        with live.only_data(spark):
            live.live_defied(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        rows = spark.read.schema("client string, ts timestamp, path string").parquet(str(tmp_path / "out")).collect()
        assert all(r.client == "a" for r in rows)
        now = sorted(r.ts.minute for r in rows)
        assert now == sorted(seen + new), n
        seen = now


def test_silent_actors_leave_no_state(spark, tmp_path):
    folder = tmp_path / "silent"
    folder.mkdir()
    removed, kept = [], []
    for n in (1, 2):
        land(folder, n, [{"kind": "hunt", "ts": f"2026-01-0{n}T00:00:00Z", "actor": f"{'old' if n == 1 else 'new'}-{i}", "family": "git"} for i in range(20 if n == 1 else 3)])
        with live.only_data(spark):
            q = live.live_sessions(live.stream_log(spark, str(folder)), timedelta(seconds=3)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(60)
        operators = [p.stateOperators[0] for p in q.recentProgress if p.stateOperators]
        removed.append(sum(o.numRowsRemoved for o in operators))
        kept.append(operators[-1].numRowsTotal)
        time.sleep(4)
    assert removed == [0, 20] and kept == [20, 3]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 23


def test_silver_gives_each_row_once(spark, log, tmp_path):
    """A stream that dies between its data and its commit, and starts again."""
    silver, checkpoint = str(tmp_path / "silver"), str(tmp_path / "cp-silver")
    slim = log.select("kind", "ts", "actor", "path")

    def dies(batch, number):
        live.write_silver_batch(batch, number, silver)
        raise RuntimeError("lost")

    q = slim.writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(60)
    assert spark.read.parquet(silver).count() == 11
    live.to_silver(slim, silver, checkpoint).trigger(availableNow=True).start().awaitTermination(60)
    table = spark.read.parquet(silver)
    assert table.count() == 11 and table.select("batch").distinct().count() == 1
    pruned = table.where("kind = 'hunt' AND day = '2026-01-02'")
    assert pruned.count() == 3 and "PartitionFilters: [isnotnull(kind" in pruned._jdf.queryExecution().toString()
    live.write_silver_batch(spark.createDataFrame([(None, None, "Z", None)], "kind string, ts timestamp, actor string, path string"), 7, silver)
    assert spark.read.parquet(silver).where(F.col("actor") == "Z").first().kind == "unknown"
