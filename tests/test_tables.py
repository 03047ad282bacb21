"""Rules, blocks and claims as tables, against brute force."""

import ipaddress
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import identity, robots
from trafficlens.sources import log as source


def verdict(ua, path, rules):
    """(ua, path) by regular expressions over all rules."""
    agents = {a for _, a, _, _ in rules}
    named = {a for a in agents if a != "*" and re.search(rf"(?i)(?<![A-Za-z0-9_-]){re.escape(a)}(?![A-Za-z0-9_-])", ua)}
    own = [(d, p) for _, a, d, p in rules if p and (a in named if named else a == "*")]
    fits = [(len(p), d == "allow") for d, p in own if re.match("".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + ("$" if p.endswith("$") else ""), path)]
    return bool(fits) and not max(fits)[1] and path != "/robots.txt"


def test_prefix_index(spark):
    rng = random.Random(3)
    agents = ["*", "GPTBot", "my bot", "x-bot", "Foo/2", "++", "Ünicode"]
    piece = lambda: "".join(rng.choice(["/", "a", "b", "ab", "*", ".", "/a", "é", "[", "\\"]) for _ in range(rng.randrange(0, 6)))
    rules = sorted({(agents.index(a), a, rng.choice(("allow", "disallow")), "/" * (p != "") + p + rng.choice(("", "", "$"))) for a in agents for p in [piece() for _ in range(60)]})
    rules += [(1, "GPTBot", "disallow", ""), (1, "GPTBot", "disallow", "/"), (0, "*", "disallow", "/robots.txt"), (2, "my bot", "allow", "/ab*b$"), (2, "my bot", "disallow", "/*$")]
    uas = ["Mozilla (GPTBot/1.2)", "gptbot", "NotGPTBot", "a my bot b", "my-bot", "x-bot, GPTBOT", "Foo/2 x", "Foo/23", "c++ d", "ünicode", "", "plain"]
    paths = sorted({"/" + piece().replace("*", "") + rng.choice(("", "b", "ab")) for _ in range(150)} | {"/robots.txt", "", "/abb", "/ab", "/a" * 400})
    pairs = spark.createDataFrame([(u, p, 1) for u in uas for p in paths] * 2 + [(None, "/", 1), ("x", None, 1)], "ua string, path string, group_id int")
    table = spark.createDataFrame([("f", g, a, d, p) for g, a, d, p in rules], robots.RULES)
    got = {(r.ua, r.path): r.disallowed for r in robots.disallowed(pairs, table).collect()}
    assert len(got) == len(uas) * len(paths)
    assert {k: verdict(*k, rules) for k in got} == got and 0.1 < sum(got.values()) / len(got) < 0.9
    assert robots.disallowed(pairs.limit(0), table).collect() == []
    assert not any(r.disallowed for r in robots.disallowed(pairs, table.limit(0)).collect())


def test_no_product_of_paths_and_rules(spark):
    """The plan joins paths and rules by equal keys only."""
    rules = spark.range(20_000).select(F.lit("f").alias("file_id"), (F.col("id") % 7).cast("int").alias("group_id"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string")).alias("agent"), F.lit("disallow").alias("directive"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("*x")).alias("pattern"))
    pairs = spark.range(20_000).select(F.concat(F.lit("b"), (F.col("id") % 9).cast("string")).alias("ua"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("-x")).alias("path"))
    answer = robots.disallowed(pairs, rules)
    plan = answer._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    joins = [line for line in plan.splitlines() if "NestedLoop" in line or "Cartesian" in line]
    assert all("sign" in line or "Cross" in line for line in joins)  # names without a word; the groups of `*`
    assert answer.groupBy("disallowed").count().collect() and answer.count() == 20_000


def test_range_buckets(spark):
    rng = random.Random(4)
    blocks = {"a": [], "b": [], "c": ["0.0.0.0/0", "::/0"], "d": ["10.0.0.0/8"]}
    for op in "ab":
        for _ in range(400):
            blocks[op].append(f"{ipaddress.ip_network((rng.getrandbits(12) << 20 | rng.getrandbits(4), rng.randrange(4, 33)), strict=False)}")
            blocks[op].append(f"{ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(6) << 88 | rng.getrandbits(4) << 60 | rng.getrandbits(5), rng.choice((33, 40, 48, 63, 64, 65, 100, 127, 128))), strict=False)}")
    blocks["a"] += ["bad", "10.0.0.0/99"]
    ips = [str(ipaddress.ip_address(rng.getrandbits(12) << 20 | rng.getrandbits(4))) for _ in range(150)] + [str(ipaddress.ip_address(0x20010DB8 << 96 | rng.getrandbits(6) << 88 | rng.getrandbits(4) << 60 | rng.getrandbits(5))) for _ in range(150)]
    ips += ["255.255.255.255", "0.0.0.0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::", "::ffff:10.0.0.1", "nonsense", ""]
    ranges = source.ranges_of(spark.createDataFrame(list(blocks.items()), "operator string, cidrs array<string>"))
    claims = spark.createDataFrame([(ip, op, "x") for ip in ips for op in "abcde"] + [(None, "a", "x"), (ips[0], None, "x")] * 2, "ip string, operator string, size string")
    got = {(r.ip, r.operator): r.cidr for r in identity.match_range(claims, ranges).collect()}
    want = {}
    for op, cidrs in blocks.items():
        nets = [ipaddress.ip_network(c) for c in cidrs if c not in ("bad", "10.0.0.0/99")]
        for ip in ips[:-2]:
            address = ipaddress.ip_address(ip)
            if found := next((n for n in nets if n.version == address.version and address in n), None):
                want[ip, op] = str(found)
    assert got == want and len(want) > 200
    assert identity.match_range(claims.limit(0), ranges).collect() == [] == identity.match_range(claims, ranges.limit(0)).collect()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def spaced(times, ttl):
    kept = []
    for t in sorted(set(times)):
        if not kept or (t - kept[-1]).total_seconds() >= ttl:
            kept.append(t)
    return kept


def test_sorted_fold(spark, small_batches):
    """Keys that go over many batches, equal times, null keys and times; a key with most of the rows."""
    rng = random.Random(6)
    base = datetime(2024, 1, 1)
    keys = [("hot", "c"), ("a", "c"), ("a", "d"), (None, "c"), ("a", None), ("\0", "c"), ("one", "c")]
    rows = [(*keys[min(rng.randrange(9), 5) if rng.random() < 0.4 else 0], base + timedelta(seconds=rng.randrange(20_000), microseconds=rng.choice((0, 0, 1, 999_999)))) for _ in range(3000)]
    rows += [("one", "c", base), ("one", "c", base + timedelta(seconds=600)), ("one", "c", base + timedelta(seconds=599, microseconds=999_999)), ("none", "c", None)]
    claims = spark.createDataFrame([(*r, 1) for r in rows], "ip string, claim string, ts timestamp, times int").repartition(5)
    got = sorted(map(tuple, identity.dedupe_claims(claims, 600).collect()), key=str)
    want = [(i, c, t) for i, c in {r[:2] for r in rows if r[2]} for t in spaced([r[2] for r in rows if r[:2] == (i, c)], 600)]
    assert got == sorted(want, key=str)
    every = identity.dedupe_claims(claims, 0).count()
    assert every == len({r for r in rows if r[2]}) and identity.dedupe_claims(claims.limit(0), 600).collect() == []


def test_fold_of_one_hot_key_keeps_no_rows(spark):
    """Two million claims of one key: the fold's Python holds a batch, not the key."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def batches():
        for i in range(200):
            times = pa.array((np.arange(10_000) + i * 10_000) * 1_000_000, pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays([pa.array(["x"] * 10_000), pa.array(["y"] * 10_000), times], names=["ip", "claim", "ts"])

    tracemalloc.start()
    n = sum(b.num_rows for b in identity._keep_spaced(3600 * 1_000_000)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == -(-2_000_000 // 3600) and peak < 5_000_000
