"""Operators on single rows, and the pipeline."""

import json

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm.mixing import RANGES, mix, range_of
from trafficlens.llm.tool_calls import SCHEMA, TOOLS, conversation_calls, link_calls, message_calls
from trafficlens.llm.topk import top_k, valid_vectors
from trafficlens.llm.url_filter import RULES, Rule, judge_urls


def test_urls(spark):
    cases = [
        ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://a.net/esx/1", "a.net", "/esx/1", None, "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x=/en/", "a.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://É.NET/fr/" + "a" * 50_000, "É.net", "/fr/" + "a" * 50_000, "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "r", "v") for i, c in enumerate(cases)] * 2, "page_id long, url string, rule string, token string")
    got = judge_urls(df, RULES).collect()
    assert len(got) == 2 * len(cases)
    assert all((r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:] for r in got)
    assert sorted(map(str, judge_urls(df, RULES, hot_pages=3).collect())) == sorted(map(str, got))  # the empty URL is hot
    assert judge_urls(df.limit(0), RULES).collect() == []
    wild = judge_urls(df, [Rule("block", "", "*"), Rule("allow", "com", "/*/x")]).where("page_id in (0, 1)").collect()
    assert {(r.page_id, r.verdict) for r in wild} == {(0, "allow"), (1, "block")}


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", None][min(3, int(rng.integers(0, 6)) // 2)], 0.0) for i in range(400)]
    rows += [(900, None, "a", 0.0), (901, "", "z", 0.0), (902, "big " * 5000, "b", 0.0), (5, rows[5][1], rows[5][2], 0.0), (None, "x y", "c", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key double")
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for s, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert 0 <= rs[0].target - sum(r.taken for r in rs) < 1, s
        whole = [r for r in rs if r.size and r.taken % r.size == 0]
        assert len(whole) >= len([r for r in rs if r.size]) - 1  # one document at most is cut
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    free = {s: rs[0].target for s, rs in by.items() if rs[0].target < 2 * rs[0].source_size - 1e-6}
    weight = dict(zip(sorted((s for s in by if s), key=str), (3, 1, 2, 3), strict=False)) | {None: 1}
    levels = [t / weight[s] for s, t in free.items()]
    assert max(levels) - min(levels) < 1e-6 * max(levels)
    assert mix(df.limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((700, 8)) * rng.uniform(0.1, 3, (700, 1))
    rows = [(i, [float(np.float32(x)) for x in v], "s") for i, v in enumerate(m)] + [(800 + i, [1.0] * 8, "s") for i in range(30)]
    bad = [(900, None, "s"), (1000, [float("inf")] * 8, "s"), (1100, [None] * 8, "s"), (None, [1.0] * 8, "s"), (1200, [0.0] * 8, "s")]
    v = valid_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string"), "vec_id", "embedding", 1024.0)
    import pyspark.sql.functions as F

    got = {}
    for r in top_k(v, v.where(F.col("id") % 100 == 0), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    data = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x, _ in rows} | {1200: np.zeros(8, int)}
    assert set(got) == {i for i in data if i % 100 == 0}
    for q, found in got.items():
        want = sorted(((-int(data[q] @ x), i) for i, x in data.items() if i != q))[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    # A query id that repeats: the least of its vectors is the query, the others are neither query nor candidate.
    twice = v.union(v.where("id = 100").select("id", F.transform("v", lambda e: e - 5).alias("v")))
    want = sorted(((-int((data[100] - 5) @ x), i) for i, x in data.items() if i != 100))[:10]
    got = [(r.rank, r.vec_id, -r.score) for r in top_k(twice, twice.where("id = 100"), 10).collect()]
    assert sorted(got) == [(k + 1, i, s) for k, (s, i) in enumerate(want)]
    few = v.where("id in (0, 1, 2)")
    assert top_k(few, few.where("id = 0"), 10).count() == 2 and top_k(v.limit(0), v.limit(0)).collect() == []


def test_top_k_odd_vectors(spark):
    """Vectors without components score 0 with each other; components of any size have exact products."""
    rows = [(100, []), (3, []), (1, []), (200, [1e300, 1.0]), (4, [1e17, 2.0]), (5, [-1e17, 2.0]), (300, [2.0**40, 3.0, 1.0]), (6, [2.0**41, 1.0, 1.0]), (7, [2.0**41, 1.0, 2.0])]
    v = valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024.0)
    got = sorted(tuple(r) for r in top_k(v, v.where("id % 100 = 0"), 10).collect())
    most = (1 << 63) - 1
    assert got == [(100, 1, 1, 0), (100, 2, 3, 0), (200, 1, 4, most), (200, 2, 5, -most), (300, 1, 6, most), (300, 2, 7, most)]


def test_tool_calls(spark):
    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    messages = [
        (1, 0, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", {"x": {"$ref": "a"}, "z": True}))),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        (2, 0, "assistant", call(("p", "add", {"x": {"$ref": "q"}, "y": 1}), ("q", "nope", {}), ("r", "add", {"x": {"$ref": "s"}}), ("s", "add", {"x": {"$ref": "r"}}))),
        (2, 1, "assistant", "plain text"), (2, 2, "user", None), (None, 0, "assistant", call(("n", "add", {}))), (1, 0, "assistant", call(("a", "add", {"y": 2, "x": 1}))),
    ]
    calls, results = message_calls(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"))
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", True)], SCHEMA)
    got = {r.call_id: r for r in link_calls(calls, results, schemas).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "no result", "lost": "no call", "p": "no result", "q": "no result", "r": "no result", "s": "no result"}
    assert got["a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}'
    assert got["a"].errors == "" and got["b"].errors == "missing y;type of x;unknown z" and got["q"].errors == "unknown tool"
    assert (got["q"].round, got["p"].round, got["r"].round, got["a"].round) == (0, 1, None, 0)
    assert link_calls(calls.limit(0), results.limit(0), schemas).collect() == []


def test_turns_follow_each_other(spark):
    """The calls of a conversation are ordered by what they follow, not only by their turns."""
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 7, "user", "alone"), (3, None, "user", "x")]
    calls, results = conversation_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    placed = lambda calls: {(r.conv_id, r.call_id): r.round for r in link_calls(calls, results, spark.createDataFrame(TOOLS, SCHEMA)).collect()}
    assert placed(calls) == {(1, "turn:0"): 0, (1, "turn:1"): 0, (1, "turn:3"): 0, (2, "turn:7"): 0}
    assert placed(calls.withColumn("position", -F.col("position"))) == {(1, "turn:0"): 0, (1, "turn:1"): 1, (1, "turn:3"): 2, (2, "turn:7"): 0}


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, d).toPandas(), docs.schema)
        assert kept.columns == columns and kept.count() > 0, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids < {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == ids
    total = sum(r.length for r in out)
    assert total // 2048 <= len({r.sequence_id for r in out}) <= total // 2048 + 11
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert sum(labels.get(i, 1) == 0 for i in ids) <= 0.02 * len(ids)


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids and texts, an id with two texts, repeated rows, columns of the stages' own names and none of n_chars."""
    good, bad = "A quiet evening in the village, with bread and cheese, and people who talk about the old mill by the river.", "BUY!!! NOW!!! $$$ ### @@@"
    rows = [(1, good, "a", 1, "p"), (1, bad, "a", 2, "p"), (None, bad + " BUY", "a", 3, "p"), (None, good + " Then they sleep.", None, 4, "p"), (2, None, "a", 5, "p"), (3, "", "b", 6, "p"), *[(4, "Every year the same things happen here, and nobody in the town minds them very much, or so they say.", "b", 7, "p")] * 2]
    rows += [(100 + i, f"{good if i % 2 else bad} {i * 7919 % 1000}", "c", 8, "p") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, predicted string")
    spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        out[name] = kept.collect()
    judged = {r.k for r in out["quality classifier"]}
    assert {1, 4, 7} <= judged and not {2, 3} & judged
    near = [r.k for r in out["n-gram Jaccard join"]]
    assert {1, 2, 3, 4, 5, 6, 7} <= set(near) and near.count(7) == 1
    assert all(r.text for r in out["mixing sources to target weights"])
    assert corpus_pipeline.packing(spark, docs.limit(0), "").collect() == [] and corpus_pipeline.packing(spark, docs, "").count() >= len(rows)


def test_ranges_rise_with_keys_and_stay_small(spark):
    for weight in (0.1, 0.15, 0.3, 0.55, 1.0):
        key = -F.ln((F.col("id") + 0.5) / 200_000) / weight
        rows = spark.range(200_000).select(key.alias("key"), range_of(key).alias("range"))
        held = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").collect()
        assert max(r.n for r in held) <= 200_000 * 12 / RANGES
        assert all(a.high <= b.low for a, b in zip(held, held[1:], strict=False))
