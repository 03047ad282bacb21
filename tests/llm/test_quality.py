import numpy as np

from trafficlens.llm.quality import FEATURES, best_level, classify, features, fit_pairs, op1_quality

SCHEMA = "doc_id long, text string, lang string, score double"
LABELS = "doc_id long, quality int, toxic int"


def test_weights_rank_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    y = (x @ [2.0, -1, 0, 0, 0] + 0.2 * rng.standard_normal(400) > 0).astype(int)
    s = x @ fit_pairs(x, y)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.98
    assert abs(best_level(s, y) - np.mean(y == 0)) < 0.05
    assert not fit_pairs(x, np.ones(400)).any()


def test_features_of_odd_texts():
    for t in (None, "", " ", "\n", "a", "é" * 10, "x " * 50_000, "\ud800"):
        f = features(t)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()


def test_classify(spark):
    good = ["The river runs past the old mill and into the sea.", "A quiet evening in the village, with bread and cheese."]
    bad = ["BUY!!! NOW!!! $$$ ### @@@", "ha ha ha ha ha ha ha ha ha"]
    rows = [(i, (good if i % 2 else bad)[i // 2 % 2] + f" {i}", "en", 0.0) for i in range(80)]
    docs = spark.createDataFrame([*rows, (200, None, None, 0.0), (201, "", None, 0.0), (None, "some text", None, 0.0), (7, rows[7][1], "en", 0.0)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(61, None, 1), (999, 1, 0), (None, 1, 0)], LABELS)
    got = classify(docs, labels).collect()
    assert len(got) == 84 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    held = op1_quality(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
