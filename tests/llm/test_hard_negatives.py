"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from trafficlens.llm.hard_negatives import LEAST, MOST, hard_negatives, op11_hard_negatives, threshold_search


def brute(rows, anchors, positives=5, k=10):
    out = []
    chosen = {}
    for i, label, v in anchors:
        chosen[i] = min(chosen.get(i, (v, label)), (v, label))
    for a, (av, al) in chosen.items():
        scored = [(-max(LEAST, min(MOST, sum(x * y for x, y in zip(av, v, strict=True)))), i, label) for i, label, v in rows if i != a and len(v) == len(av)]
        for rank, (ps, p, _) in enumerate(sorted(x for x in scored if x[2] == al)[:positives], 1):
            fit = sorted(x for x in scored if x[2] != al and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:k]
            out += [(a, p, r, n, -ps, -ns, rank) for r, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, v array<long>")


def check(spark, rows, of):
    df = frame(spark, rows).withColumns({"dim": F.lit("x"), "score": F.lit("y"), "block": F.lit(None).cast("string")})
    got = hard_negatives(df, df.where(of)).collect()
    sound = [(i, label, tuple(v)) for i, label, v in rows if None not in (i, label, v)]
    keep = {r.id for r in df.where(of).select("id").collect()}
    want = brute(sound, [r for r in sound if r[0] in keep])
    assert sorted(map(tuple, got)) == want
    return want


def test_search():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, d = int(rng.integers(1, 400)), int(rng.integers(1, 6))
        m = rng.integers(-9, 10, (n, d)).astype(float)
        ids, anchor = rng.permutation(n), rng.integers(-3, 4, d).astype(float)
        low, high = np.array([-5, 0, 10, LEAST]), np.array([5, 30, 12, MOST])
        found = threshold_search(ids, m, np.argsort(m, axis=0, kind="stable").T, anchor, 3, low, high, 4)
        scores = m @ anchor
        for a, b, (x, s) in zip(low, high, found, strict=True):
            want = sorted((-int(v), int(i)) for v, i in zip(scores, ids, strict=True) if i != 3 and a <= v <= b)[:4]
            assert [(-int(v), int(i)) for v, i in zip(s, x, strict=True)] == want


def test_reading_stops_early():
    """Where one dimension tells, most rows are never met."""
    rng = np.random.default_rng(1)
    m = np.column_stack([np.arange(4000) * 100.0, rng.integers(0, 5, 4000)])

    class Counted(np.ndarray):
        met = 0

        def __matmul__(self, other):
            Counted.met += len(self)
            return np.asarray(self) @ other

    found = threshold_search(np.arange(4000), m.view(Counted), np.argsort(m, axis=0, kind="stable").T, np.array([1.0, 1.0]), -1, np.array([LEAST]), np.array([MOST]), 5)
    assert found[0][0].tolist() == [3999, 3998, 3997, 3996, 3995] and Counted.met < 200


def test_operator(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in rng.integers(-200, 200, 6)]) for i in range(600)]
    rows += [(700 + i, 1, rows[3][2]) for i in range(30)]  # copies with one score
    rows += [(40, 2, rows[7][2]), (50, 1, rows[7][2]), (50, 1, rows[7][2])]  # ids that repeat
    rows += [(None, 1, [1] * 6), (801, None, [1] * 6), (802, 1, None), (810, 1, [5, 5]), (811, 1, [5, 4]), (812, 2, [5, 3]), (813, 3, [1, 1])]
    rows += [(820, 1, []), (821, 1, []), (822, 2, []), (830, 3, [0] * 6), (840, 0, rows[0][2])]
    want = check(spark, rows, "id % 10 = 0")
    assert {1, 5} <= {w[6] for w in want} and max(w[2] for w in want) == 10 and any(w[0] == 820 for w in want)
    few = frame(spark, rows).where("id in (1, 2)")
    assert hard_negatives(few.limit(0), few.limit(0)).collect() == [] and hard_negatives(few, few.where("id = 99")).collect() == []


def test_many_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr("trafficlens.llm.hard_negatives.BLOCK_ROWS", 40)
    monkeypatch.setattr("trafficlens.llm.hard_negatives.ANCHORS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in rng.integers(-9, 30, 4)]) for i in range(500)]
    check(spark, rows + [rows[11]] * 300, "id % 20 = 0")


def test_huge_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3)]) for i in range(40)]
    rows += [(100 + i, i % 2, [int(x) << 28 for x in rng.integers(-9, 9, 3)]) for i in range(40)]
    check(spark, rows, "id in (0, 1, 100, 101)")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(int(np.floor(256 * np.float64(x))) for x in r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op11_hard_negatives(spark, d).collect())) == brute(rows, [r for r in rows if r[0] % 100 == 0])
