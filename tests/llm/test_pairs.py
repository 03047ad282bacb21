"""Operators on pairs against brute force."""

import itertools
import random

import numpy as np

from trafficlens.llm.common import materialise
from trafficlens.llm.embed_dedup import calibrated_count, near_duplicates
from trafficlens.llm.line_dedup import BANDS, LEADERS, ORDERS, SHINGLE, both_sides, dedup_lines, equal_values, led, lines, may_be_alike, packed, signatures, with_bitmaps
from trafficlens.llm.ngram_join import SCHEME, near_copies

DOCS = "doc_id long, text string, kept string, class_id int, fp string, family string"


def docs(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)


def roots(nodes, links):
    root = {n: n for n in nodes}
    while True:
        new = dict(root)
        for a, b in links:
            low = min(root[a], root[b])
            new[a], new[b] = min(new[a], low), min(new[b], low)
        if new == root:
            return root
        root = new


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(300)) for _ in range(n)]


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark):
    rng, rows = random.Random(1), []
    for g in range(12):
        base = words(rng, 60 + 20 * g)
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = "new"
            rows.append(" ".join(w))
    rows += [None, None, "", "", "one two three", "ONE  two\nthree", "one two four", rows[0].upper(), "long " + "w x y z v u " * 30_000]
    base = words(rng, 80)
    rows += [" ".join([*base[:40], f"v{i}", *base[41:]]) for i in range(600)]  # one family larger than a block
    table = list(enumerate(rows))
    rng.shuffle(table)
    table.append((3, rows[3]))
    got = {r.doc_id: r for r in near_copies(docs(spark, table)).collect()}
    assert set(got) == set(range(len(rows)))
    norm = {i: None if t is None else " ".join(t.lower().split()) for i, t in enumerate(rows)}
    first = {}
    for i, t in norm.items():
        first.setdefault(t if t is not None else (i,), i)
    reps = [i for t, i in first.items() if not isinstance(t, tuple)]
    sets = {i: five(rows[i]) for i in reps}
    links = [(a, b) for a, b in itertools.combinations(reps, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(reps, links)
    degree = dict.fromkeys(reps, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for i, t in norm.items():
        rep = first[t if t is not None else (i,)]
        assert got[i].class_id == (root[rep] if t is not None else i)
        assert got[i].n_links == (degree[rep] if t is not None else 0)
        assert got[i].kept == (got[i].class_id == i)
    assert near_copies(docs(spark, [])).collect() == []
    assert near_copies(docs(spark, [(None, "a b"), (1, "a b")])).where("kept").count() == 2


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(5)
    least = SCHEME.fewest_matches()
    matches = np.cumsum(rng.random((20_000, 125)) < 0.8, axis=1)
    assert np.mean(np.all([matches[:, n - 1] >= m for n, m in least.items()], axis=0)) > 0.998
    matches = np.cumsum(rng.random((20_000, 125)) < 0.4, axis=1)
    assert np.mean(matches[:, 74] >= least[75]) < 0.01 < np.mean(matches[:, 24] >= least[25]) < 0.5


def shingles(line):
    """Five characters from every place."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def test_line_dedup(spark):
    rng, rows = random.Random(2), []
    lines = [" ".join(words(rng, 30)) for _ in range(40)]
    near = [ln.replace(ln.split()[7], "CHANGED", 1) for ln in lines[:20]]
    pool = lines + near + ["Short line.", "Short line.", "", "  ", "日本語の行です。とても長い行なのでシングルが多い。"]
    for i in range(60):
        rows.append((i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))))
    rows += [(100, None), (101, "unique words only here"), (102, lines[0].upper() + "  "), (103, "\n\n"), (104, "x" * 100_000)]
    shuffled = rows + [rows[5]]
    rng.shuffle(shuffled)
    got = {r.doc_id: r for r in dedup_lines(docs(spark, shuffled)).collect()}
    every = sorted({ln.strip(" ").lower() for _, t in rows if t for ln in t.split("\n")} - {""})
    sets = {ln: shingles(ln) for ln in every}
    root = roots(every, [(a, b) for a, b in itertools.combinations(every, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]])
    seen = set()
    for i, t in sorted(rows):
        if t is None:
            assert got[i].text is None
            continue
        kept = []
        for ln in t.split("\n"):
            key = ln.strip(" ").lower()
            if not key or root[key] not in seen:
                kept.append(ln)
            if key:
                seen.add(root[key])
        assert got[i].text == "\n".join(kept), i
    assert got[0].fp == "y" and dedup_lines(docs(spark, [])).collect() == []


def test_crowded_lines(spark):
    """Lines of one frame, which share buckets of far more than SMALL lines, hold chains of near copies."""
    rng, table = random.Random(7), []
    frame = words(rng, 24)
    for family in range(80):
        own = words(rng, 16)
        for k in range(4 if family % 2 else 1):
            own[3 * k] = words(rng, 1)[0]
            table.append((family, " ".join(frame + own)))
    rng.shuffle(table)
    got = dedup_lines(docs(spark, [(i, t) for i, (_, t) in enumerate(table)])).where("n_kept = 1").collect()
    first = {}
    for i, (family, _) in enumerate(table):
        first.setdefault(family, i)
    assert sorted(r.doc_id for r in got) == sorted(first.values())


def test_line_shingles_at_every_place(spark):
    """Short lines with one typo and runs of letters without a space, against all shingles of five characters."""
    rng, table = random.Random(8), []
    for _ in range(60):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rng.randrange(50, 90))).strip(" ")
        at = rng.randrange(8, len(line) - 8)
        table += [line, line[:at] + "#" + line[at + 1 :]]
    for start in ("acgtacgtacgtacgt", "qwertyuiopasdfgh", "日本語の行ですとても長い"):
        table += [start + "".join(rng.choice("acgtnmrw") for _ in range(120)) for _ in range(4)]
    every = sorted(set(table))
    sets = {ln: {ln[i : i + 5] for i in range(max(1, len(ln) - 4))} for ln in every}
    root = roots(every, [(a, b) for a, b in itertools.combinations(every, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    rng.shuffle(table)
    first = {}
    for i, ln in enumerate(table):
        first.setdefault(root[ln], i)
    got = dedup_lines(docs(spark, list(enumerate(table)))).where("n_kept = 1").collect()
    assert sorted(r.doc_id for r in got) == sorted(first.values()) and 12 < len(first) < len(table) - 40


def test_line_recall_in_templates(spark):
    """600 lines of one 40-word template: each pair has six words of its own, and its two lines differ in one more."""
    rng, table = random.Random(9), []
    frame = words(rng, 40)
    for _ in range(300):
        own = list(frame)
        for at in rng.sample(range(40), 6):
            own[at] = words(rng, 1)[0]
        other = list(own)
        other[rng.randrange(40)] = words(rng, 1)[0]
        table += [" ".join(own), " ".join(other)]
    sets = [shingles(ln) for ln in table]
    links = [(a, b) for a, b in itertools.combinations(range(600), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(range(600), links)
    got = {r.doc_id for r in dedup_lines(docs(spark, list(enumerate(table)))).where("n_kept = 1").collect()}
    want = {r for r in root.values()}
    assert want <= got and len(got) - len(want) <= 0.01 * (600 - len(want)) and len(links) >= 300


def test_line_prefilters(spark):
    """Packed signatures count equal values as the plain ones do; bitmaps refute many pairs, but none at the threshold."""
    rng, table = random.Random(10), []
    for _ in range(20):
        line = words(rng, rng.randrange(3, 60))
        for k in range(5):
            table.append(" ".join(line))
            line[rng.randrange(len(line))] = words(rng, 1)[0]
    table = docs(spark, list(enumerate(table)))
    signed = materialise(signatures(table))
    values = {r.fp: [r[f"s{k}"] for k in range(ORDERS)] for r in signed.collect()}
    texts = materialise(lines(table).select("fp", "line").dropDuplicates(["fp"]))
    sets = {r.fp: shingles(r.line) for r in texts.collect()}
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(sets), 2)), "a long, b long")
    for r in both_sides(pairs, packed(signed)).select("a", "b", equal_values().alias("n")).collect():
        assert r.n == sum((x - y) % 2048 == 0 for x, y in zip(values[r.a], values[r.b], strict=True))
    jaccard = lambda r: len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])
    judged = both_sides(pairs, materialise(with_bitmaps(texts)).drop("line")).select("a", "b", may_be_alike(0.8).alias("may")).collect()
    assert all(r.may for r in judged if jaccard(r) >= 0.8) and any(jaccard(r) >= 0.8 for r in judged)
    assert sum(r.may for r in judged) < 0.1 * len(judged)


def generated(plan):
    """Rows that the explosions of an executed plan have made."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(map(generated, below)) + (plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0)


def test_line_leaders_once(spark):
    """A family in all buckets of the same lines meets its leaders once, not once a bucket."""
    members = materialise(spark.createDataFrame([(fp, 1000 + band) for fp in range(100) for band in range(BANDS)], "fp long, bucket long"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = led(members)
        found = [(r.a, r.b) for r in pairs.collect()]
        made = generated(pairs._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    leaders = [x for x in range(100) if sum(x in p for p in found) == 99]
    assert 1 <= len(leaders) <= LEADERS and len(found) == len(set(found))
    assert set(found) == {(min(x, y), max(x, y)) for x in leaders for y in range(100) if x != y}
    assert made == 100 * len(leaders)


def test_line_columns(spark):
    """Columns named like the operator's own, and none but those it needs."""
    rows = [(1, "a line of text\nanother line", 5, 6, [1], 7), (2, "a line of text", 5, 6, [1], 8), (None, "a line of text", 5, 6, [1], 9)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int, n_kept int, drop array<int>, dk long")
    got = sorted(dedup_lines(clash).collect(), key=lambda r: r.dk)
    assert [(r.n_lines, r.n_kept, r.drop) for r in got] == [(2, 1, [1]), (1, 0, [1]), (1, 1, [1])]
    assert dedup_lines(clash.select("doc_id", "text")).columns == ["doc_id", "text", "n_lines", "n_kept"]


VECTORS = "vec_id long, embedding array<float>, label int, component_id string, x string"


def test_embeddings(spark):
    rng, rows = np.random.default_rng(4), []
    for g in range(60):
        base = rng.standard_normal(64)
        for k in range(4):
            rows.append((base + rng.standard_normal(64) * rng.uniform(0, 0.2), int(g % 3)))
    rows += [(rows[0][0], 0)] * 3 + [(rows[0][0] * 2, 0), (rows[0][0], 1), (rows[0][0], None)]
    data = [(i, [float(np.float32(c)) for c in v], lab, "c", "x") for i, (v, lab) in enumerate(rows)]
    n = len(data)
    bad = [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None, *[1.0] * 63], 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame([*data, *((*b, "c", "x") for b in bad)], VECTORS)).collect()}
    m = np.array([d[1] for d in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = [d[2] for d in data]
    links = [(a, b) for a, b in itertools.combinations(range(n), 2) if label[a] is not None and label[a] == label[b] and m[a] @ m[b] >= 0.98]
    root = roots(range(n), links)
    for i in range(n):
        assert got[i].n_links == sum(i in x for x in links), i
        assert (got[i].component_id, got[i].kept) == (root[i], root[i] == i)
    assert all(got[b[0]].n_links == 0 and got[b[0]].kept for b in bad)
    assert near_duplicates(spark.createDataFrame([], VECTORS)).collect() == [] and calibrated_count() > 10


def test_embeddings_that_repeat_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(5, a, "1", "x"), (6, near(a), "1", "x"), (5, b, "2", "x"), (7, near(b), "2", "x"), (9, [0.0, 1.0, 0.0, 0.0], "1", "x"), (9, [0.0, -1.0, 0.0, 0.0], "1", "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links string")
    got = sorted(tuple(r) for r in near_duplicates(vectors).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (9, 0, 9, True), (9, 0, 9, True)]
