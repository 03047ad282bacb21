"""Verification of candidate lines: no more pairs than the components need, dealt by their number."""

import itertools
import random

from trafficlens.llm import line_dedup
from trafficlens.llm.common import materialise


def family(rng, copies):
    """Lines of which all pairs are alike."""
    line = [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(300)) for _ in range(60)]
    found = []
    for _ in range(copies):
        other = list(line)
        other[rng.randrange(60)] = "new" + str(rng.randrange(10_000))
        found.append(" ".join(other))
    return found


def test_family_is_no_square_of_verified_pairs(spark, monkeypatch):
    rng, counts, plain = random.Random(12), [], line_dedup.verified

    def counted(pairs, texts, threshold):
        counts.append(pairs.count())
        return plain(pairs, texts, threshold)

    monkeypatch.setattr(line_dedup, "verified", counted)
    families = [family(rng, 20) for _ in range(4)]
    table = [line for lines in families for line in lines]
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")
    kept = [r.doc_id for r in line_dedup.dedup_lines(docs).where("n_kept = 1").collect()]
    assert sorted(kept) == [0, 20, 40, 60]
    assert 0 < sum(counts) <= 2 * len(table)  # all pairs of a family: 190 each


def test_verified_pairs_are_dealt_first(spark):
    rng = random.Random(13)
    table = family(rng, 6) + family(rng, 5)
    sets = [{line[i : i + 5] for i in range(len(line) - 4)} for line in table]
    every = list(itertools.combinations(range(len(table)), 2))
    texts = materialise(spark.createDataFrame(list(enumerate(table)), "fp long, line string"))
    found = line_dedup.verified(materialise(spark.createDataFrame(every, "a long, b long")), line_dedup.with_sizes(texts), 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("array_intersect") < plan.index("REPARTITION_BY_NUM")
    want = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) < len(every)
