"""Signatures of lines: made of each row alone, few bands, and no pair at the threshold lost at any length."""

import random

from pyspark.sql import functions as F

from trafficlens.llm.line_dedup import BANDS, occurrences


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_rings(spark):
    rng, rows = random.Random(11), []
    letters = "abcdefghijklmnopqrstuvwxyz日本語行"
    for length in (9, 14, 25, 60, 300, 1500):
        for _ in range(40):
            line = other = "".join(rng.choice(letters) for _ in range(length))
            # As many typos as leave the pair at the threshold; a short line loses a letter at its end.
            for _ in range(min(length, 60)):
                at = rng.randrange(length)
                typo = other[:at] + "#" + other[at + 1 :]
                other = typo if jaccard(line, typo) >= 0.8 else other
            rows.append((len(rows), f"{line}\n{other if other != line else line[:-1]}"))
    assert all(jaccard(*text.split("\n")) >= 0.8 for _, text in rows)
    found = occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    each = found.select("doc_id", "no", "m", "bands").collect()
    size = {(i, no): len(shingles(line)) for i, text in rows for no, line in enumerate(text.split("\n"))}
    assert all(r.m == size[r.doc_id, r.no] and len(r.bands) == BANDS <= 17 for r in each)
    bands = found.groupBy("doc_id").agg(F.max(F.when(F.col("no") == 0, F.col("bands"))).alias("x"), F.max(F.when(F.col("no") == 1, F.col("bands"))).alias("y"))
    assert bands.where(F.arrays_overlap("x", "y")).count() >= 0.98 * len(rows)
