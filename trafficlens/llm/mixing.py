"""Operator 9 [native]: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight.  A source whose target exceeds its size is taken
in complete epochs first; what then remains is filled in the order of the keys, prefix-summed to the token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, row_key, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Ranges of the keys of one source: a source is summed by range, and only the range where its budget ends is sorted.
RANGES = 4096
#: Rates of the exponentials whose mean distribution cuts the ranges: whatever weights prevail in a source, a range holds
#: at most some 10 / RANGES of it.
RATES = (0.1, 0.2, 0.4, 0.7, 1.0)
#: Copies of a source's row in the join, so that the rows of a hot source spread over as many tasks.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(n_words: Column, n_chars: Column) -> Column:
    """1 for ordinary prose, down to 0.1 where words are unusually long or short on average."""
    mean = n_chars / F.greatest(n_words, F.lit(1))
    return F.greatest(F.lit(0.1), 1.0 - F.abs(mean - 6.0) / 10.0)


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) of the id and text (ids may be null or repeat): 52 bits of an MD5."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.coalesce(text, F.lit("")))
    bits = F.conv(F.substring(F.md5(whole), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def range_of(key: Column) -> Column:
    """Which of RANGES ranges a key lies in, rising with the key."""
    past = sum((F.exp(key * -rate) for rate in RATES), F.lit(0.0)) / float(len(RATES))
    return F.floor((1 - past) * RANGES).cast("int")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with target.  Sources by code point, null last, weigh `weights`, repeating, and share
    `share` of all sizes; a target stops at `most` times its source's size, and the excess is reshared by weight.

    Resharing ends where target = min(cap, level * weight) for one level; it is found by filling the sources in the
    order of cap / weight.  One row per source goes through these windows, whatever the number of documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by_fill = W.orderBy("fill", "place")
    before, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("fill", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("done", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # The level if all sources before this one are full; the first one that it doesn't fill sets the true level.
    level = (F.col("total") - F.col("done")) / F.col("left")
    ranked = ranked.withColumn("level", F.min(F.when(level <= F.col("fill"), F.struct("fill", "place", level.alias("v")))).over(everything))
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("level.v") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 9, quality: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, weight, source, dk (key of the row's id and text).

    `quality`: (dk, weight) with a weight for each dk, such as a classifier's score (missing ones and those below 0.01
    count as 0.01); by default `quality_weight` of the text.

    `taken` counts the words that the mix takes of the document, whole epochs included; the one document at which a
    source's budget ends gives its leading words only, so that each source's words come to its target rounded down.
    Null or empty texts have size 0 and are never taken; a null source is a source.  Ties of the keys go to the smaller
    (doc_id, size); rows that repeat a doc_id and text are interchangeable, and lie in one range of keys.  Long texts are
    read whole.  Empty tables give an empty result; further columns are not read, whatever their names.
    """

    def weighed(rows: DataFrame) -> DataFrame:
        if quality is None:
            return rows.withColumn("weight", quality_weight(F.col("size"), F.col("chars")))
        best = quality.groupBy("dk").agg(F.max("weight").alias("weight"))
        return rows.join(best, "dk", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.01)), F.lit(0.01)))

    n = word_count(F.col("text"))
    rows = materialise(
        docs.select("doc_id", "source", n.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), row_key().alias("dk"))
        .transform(weighed)
        .withColumn("key", -F.ln("u") / F.col("weight"))
        .drop("u", "chars")
        .withColumn("range", range_of(F.col("key")))
    )
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    sizes = by_range.groupBy("source").agg(F.sum("n").alias("source_size"))
    plan = (
        targets(sizes, list(weights), share, most)
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    # The range in which a source's rest ends, and what its earlier ranges take.
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        by_range.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")))
        .groupBy("source")
        .agg(F.max(F.struct("range", "before")).alias("end"))
        .select(F.col("source").alias("e"), "end")
    )
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    plan = materialise(plan.withColumnRenamed("source", "s"))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("dk"), F.lit(SALTS)).cast("int"))
    copies = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = salted.join(copies, (salted["salt"] == copies["salt"]) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "salt")

    # Only the rows of the last range are sorted; all others are wholly in or out.
    last = F.col("range") == F.col("end.range")
    in_order = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = judged.where(last).withColumn("before", F.col("end.before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    clear = judged.where(~last | F.col("end").isNull()).withColumn("before", F.when(F.col("range") < F.col("end.range"), F.lit(0)).otherwise(F.col("rest")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    # A range before the last one is taken whole, so its documents count as starting at 0.
    part = F.when(F.col("range") < F.col("end.range"), F.col("size")).otherwise(part)
    both = edge.unionByName(clear)
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "weight", "source", "dk")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  coalesce(length(text), 0) AS chars,
  (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':9:' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.1::DOUBLE, 1.0::DOUBLE - abs(chars::DOUBLE / greatest(size, 1)::DOUBLE - 6.0::DOUBLE) / 10.0::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM r),
g AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lv FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lv, (fill, place)) FROM g WHERE lv <= fill) * w, cap)) AS target FROM g),
b AS (SELECT *, floor(target)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
m AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM m
"""
