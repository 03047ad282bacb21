"""A corpus through five of the operators: quality, lines, near copies, mixture, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import row_key, shared_dir, table
from trafficlens.llm.line_dedup import dedup_lines
from trafficlens.llm.mixing import mix
from trafficlens.llm.ngram_join import near_copies
from trafficlens.llm.packing import pack
from trafficlens.llm.quality import classify

#: Every decision is joined back by a key of the row's id and text: an id may be null, or repeat with other texts.  Rows
#: are carried whole, so that columns of any name pass.


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), k."""
    return docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("k"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts are judged as texts without words; equal texts are
    judged alike; an empty table stays empty."""
    texts = docs.select("doc_id", "text", row_key().alias("k"))
    rejected = classify(texts, table(spark, sf_dir, "labels"), carry=("k",)).where("predicted = 0").select("k").distinct()
    return keyed(docs).join(rejected, "k", "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them the documents of which no line is left.  Null texts and texts without lines stay
    as they are; n_chars, if there is one, is counted anew."""
    kept = dedup_lines(docs).where("n_kept > 0 or n_lines = 0")
    recount = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*recount)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, once.  Null texts and null ids belong to no group and stay."""
    found = near_copies(docs)
    left = keyed(docs).join(found.where("not kept").select(F.col("dk").alias("k")).distinct(), "k", "left_anti")
    grouped = found.where("kept and n_copies > 1").groupBy(F.col("dk").alias("k")).count()
    again = grouped.where("count > 1").select("k")
    return left.join(again, "k", "left_anti").unionByName(left.join(again, "k", "left_semi").dropDuplicates(["k"])).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole epochs, then the leading words of the one in which its source's
    budget ends.  Texts without words are never taken; rows that repeat an id and its text are taken alike.  This stage
    is of DataFrame functions alone, so the weights are those of the text's own figures, not the classifier's scores."""
    taken = mix(docs).where("taken > 0").groupBy(F.col("dk").alias("k")).agg(F.max("taken").alias("taken"), F.max("size").alias("words"))
    times = keyed(docs).join(taken, "k").withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("words")).cast("int"))))
    left, whole = F.col("taken") - F.col("copy") * F.col("words"), F.col("row.text")
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(left >= F.col("words"), whole).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    out = times.select("row", text.alias("t"))
    new = {"text": F.col("t"), "n_chars": F.length("t")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the whole mix, by its sources' own shares.  Null texts are documents of the end id alone."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: The stages learn, hash and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name.replace(' ', '_')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
