"""What operators share: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  Only a local session without one, such as a
    test's, gets a new temporary folder; on a cluster it would be no one else's."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: cuts the lineage, outlives executors, and gives
    the optimizer the true size for its choice of joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a written table, by its rows and texts, up to which it is sent to all executors.
SENT_BYTES = 64 << 20


def small(table: DataFrame, *texts: str) -> bool:
    """Whether a written table may be sent to all executors, by its rows (100 bytes each) and these texts."""
    size = F.lit(100)
    for text in texts:
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= SENT_BYTES


def sized(table: DataFrame, *texts: str) -> DataFrame:
    """A written table as one side of a join: sent to all executors if its rows and these texts are few enough, else joined
    by sorting.  Spark's own threshold goes by the size of the files, in which texts that are much alike take next to
    nothing: what it sends may be a hundred times as large."""
    return F.broadcast(table) if small(table, *texts) else table.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (a, b) links of any direction -> (node, root), root being the smallest node of its
    component.  Each round offers the smallest label around a node to the node and to its root, then halves the paths,
    so the rounds grow with the logarithm of the longest chain.  Hot nodes are safe: minima combine before a shuffle."""
    edges = edges.where("a <> b")
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        around = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        around = materialise(around.join(label, "node"))
        offers = around.select("node", "offer").union(around.select("root", "offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = label.join(best, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        new = materialise(hooked.join(up, "mid").select("node", "old", F.least("mid", "up").alias("root")))
        label = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return label
