"""Connected components and cut lineage, for operators on links."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors see. Without one, only a local session can do without: it gets its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes it with the DataFrame, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b); component is the smallest id that can be reached.

    Each round takes the smallest label of the neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path. Only counts reach the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where("a <> b").distinct())
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("c")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        step = label.join(near, "a").select("a", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        of = label.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        step = saved(step.join(of, "c").select("a", "was", F.least("c", "cc").alias("c")))
        moved = step.where("c <> was").limit(1).count()
        label = step.select("a", "c")
        if not moved:
            return label.select(F.col("a").alias("id"), F.col("c").alias("component"))
