"""Shared folders, saved tables and connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets its own; a cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="faultweave-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: While this is on, a write's shuffle files go when the write is done, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Saved:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early.

    What a table was made from is not needed once it is written, so its shuffle files go at once.
    """

    #: Every table of this process that is not dropped yet, oldest first.
    live: list[tuple[Saved, DataFrame]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.frames = spark, shared_dir(spark), []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/saved-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_path = path
        self.frames.append(out)
        Saved.live.append((self, out))
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.frames = [f for f in self.frames if f is not df]
        Saved.live = [x for x in Saved.live if x[1] is not df]

    def drop_all(self) -> None:
        """Drops every table still there: for a caller that has saved what it made of them."""
        for df in list(self.frames):
            self.drop(df)

    @classmethod
    def drop_since(cls, count: int, but: DataFrame) -> None:
        """Drops all tables saved after the first ``count`` live ones but one: for a caller that has saved what an operator made of its own tables."""
        for saved, df in list(cls.live[count:]):
            if df is not but:
                saved.drop(df)


#: Rows of one or two numbers that are broadcast at most; a larger set is joined by shuffle.
MAX_BROADCAST = 2_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone(key)``, a saved table of distinct numbers: its size is counted, and only a small one is broadcast, so rows move only beyond that."""
    n = gone.count()
    return rows if not n else rows.join(F.broadcast(gone) if n <= MAX_BROADCAST else gone, key, "left_anti")


def components(edges: DataFrame, saved: Saved | None = None) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node long, component long)``, component the smallest node.

    Alternating large-star and small-star steps: each node's neighbours are linked with the smallest
    one, so a hub of any degree costs a sum over its edges and never sits in one task as a list.
    Isolated nodes do not appear. Null ends are ignored. Each round is written to the shared folder; the
    last one stays there, in ``saved`` if it is given.
    """
    saved = saved or Saved(edges.sparkSession)
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = saved.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = saved.save(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        then = saved.save(small.distinct())
        # finished when every node has one parent and no parent has a parent
        change = then.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        nested = then.select(F.col("b").alias("a")).distinct().join(then, "a", "left_semi").limit(1).count()
        saved.drop(now)
        saved.drop(large)
        now = then
        if (change or 0) <= 1 and not nested:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
