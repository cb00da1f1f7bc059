"""Shared-folder tables that cut lineage, and small helpers every operator uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast sieve, at most.
SIEVE = 1 << 20
#: Bytes of an Arrow batch between Spark and Python, unless the session says otherwise.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH bytes, or one row, in this session, unless it has a bound of its own.

    Spark's default of 64 MB is held several times over by each task, outside the heap and in its Python worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


class Workspace:
    """Written tables of one operator run, in a folder of their own under spark.checkpoint.dir.

    `cut` writes a frame as Parquet and reads it back: later stages then start from files
    that survive the loss of any executor. `drop` deletes tables that nothing reads any more;
    what the returned frame still reads has to stay until the caller has used it.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def sieved(self, df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
        """The rows of df whose hash in `column` may be one of wanted's, before they are shuffled into an exact join.

        Broadcasts the low bits of wanted's hashes: 40 bits of up to SIEVE rows, or 20 bits of any number, so
        SIEVE values at most. With far more than SIEVE rows it lets nearly everything pass.
        """
        low = f"`{column}` & {(1 << (40 if wanted.limit(SIEVE + 1).count() <= SIEVE else 20)) - 1}L"
        values = self.cut(wanted.select(F.expr(low).alias("low bits")).distinct(), f"sieve-{column}")
        return df.join(F.broadcast(values), F.expr(low) == F.col("low bits"), "left_semi")


def row_key() -> list[Column]:
    """Two columns that name a document row: its id, and a hash of id and text.

    Rows that agree on both are one document to every operator here.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("k1"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("k2"),
    ]


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): one row (node, comp) per endpoint, comp the smallest node.

    Alternates large-star and small-star steps. Each step regroups by node with a minimum, which
    Spark pre-aggregates, so a node with very many neighbours never gathers them in one task. Every
    round is written, and the loop ends when a round leaves the edges as they were.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, was, step = work.cut(cur, f"{name}-0"), None, 0
    while True:
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was or state[0] == 0:
            break
        was, step = state, step + 1
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a")
        small = kept.select("a", F.col("m").alias("b")).union(
            kept.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        )
        cur = work.cut(small.distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
