"""What the operators of this subpackage share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.session import shared_folder, ship

#: Rows handed to a Python worker at a time. Whole documents travel in a batch, so the number is small.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes handed to a Python worker at a time.
BYTES_PER_BATCH = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package, bound the size of Arrow batches, and drop the shuffle files of each execution when it ends."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written as Parquet in the shared folder and read again: cut() for larger tables.

    Arrays of longs are hashes here, so no dictionary is tried for them."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hashes = [f.name for f in df.schema if f.dataType.simpleString() == "array<bigint>"]
    df.write.options(**{f"parquet.enable.dictionary#{name}.list.element": "false" for name in hashes}).parquet(path)
    found = spark.read.parquet(path)
    found._kept_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that kept() has written, once what was made of them has been written or cut."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        folder.getFileSystem(conf).delete(folder, True)


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star on edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    pairs = large.join(low, "hi")
    small = pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: one row (node, component) for each node of an edge.

    component is the smallest node that can be reached. Alternating large-star and small-star rounds (each an aggregate
    and a join on the edges, nothing on the driver but a count and a checksum) run until nothing changes; each round
    ends in a reliable checkpoint. An empty table of edges gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    if seen[0] == 0:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(most_rounds):
        now = cut(_stars(now))
        got = now.agg(F.count("*"), mark).first()
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
