"""Multi-hop reach over edges: one join a hop, visited nodes left out, lineage cut by written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a folder of this machine serves local runs only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("specgraph.paths.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="specgraph-paths-")
        spark.conf.set("specgraph.paths.dir", found)
    return f"{found}/specgraph-paths"


def cut(df: DataFrame) -> DataFrame:
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, starts: DataFrame, max_hops: int, backward: bool = False) -> DataFrame:
    """node, hop: what starts (node) reach over edges (src, dst) in at most max_hops, with the least hop; starts at hop 0.

    Edges are made distinct and written once; each hop writes its own front only.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    edges = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    front = cut(starts.select("node").distinct().withColumn("hop", F.lit(0)))
    seen = front
    for hop in range(1, max_hops + 1):
        new = edges.join(front.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        front = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def truncated(edges: DataFrame, reached: DataFrame, max_hops: int, backward: bool = False) -> bool:
    """Whether some node of the last hop has a neighbour that wasn't reached."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    last = reached.where(F.col("hop") == max_hops).select("node")
    return not last.join(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "node").select(F.col("next").alias("node")).join(reached, "node", "left_anti").isEmpty()
