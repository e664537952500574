"""Change events: sessions that end after a quiet gap, and routing of paths to their roots; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """by, first_seen, last_seen, n, kinds: bursts of events of a key with every pause shorter than gap. For a stream give it a watermark first, which drops late events; streaming.watch never does."""
    w = F.session_window(ts, gap)
    return events.groupBy(*by, w).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n"), F.collect_set(kind).alias("kinds")).drop("session_window")


def route(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """page_id, root: the longest root that is a path's prefix, by equi-joins on the prefixes that end at a segment, at the path's end or at its first slash."""
    ends = F.expr("transform(sequence(1, size(split(path, '/'))), k -> substring_index(path, '/', k))")
    p = paths.withColumn("root", F.explode(F.array_distinct(F.concat(F.array(F.lit("/")), ends))))
    best = p.join(roots, "root").groupBy("page_id").agg(F.max(F.struct(F.length("root").alias("len"), "root")).alias("b"))
    return best.select("page_id", "b.root")
