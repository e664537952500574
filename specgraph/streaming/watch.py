"""Watching source trees: change events of files become batches of changed files for each repository. No event is ever dropped.

Batch: flushes(). Stream: watch(), state with a timer that every event resets. Both take events after a filter and a route to a repository.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from specgraph.sources.files import EXCLUDE, INCLUDE, language, wanted

#: Milliseconds of quiet before a flush: the default, and between what bounds.
DEBOUNCE, LEAST, MOST = 2000, 100, 60_000
#: A repository that fails so many times in a row is paused.
FAILURES = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING = "repo string, path string, first_seen timestamp, last_seen timestamp"


def clamped(ms: int | None) -> int:
    return min(MOST, max(LEAST, DEBOUNCE if ms is None else int(ms)))


def source(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """path, ts: a stream of the files that appear or change below root, as Spark's file source sees them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return raw.select("path", F.col("modificationTime").alias("ts"))


def filtered(events: DataFrame, path: str = "path", include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Events of files that a scan would take: by globs, ignore lines, generated names, and known languages."""
    c = F.regexp_replace(path, r"\\", "/")
    return events.where(wanted(c, include, exclude, ignored) & language(c).isNotNull())


def routed(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (path, …) with repo and the path within it, by the longest root (repo, root) that holds them; others are left out. Works for streams too:
    roots are few and joined on the prefixes of the path that end at a slash."""
    parts = F.expr("transform(sequence(1, size(split(path, '/'))), k -> substring_index(path, '/', k))")
    held = F.broadcast(roots.groupBy(F.regexp_replace("root", "/+$", "").alias("root")).agg(F.min("repo").alias("repo")).agg(F.map_from_entries(F.collect_list(F.struct("root", "repo"))).alias("__of")))  # one row: a map of the roots
    j = events.crossJoin(held)
    root = F.try_element_at(F.filter(parts, lambda p: F.map_contains_key("__of", p)), F.lit(-1))
    rel = F.expr("substring(path, length(__root) + 2)")
    out = j.withColumn("__root", root).where("__root is not null").withColumn("repo", F.col("__of")[F.col("__root")]).withColumn("path", rel)
    return out.drop("__root", "__of").where("path <> ''")


def flushes(events: DataFrame, ms: int | None = None) -> DataFrame:
    """flush, repo, path, first_seen, last_seen, n of events (repo, path, ts): one timer for all, reset by each event; when it runs out, all is flushed.

    Events are gathered into buckets as long as the pause first, so that only buckets (time over pause, not events) are put in order in one place.
    """
    gap = clamped(ms) * 1000
    e = events.select("repo", "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("bucket", F.floor(F.col("t") / gap))
    buckets = e.groupBy("bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    in_order = W.orderBy("bucket")
    new = F.when(F.col("lo") - F.lag("hi").over(in_order) < gap, 0).otherwise(1)
    numbered = buckets.withColumn("new", new).withColumn("flush", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))).select("bucket", "flush")
    g = e.join(numbered, "bucket").groupBy("flush", "repo", "path").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("n"))
    return g.select("flush", "repo", "path", F.timestamp_micros("a").alias("first_seen"), F.timestamp_micros("z").alias("last_seen"), "n")


class Pending(StatefulProcessor):
    """What has changed since the last flush, by repository and path; every event sets the one timer anew. Late events are events like any other."""

    def __init__(self, ms: int) -> None:
        self.ms = ms

    def init(self, handle) -> None:
        self.handle = handle
        text = StructType([StructField("repo", StringType()), StructField("path", StringType())])
        seen = StructType([StructField("first_seen", TimestampType()), StructField("last_seen", TimestampType())])
        self.files = handle.getMapState("files", text, seen)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        for pdf in rows:
            for repo, path, ts in pdf[["repo", "path", "ts"]].itertuples(index=False):
                held = self.files.getValue((repo, path)) if self.files.containsKey((repo, path)) else None
                first, last = (min(held[0], ts), max(held[1], ts)) if held else (ts, ts)
                self.files.updateValue((repo, path), (first, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ms)
        yield pd.DataFrame(columns=["repo", "path", "first_seen", "last_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        rows = [(*k, *v) for k, v in self.files.iterator()]
        self.files.clear()
        yield pd.DataFrame(rows, columns=["repo", "path", "first_seen", "last_seen"])

    def close(self) -> None:
        pass


def watch(events: DataFrame, sync: Callable[[str, list[str]], None], checkpoint: str, ms: int | None = None, status: Status | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream: events (repo, path, ts) are held until `ms` pass without any, then sync(repo, paths) runs for each repository that isn't paused.

    What arrives meanwhile waits for the next flush. A repository whose sync fails keeps its files for the next one.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    status = status or Status()
    pending = events.withColumn("all", F.lit("all")).groupBy("all").transformWithStateInPandas(Pending(clamped(ms)), PENDING, "Update", "ProcessingTime")

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.select("repo", "path").distinct().collect()  # files changed since the last flush
        todo = dict(status.kept)
        for r in rows:
            todo.setdefault(r["repo"], set())
            todo[r["repo"]] = todo[r["repo"]] | {r["path"]}
        for repo, paths in sorted(todo.items()):
            status.synced(repo, paths, sync)

    return pending.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


class Status:
    """How the repositories of a watch fare: files kept after a failure, failures in a row, paused ones, and why it runs in part or not at all."""

    def __init__(self) -> None:
        self.kept: dict[str, set[str]] = {}
        self.failures: dict[str, int] = {}
        self.paused: set[str] = set()
        self.partial: list[str] = []
        self.degraded: str | None = None

    def synced(self, repo: str, paths: set[str], sync: Callable[[str, list[str]], None]) -> bool:
        if repo in self.paused or self.degraded:
            self.kept[repo] = self.kept.get(repo, set()) | paths
            return False
        try:
            sync(repo, sorted(paths))
        except Exception as e:  # noqa: BLE001  any failure of an index run counts
            self.kept[repo] = self.kept.get(repo, set()) | paths
            self.failures[repo] = self.failures.get(repo, 0) + 1
            if self.failures[repo] >= FAILURES:
                self.paused.add(repo)
                self.partial.append(f"{repo} failed {FAILURES} times in a row and is paused: {e}")
            return False
        self.kept.pop(repo, None)
        self.failures[repo] = 0
        return True

    def trouble(self, error: OSError) -> None:
        """Too many open files end the watch; no room for further watches leaves it partial."""
        if error.errno == 24:
            self.degraded = str(error)
        elif error.errno == 28:
            self.partial.append(str(error))
        else:
            raise error

    @property
    def state(self) -> str:
        return "degraded" if self.degraded else "partial" if self.partial else "active"


def catch_up(mode: str, index: Callable[[], None], start: Callable[[Callable[[], None]], None]) -> str:
    """What happens to changes from before the watch began: 'blocking' indexes them first, 'background' by start, 'off' leaves them."""
    if mode == "blocking":
        index()
    elif mode == "background":
        start(index)
    elif mode != "off":
        raise ValueError(f"{mode} is no way to catch up: blocking, background or off")
    return mode


def may_watch(path: str, env: dict[str, str] | None = None, prefix: str = "SPECGRAPH_", wsl: bool | None = None) -> tuple[bool, str]:
    """Whether a repository may be watched, and why not: NO_WATCH=1 forbids it, FORCE_WATCH=1 allows it; drives of the host system are too slow."""
    env = os.environ if env is None else env
    if env.get(f"{prefix}NO_WATCH") == "1":
        return False, f"{prefix}NO_WATCH is set"
    if env.get(f"{prefix}FORCE_WATCH") == "1":
        return True, ""
    if wsl is None:
        wsl = bool(env.get("WSL_DISTRO_NAME"))
    drive = path.replace("\\", "/").lower().split("/")
    if wsl and len(drive) > 2 and drive[1] == "mnt" and len(drive[2]) == 1 and drive[2].isalpha():
        return False, f"{path} lies on a drive of the host system"
    return True, ""


def may_watch_any(paths: list[str], env: dict[str, str] | None = None, prefix: str = "SPECGRAPH_") -> tuple[bool, str]:
    ok, why = may_watch("", env, prefix, wsl=False)
    if not ok or (os.environ if env is None else env).get(f"{prefix}FORCE_WATCH") == "1":
        return ok, why
    return (True, "") if paths else (False, "no repositories")
