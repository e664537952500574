"""How an index run changes a graph on storage: staged tables, batches in a journal, versions swapped by a manifest, state of each repository, job queues."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators.writing import hidden_batches, last_of_each, upsert


class Storage:
    """Small text files beside the tables, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The new text in whole or not at all: written aside, then renamed."""
        aside, path = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(self._path(self.root))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(path, False)
        if not self._fs.rename(aside, path):
            raise OSError(f"{path} couldn't be replaced")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Graph:
    """Tables under one root. A manifest names the folder of each table's current version: whoever reads sees all of a commit or nothing of it.

    Within transaction() puts are collected; the outermost one swaps the manifest when it ends, an error anywhere leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.storage, self._depth, self._pending, self._broken = spark, Storage(spark, root), 0, {}, False

    def _manifest(self) -> dict:
        return json.loads(self.storage.read("manifest.json") or '{"version": 0, "tables": {}}')

    def get(self, name: str) -> DataFrame | None:
        found = self._pending.get(name) or self._manifest()["tables"].get(name)
        return self.spark.read.parquet(f"{self.storage.root}/{found}") if found else None

    def put(self, name: str, df: DataFrame) -> None:
        """Stages a table's next version; outside a transaction it is committed at once."""
        folder = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.storage.root}/{folder}")
        self._pending[name] = folder
        if not self._depth:
            self._commit()

    def _commit(self) -> None:
        now = self._manifest()
        self.storage.write("manifest.json", json.dumps({"version": now["version"] + 1, "tables": now["tables"] | self._pending}))
        self._pending = {}

    @contextmanager
    def transaction(self) -> Iterator[Graph]:
        self._depth += 1
        try:
            yield self
        except BaseException:
            self._broken = True
            raise
        finally:
            self._depth -= 1
            if not self._depth:
                broken, self._broken = self._broken, False
                if broken:
                    for folder in self._pending.values():
                        self.storage.delete(folder)
                    self._pending = {}
                elif self._pending:
                    self._commit()


def stage(tables: dict[str, DataFrame], root: str, batch_id: str) -> None:
    """Every table of a batch under root/_staging/<batch>/<table>, with the batch's id on each row; nobody reads them before they are taken over."""
    for name, df in tables.items():
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/_staging/{batch_id}/{name}")


JOURNAL = "batch_id string, status string, at double, error string"


class Journal:
    """Batches and their states: started, then committed or failed; awaiting-cleanup where rows of a failed one may still lie about."""

    def __init__(self, graph: Graph, clock: Callable[[], float] = time.time) -> None:
        self.graph, self.clock = graph, clock

    def rows(self) -> DataFrame:
        found = self.graph.get("journal")
        return found if found is not None else self.graph.spark.createDataFrame([], JOURNAL)

    def _add(self, batch_id: str, status: str, error: str | None = None) -> None:
        row = self.graph.spark.createDataFrame([(batch_id, status, self.clock(), error)], JOURNAL)
        self.graph.put("journal", self.rows().unionByName(row).coalesce(1))  # one row a step

    def begin(self) -> str:
        batch_id = f"batch:{uuid.uuid4()}"
        self._add(batch_id, "started")
        return batch_id

    def commit(self, batch_id: str) -> None:
        self._add(batch_id, "committed")

    def fail(self, batch_id: str, error: str) -> None:
        self._add(batch_id, "awaiting-cleanup", error)

    def states(self) -> DataFrame:
        return last_of_each(self.rows(), ["batch_id"], "at")

    def visible(self, table: DataFrame) -> DataFrame:
        """The table without what incomplete batches wrote (switched off, not removed)."""
        return hidden_batches(table, self.rows())

    def recover(self) -> list[str]:
        """After a crash: batches that never ended wait for their clean-up."""
        open_ = [r["batch_id"] for r in self.states().where("status = 'started'").collect()]  # batches, not rows
        for b in open_:
            self._add(b, "awaiting-cleanup", "interrupted")
        return open_

    def cleanup(self, table: DataFrame) -> DataFrame:
        """The table without the rows of batches that wait for their clean-up."""
        return table.join(self.states().where("status = 'awaiting-cleanup'").select("batch_id"), "batch_id", "left_anti")

    def cleaned(self) -> None:
        for r in self.states().where("status = 'awaiting-cleanup'").collect():
            self._add(r["batch_id"], "failed")


def writer(mode: str = "auto", changed_only: bool = False, batched_full: bool = False, full_copy: bool = False, empty: bool = False, native: bool = True) -> tuple[str, bool, bool]:
    """Which writer a run takes, whether it is a fast one, and whether it may fall back to merging. native: the graph is this engine's own."""
    if not native:
        return "merge", False, False
    if batched_full:
        return ("bulk-copy" if empty else "append-copy"), True, False
    if full_copy:
        return "bulk-copy", True, False
    if mode == "auto" and not changed_only:
        return "append-copy", True, True
    if mode == "bulk-upsert" or (mode == "auto" and changed_only):
        return "bulk-upsert", True, mode != "bulk-upsert"
    return "merge", False, False


BACKENDS: dict[str, Callable[[SparkSession, str], Graph]] = {"parquet": Graph}


def open_graph(spark: SparkSession, root: str, provider: str = "parquet") -> Graph:
    if provider not in BACKENDS:
        raise ValueError(f"no backend named {provider}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[provider](spark, root)


def record_state(graph: Graph, states: DataFrame) -> None:
    """states (repo_id, commit, files, finished_at): one row of each repository, the newest."""
    held = graph.get("index_state")
    new = last_of_each(states, ["repo_id"], "finished_at")
    graph.put("index_state", upsert(held, new, ["repo_id"]) if held is not None else new)


class SemanticStore:
    """Embedded records of a graph: upserts by node; where the first store fails the second one serves, and the events say so."""

    def __init__(self, graph: Graph, fallback: Graph | None = None) -> None:
        self.graph, self.fallback, self.events = graph, fallback, []

    def _try(self, work: Callable[[Graph], object]):
        try:
            return work(self.graph)
        except Exception as e:
            if self.fallback is None:
                raise
            self.events.append(str(e).split("\n")[0])
            return work(self.fallback)

    def records(self) -> DataFrame | None:
        return self._try(lambda g: g.get("semantic"))

    def upsert(self, rows: DataFrame) -> None:
        def work(g: Graph) -> None:
            held = g.get("semantic")
            g.put("semantic", upsert(held, rows, ["node_id"]) if held is not None else rows)

        self._try(work)


class Queue:
    """Index jobs one at a time, in the order in which they came; counts, the running one, and whether it has run for too long."""

    def __init__(self, stuck_after: float = 300.0, clock: Callable[[], float] = time.time) -> None:
        self.stuck_after, self.clock = stuck_after, clock
        self._pool, self._lock = ThreadPoolExecutor(1), threading.Lock()
        self._pending: deque[dict] = deque()
        self._running: dict | None = None
        self.completed = self.failed = self._next = 0
        self.last_failed: dict | None = None

    def add(self, label: str, work: Callable[[], object], source: str = "manual") -> Future:
        with self._lock:
            self._next += 1
            job = {"id": f"index:{self._next}", "label": label, "source": source, "status": "pending"}
            self._pending.append(job)
        return self._pool.submit(self._run, job, work)

    def _run(self, job: dict, work: Callable[[], object]):
        with self._lock:
            self._pending.remove(job)
            job |= {"status": "running", "started": self.clock()}
            self._running = job
        try:
            out = work()
            self.completed += 1
            job["status"] = "succeeded"
            return out
        except BaseException as e:
            self.failed += 1
            job |= {"status": "failed", "error": str(e)}
            self.last_failed = job
            raise
        finally:
            self._running = None

    def status(self) -> dict:
        with self._lock:
            run = dict(self._running) if self._running else None
            if run:
                run["stuck"] = self.clock() - run["started"] > self.stuck_after
            return {"running": run, "pending": [dict(j) for j in self._pending], "completed": self.completed, "failed": self.failed, "last_failed": self.last_failed}


def run_all(jobs: list[Callable[[], object]], concurrency: int = 4, retries: int = 1, abort: bool = False) -> list[object]:
    """Results of jobs in their order, several at a time, each tried again after a failure; a job that fails for good gives its exception, or with abort
    ends the run: what hasn't begun then doesn't."""
    out: list[object] = [None] * len(jobs)
    stop = threading.Event()

    def work(n: int):
        for attempt in range(retries + 1):
            if stop.is_set():
                return n, RuntimeError("not run")
            try:
                return n, jobs[n]()
            except Exception as e:  # noqa: BLE001
                error = e
                if attempt == retries and abort:
                    stop.set()
        return n, error

    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        left = {pool.submit(work, n) for n in range(len(jobs))}
        while left:
            done, left = wait(left, return_when=FIRST_COMPLETED)
            for f in done:
                n, got = f.result()
                out[n] = got
    if abort and stop.is_set():
        raise next(x for x in out if isinstance(x, Exception) and str(x) != "not run")
    return out
