"""What several operators share: shared storage, byte views of text columns, hashing, id filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: The characters that end a word: \x20 and \x09-\x0D. bytes.split() without arguments uses the same ones.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a folder of this machine serves local runs only, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("specgraph.local.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="specgraph-")
        spark.conf.set("specgraph.local.dir", found)
    return found


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, compressed by codec or as the session says: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/specgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # Small row groups, and pages whose size is looked at often: a task that writes large values buffers one of each, and one that reads them takes a page whole.
    df.write.option("parquet.block.size", 32 << 20).option("parquet.page.size.row.check.min", 8).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a Python worker is given at once. Spark's own bound is 64 MB, of which a worker holds two or three copies and the JVM one more.
BATCH = 2 << 20


def _trim() -> None:
    """Gives back what the allocators of this process hold without using it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def lean(run):
    """run (batches to batches), for workers that live on between tasks: returns freed memory to the system after each batch and at the end."""

    def go(batches):
        for out in run(batches):
            yield out
            _trim()
        _trim()

    return go


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, for mapInArrow over its texts: lowers the session's bound on an Arrow batch to BATCH bytes; a single longer row still goes through whole."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name).rstrip("b")) <= BATCH:
        conf.set(name, str(BATCH))
    return docs


def words(col) -> F.Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and each row's offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Runs of whole rows of about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Rolling:
    """Hashes of any substrings of a byte array by differences of prefix sums, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def load(self, data: np.ndarray, table: np.ndarray | None = None) -> None:
        self.grow(len(data) + 1)
        x = (self.TABLE if table is None else table)[data]
        x *= self.powers[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of `size` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


class IdFilter:
    """A Bloom filter of fixed size over integer ids: what it rejects is certainly absent, what it lets through is joined as usual.

    It only saves shuffling; its size (BITS / 8 bytes, 2 MB) doesn't depend on the data.
    """

    BITS = 1 << 24

    def __init__(self, ids: DataFrame) -> None:
        """ids: one long column named id."""
        spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(self.BITS)) for k in (1, 2)])).alias("bit"))
        rows = spots.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
        table = np.zeros(self.BITS // 64, np.int64)
        table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def spots(self, column: str) -> F.Column:
        """The places of a row's id in the filter; never null."""
        return F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(self.BITS)) for k in (1, 2)])

    def may(self, spots: pa.Array) -> np.ndarray:
        """For a batch of such places, which of its ids may be among the ids."""
        at = np.asarray(spots.flatten()).reshape(-1, 2)
        return ((self.table.value[at >> 6] >> (at & 63)) & 1).all(1)

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """df and a column __may: whether the row's id may be among the ids."""
        schema, may = df.withColumn("__may", F.lit(True)).schema, self.may

        def run(batches):
            for b in batches:
                ok = may(b.column("__spots"))
                b = b.drop_columns(["__spots"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, "__may"])

        return in_small_batches(df.withColumn("__spots", self.spots(column))).mapInArrow(lean(run), schema)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose id may be among the ids."""
        return self.split(df, column)[0]

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of df whose id may be among the ids, and the others."""
        marked = self.marked(df, column)
        return marked.where("__may").drop("__may"), marked.where("not __may").drop("__may")
