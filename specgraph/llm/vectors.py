"""What the vector operators share: usable rows as double vectors, and exact copies as one."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have, of equally frequent ones the larger; 0 without any. Vectors of other lengths take no part in anything."""
    found = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def usable(vectors: DataFrame, length: int) -> DataFrame:
    """vec_id, node and vec (doubles, as bytes) of rows with an id and a vector of that length that isn't zero, or holding null or non-finite components.

    node is a hash of the components: exact copies share it.
    """

    def run(batches):
        for b in batches:
            ids, nodes, vecs = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if i is None or not v.is_valid or len(v.values) != length or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64) + 0.0  # -0.0 is 0.0
                with np.errstate(over="ignore"):
                    norm = x @ x
                if not np.isfinite(x).all() or not (x != 0).any():
                    continue
                if not 1e-280 < norm < 1e280:  # the cosine doesn't change, and can be taken
                    x = x / np.abs(x).max()
                ids.append(i)
                vecs.append(x.tobytes())
                nodes.append(int.from_bytes(hashlib.blake2b(vecs[-1], digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "node", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, node long, vec binary")


def matrix(column) -> np.ndarray:
    """The vectors of a binary column, a row each; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))
