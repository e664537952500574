"""Near-duplicates among vectors by randomised-rotation binary codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import stars
from .vectors import common_length, matrix, unit, usable

CODE = 256
#: How many standard errors the bounds reach, and the probability with which a pair at the threshold may be missed.
BOUND, MISS = 6.0, 1e-6


def rotation(dims: int, seed: int) -> np.ndarray:
    """dims orthonormal rows in max(CODE, dims) dimensions: vectors are padded with zeros, then turned at random."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(max(CODE, dims), dims)))[0].T


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs of turned unit vectors as bytes, and each code's inner product with its vector, the correction factor."""
    signs = turned > 0
    return np.packbits(signs, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded and turned unit vectors, row by row."""
    width = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float64) * 2 - 1
    return (signs * turned).sum(1) / math.sqrt(width) / factors


def slack(factors: np.ndarray, width: int) -> np.ndarray:
    """What BOUND standard errors of an estimate are, times the sine of the angle that it stands for."""
    return BOUND * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(width - 1)


def verdicts(got: np.ndarray, more: np.ndarray, spread: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which estimates are certainly below the threshold, and which certainly not; more: a further error that is known.

    An estimate lies within spread times the sine of what it stands for. Of a cosine at the threshold or above, the lowest possible estimate is that of
    the threshold itself; of one below it, the highest is at the threshold or where cosine + spread * sine has its peak.
    """
    sine = math.sqrt(1 - threshold**2)
    peak = 1 / np.sqrt(1 + spread**2)
    top = np.where(peak < threshold, np.sqrt(1 + spread**2), threshold + spread * sine)
    return got + more < threshold - spread * sine, got - more > top


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as bytes: whole steps, the step of each row, and the length of what rounding has left out."""
    step = np.abs(x).max(1) / 127
    whole = np.rint(x / step[:, None]).astype(np.int8)
    return whole, step, np.sqrt(((whole * step[:, None] - x) ** 2).sum(1))


def tables(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket's key and the number of tables: keys long enough for small buckets, tables enough to meet pairs at the threshold."""
    bits = min(40, max(6, math.ceil(math.log2(max(n, 2))) - 3))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def linked(nodes: DataFrame, n: int, threshold: float, seed: int) -> DataFrame:
    """The pairs (a, b), a < b, of nodes (node, vec) with a cosine of threshold or more.

    Each node is coded once: its code with its correction factor, and the vector in bytes. Pairs that meet in a bucket and whose codes differ in few
    bits are estimated from a's code and factor and b's bytes alone; full vectors are fetched only for pairs that the bounds leave undecided.
    """
    bits, count = tables(n, threshold)

    def code(batches):
        for b in batches:
            x = unit(matrix(b.column("vec")))
            if not len(x):
                continue
            codes, factors = encode(x @ rotation(x.shape[1], seed))
            whole, step, left = rounded(x)
            words = codes[:, : CODE // 8].copy().view(np.int64)
            planes = np.random.default_rng(seed + 1).normal(size=(x.shape[1], bits * count))
            on = (x @ planes > 0).reshape(len(x), count, bits)
            key = (on * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), pa.array(key.ravel()))
            arrays = [b.column("node"), *(pa.array(words[:, k].copy()) for k in range(4)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors), pa.array([w.tobytes() for w in whole], pa.binary()), pa.array(step), pa.array(left), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "c0", "c1", "c2", "c3", "code", "factor", "whole", "step", "left", "keys"])

    coded = written(nodes.mapInArrow(code, "node long, c0 long, c1 long, c2 long, c3 long, code binary, factor double, whole binary, step double, left double, keys array<long>"), "codes")
    filed = coded.select("node", "c0", "c1", "c2", "c3", F.posexplode("keys").alias("t", "key"))
    filed = written(filed.withColumn("key", F.col("key") * count + F.col("t")).drop("t"), "buckets")
    full = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    filed = filed.join(full, "key")
    # Codes of pairs at the threshold differ in this many bits or fewer, but for one in a million.
    angle = math.acos(threshold) / math.pi
    apart = math.ceil(CODE * angle + 5 * math.sqrt(CODE * angle * (1 - angle)))
    other = filed.select("key", F.col("node").alias("b"), *[F.col(f"c{k}").alias(f"d{k}") for k in range(4)])
    differ = sum((F.bit_count(F.col(f"c{k}").bitwiseXOR(F.col(f"d{k}"))) for k in range(1, 4)), F.bit_count(F.col("c0").bitwiseXOR(F.col("d0"))))
    pairs = filed.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (differ <= apart)).select("a", "b").distinct()

    def judge(batches):
        for b in batches:
            width = len(b.column("whole")[0].as_py()) if len(b) else 1
            whole = np.frombuffer(b"".join(b.column("whole").to_pylist()), np.int8).reshape(len(b), width)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), -1)
            factor, step, left = (np.asarray(b.column(c)) for c in ("factor", "step", "left"))
            turn = rotation(width, seed)
            got = estimate(codes, factor, (whole * step[:, None]) @ turn) if len(b) else np.zeros(0)
            below, above = verdicts(got, left / factor, slack(factor, turn.shape[1]), threshold)
            keep = pa.array(~below)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(above[~below])], ["a", "b", "sure"])

    pairs = pairs.join(coded.select(F.col("node").alias("a"), "code", "factor"), "a").join(coded.select(F.col("node").alias("b"), "whole", "step", "left"), "b")
    judged = written(pairs.select("a", "b", "code", "factor", "whole", "step", "left").mapInArrow(judge, "a long, b long, sure boolean"), "judged")

    def decide(batches):
        for b in batches:
            p, q = matrix(b.column("x")), matrix(b.column("y"))
            ok = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= threshold
            yield b.select(["a", "b"]).filter(pa.array(ok))

    open_ = judged.where("not sure").select("a", "b").join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
    return judged.where("sure").select("a", "b").union(open_.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links: the other vectors with a cosine of threshold or more, in double precision. component_id: the smallest vec_id that links reach; kept: it is
    the row's own. Vectors that are null, zero, or hold null or non-finite components link with nothing; nor do rows with a null vec_id, whose
    component_id is null and which aren't kept. Copies of one vector are one node, whatever their number; rows that share a vec_id count as vectors of
    their own. An empty table gives no rows. Columns other than vec_id and embedding aren't read. Vectors of another length than most have link with nothing.
    A pair is missed with a probability of MISS by the buckets and of about 1e-6 by the codes; a bound errs with one of 1e-9.
    """
    length = common_length(vectors)
    rows = written(usable(vectors, length), "vectors")
    nodes = written(rows.groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "nodes")
    links = written(linked(nodes.select("node", "vec"), nodes.count(), threshold, seed), "links")
    both = links.union(links.select("b", "a"))
    size = nodes.select(F.col("node").alias("b"), "n")
    outside = both.join(size, "b").groupBy("a").agg(F.sum("n").alias("far")).select(F.col("a").alias("node"), "far")
    group = nodes.select("node", "n", "least").join(stars(links), "node", "left").withColumn("root", F.coalesce("root", "node")).join(outside, "node", "left")
    low = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = group.join(low, "root").select("node", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    inside = rows.select("vec_id", "node").join(of_node, "node").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))

    def rest(batches):
        for b in batches:
            bad = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                x = np.asarray(v.values, np.float64) if v.is_valid and len(v.values) == length and not v.values.null_count else np.zeros(0)
                if i is None or not (x != 0).any() or not np.isfinite(x).all():
                    bad.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64()), pa.array([0] * len(bad), pa.int64()), pa.array(bad, pa.int64()), pa.array([i is not None for i in bad])], ["vec_id", "n_links", "component_id", "kept"])

    outside = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(rest, "vec_id long, n_links long, component_id long, kept boolean")
    return inside.union(outside)
