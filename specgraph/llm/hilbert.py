"""Nearest neighbours by windows over several shifted Hilbert orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .vectors import common_length, matrix, unit, usable

#: Orderings, projected dimensions of each, bits of a coordinate; rows of a block, sampled keys.
ORDERINGS, DIMS, BITS = 16, 4, 12
BLOCK, SAMPLE = 2048, 20_000
#: Windows are as wide as this share of the true neighbours of so many sampled queries needs.
AIM, PROBES = 0.97, 128
SPREAD = 5.0
#: Scores nearer than this to the last that counts are taken anew pair by pair; scores that agree to 1 / TIE are ties.
MARGIN, TIE = 1e-9, 1e12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of coordinates below 2**bits) along the Hilbert curve: Gray code of the bit planes, turned plane by plane."""
    x = cells.astype(np.int64).T.copy()
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i in range(len(x)):
            on = (x[i] >> q & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> q & 1, (1 << q) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | (x[i] >> q & 1)
    return key


def keys(x: np.ndarray, seed: int) -> np.ndarray:
    """A column of keys for each ordering: unit vectors, projected at random, shifted by up to half the grid."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(ORDERINGS):
        axes = np.linalg.qr(rng.normal(size=(max(x.shape[1], DIMS), DIMS)))[0][: x.shape[1]]
        shift = rng.random(DIMS)
        y = np.clip(x @ axes * np.sqrt(x.shape[1]) / (2 * SPREAD) + 0.5, 0, 1)
        out.append(hilbert(np.minimum((y + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))
    return np.stack(out, 1)


def reach(nodes: DataFrame, asks: DataFrame, ladder: np.ndarray, k: int, seed: int) -> float:
    """The share of all rows that a window has to span on either side of a query, so that it meets AIM of the true neighbours in some ordering.

    Measured: PROBES queries (by the hash of their vector) against all rows. ladder: a sample's keys, a column for each ordering, each sorted.
    """
    probes = asks.select("q", "vec").distinct().orderBy(F.xxhash64("q"), "q").limit(PROBES).collect()
    names, x = np.array([r["q"] for r in probes], np.int64), unit(matrix(pa.array([bytes(r["vec"]) for r in probes], pa.binary())))

    def best(batches):
        held = None
        for b in batches:
            if not len(b):
                continue
            vec, node = matrix(b.column("vec")), np.asarray(b.column("node"))
            score = x @ unit(vec).T
            score[names[:, None] == node[None, :]] = -2
            top = np.argpartition(-score, min(k, len(node)) - 1, axis=1)[:, :k]
            part = [(i, float(score[i, j]), vec[j].tobytes()) for i in range(len(x)) for j in top[i] if score[i, j] > -2]
            held = sorted((held or []) + part, key=lambda t: (t[0], -t[1]))
            held = [t for n, t in enumerate(held) if n < k or held[n - k][0] != t[0]]
        got = list(zip(*held, strict=True)) if held else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.binary())], ["i", "score", "vec"])

    found = nodes.select("node", "vec").mapInArrow(best, "i int, score double, vec binary")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "vec"))).where(F.col("n") <= k).select("i", "vec").collect()  # k rows a probe
    if not found:
        return 0.0
    at = lambda vecs: np.stack([np.searchsorted(ladder[:, o], column) / len(ladder) for o, column in enumerate(keys(vecs, seed).T)], 1)
    mine, theirs = at(x), at(unit(matrix(pa.array([bytes(r["vec"]) for r in found], pa.binary()))))
    need = np.abs(mine[[r["i"] for r in found]] - theirs).min(1)
    return float(np.quantile(need, AIM))


def nearest(vectors: DataFrame, queries, k: int = 5, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets `queries` (a condition on vec_id) its k nearest other rows by cosine.

    Nearest first, ties (scores that agree to 12 decimals) to the smaller vec_id; fewer than k if there are no more. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows with a null vec_id, nor vectors of another length than most have. Rows that share a vec_id are rows of their own; each is asked and may
    be found, and what has a query's own id is left out. An empty table gives no rows. Columns other than vec_id and embedding aren't read.

    Copies of one vector are searched once (but for ids on several vectors, which are searched each by themselves, without what has their id alone),
    and stand in the result by their k + 1 smallest ids. Each ordering is cut into ranges of about BLOCK vectors, at quantiles of at most SAMPLE keys; a
    query meets its own range and so many on either side as reach() finds. What it meets in any ordering is ranked by cosines of the original vectors in
    double precision. Where near vectors lie near in some ordering, that is one range on either side however many vectors there are. Where vectors have
    no structure, near ones are little nearer there than others, and only wide windows find them.
    """
    length = common_length(vectors)
    rows = written(usable(vectors, length), "vectors")

    def least(batches):
        for b in batches:
            pdf = pd.DataFrame({"node": np.asarray(b.column("node")), "vec_id": np.asarray(b.column("vec_id"))})
            pdf = pdf.groupby(["node", "vec_id"]).size().astype("int64").reset_index(name="copies")
            yield pa.RecordBatch.from_pandas(pdf.groupby("node").head(k + 1), preserve_index=False)

    few = rows.select("node", "vec_id").mapInArrow(least, "node long, vec_id long, copies long").groupBy("node", "vec_id").agg(F.sum("copies").alias("copies"))
    few = few.withColumn("n", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = written(few, "members")
    two = members.where("n <= 2").groupBy("node").agg(F.min("vec_id").alias("id1"), F.max("vec_id").alias("id2"))
    nodes = written(rows.groupBy("node").agg(F.first("vec").alias("vec")).join(two, "node"), "nodes")
    # Rows that ask, by id and vector; own: whether the id is on several vectors.
    asking = rows.where(queries).groupBy(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).agg(F.count("*").alias("times"))
    asking = asking.join(asking.groupBy("query_id").agg((F.count("*") > 1).alias("own")), "query_id")
    asking = written(asking.withColumn("self", F.when(F.col("own"), F.col("query_id")).otherwise(F.lit(0))), "asking")
    n = nodes.count()
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))).select("vec").limit(2 * SAMPLE)
    taken = matrix(pa.array([bytes(r["vec"]) for r in sample.collect()], pa.binary()))
    blocks = max(1, -(-n // BLOCK))
    ladder = np.sort(keys(unit(taken), seed), axis=0) if len(taken) and blocks > 1 else np.zeros((0, ORDERINGS))
    cuts = np.quantile(ladder, np.arange(1, blocks) / blocks, axis=0) if len(ladder) else ladder

    def place(batches):
        for b in batches:
            x = unit(matrix(b.column("vec")))
            if not len(x):
                continue
            at = keys(x, seed)
            for o in range(ORDERINGS):
                block = np.searchsorted(cuts[:, o], at[:, o], "right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), o), pa.int32()), pa.array(block, pa.int32())], [*b.schema.names, "o", "block"])

    asks = nodes.select(F.col("node").alias("q"), "vec").join(asking.select("q", "own", "self").distinct(), "q").select("q", "own", "self", "vec")
    side = max(1, int(np.ceil(reach(nodes, asks, ladder, k, seed) * blocks))) if len(ladder) else 1
    asked = asks.mapInArrow(place, "q long, own boolean, self long, vec binary, o int, block int")
    asked = asked.withColumn("block", F.explode(F.sequence(F.greatest(F.col("block") - side, F.lit(0)), F.least(F.col("block") + side, F.lit(blocks - 1)))))
    # Queries of one block are dealt to as many tasks as keep each small; the block goes along.
    deals = max(1, int(n * (2 * side + 1) / blocks / 8192 / 16))
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("q", "self"), F.lit(deals)).cast("int"))
    held = nodes.select("node", "vec", "id1", "id2").mapInArrow(place, "node long, vec binary, id1 long, id2 long, o int, block int").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y = np.frombuffer(b"".join(right["vec"]), np.float64).reshape(len(right), -1)
            long, flat = np.sqrt((y * y).sum(1)), unit(y).T
            names, id1, id2 = (right[c].to_numpy() for c in ("node", "id1", "id2"))
            for i in range(0, len(left), 256):
                part = left.iloc[i : i + 256]
                x = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(len(part), -1)
                near = unit(x) @ flat
                for j, (q, own, me) in enumerate(zip(part["q"], part["own"], part["self"], strict=True)):
                    # The least id that isn't the query's; vectors that have no other are left out.
                    first = np.where(id1 == me, id2, id1) if own else id1
                    use = np.flatnonzero(first != me) if own else np.arange(len(names))
                    if len(use) > k + 1:
                        s = near[j, use]
                        use = use[s >= np.partition(s, -k - 1)[-k - 1] - MARGIN]
                    score = (x[j] * y[use]).sum(1) / (np.sqrt((x[j : j + 1] * x[j : j + 1]).sum(1)) * long[use])
                    level = np.rint(score * TIE).astype(np.int64)
                    best = np.lexsort((first[use], -level))[: k + 1]
                    out.append(pd.DataFrame({"q": q, "own": own, "self": me, "c": names[use[best]], "first": first[use[best]], "level": level[best], "score": score[best]}))
        kinds = {"q": "int64", "own": "bool", "self": "int64", "c": "int64", "first": "int64", "level": "int64", "score": "float64"}
        return pd.concat(out).astype(kinds) if out else pd.DataFrame({c: [] for c in kinds}).astype(kinds)

    by, who = ["o", "block", "deal"], ["q", "own", "self"]
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, "q long, own boolean, self long, c long, first long, level long, score double")
    found = found.groupBy(*who, "c").agg(F.first("first").alias("first"), F.max("level").alias("level"), F.max("score").alias("score"))
    found = written(found.withColumn("n", F.row_number().over(W.partitionBy(*who).orderBy(F.desc("level"), "first"))).where(F.col("n") <= k + 1).drop("n", "first"), "found")
    hits = found.join(members.drop("n").withColumnRenamed("node", "c"), "c").where("not own or vec_id <> self")
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy(*who).orderBy(F.desc("level"), "vec_id", "c"))).where(F.col("n") <= k + 1).drop("n")
    best = asking.join(hits, who).where("vec_id <> query_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("level"), "vec_id", "c"))).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")
