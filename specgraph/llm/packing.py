"""Best-fit packing of documents into bins, with conflicts."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words, written

CAPACITY, PER_SOURCE, SHARD = 2048, 4, 8192


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each item; items come in the order given.

    Bins are filed by residual. A bin carries a bitmap of the sources that it takes no more of (it has per_source items of each) and one of the
    duplicate clusters in it. The successor search goes from the item's size up, one residual in use after the other, until a bin there conflicts
    in neither; bins of one residual are filed by their source bitmap, so that a full source rules out many at once.
    """
    source_bit, cluster_bit, seen = {}, {}, set()
    for c in clusters:  # only clusters that come twice can conflict
        if c is not None:
            if c in seen:
                cluster_bit.setdefault(c, 1 << len(cluster_bit))
            seen.add(c)
    shelf: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(capacity + 1)]
    used = 0  # bit r: some bin has residual r
    residual, full, held, counts = [], [], [], []
    bins, places = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c, found = source_bit.setdefault(source, 1 << len(source_bit)), cluster_bit.get(cluster, 0), -1
        ahead = used >> size
        r = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            r += step
            ahead >>= step
            for mask, filed in shelf[r].items():
                if not mask & s:
                    for k in range(len(filed) - 1, -1, -1):
                        if not held[filed[k]] & c:
                            found = filed.pop(k)
                            if not filed:
                                del shelf[r][mask]
                            break
                if found >= 0:
                    break
            if found >= 0:
                if not shelf[r]:
                    used &= ~(1 << r)
                break
            r += 1
            ahead >>= 1
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            full.append(0)
            held.append(0)
            counts.append({})
        places.append(sum(counts[found].values()))
        bins.append(found)
        residual[found] -= size
        held[found] |= c
        counts[found][source] = counts[found].get(source, 0) + 1
        if counts[found][source] >= per_source:
            full[found] |= s
        shelf[residual[found]][full[found]].append(found)
        used |= 1 << residual[found]
    return bins, places


def pack(docs: DataFrame, cluster=None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """doc_id, piece, start, n_words, bin_id, place: every document's words, cut into pieces of at most `capacity`, each in a bin.

    A bin holds at most `capacity` words, no two documents of one duplicate cluster and at most per_source of one source (null is a source).
    cluster: a column; by default a hash of the words, A-Z lower-cased, so that exact copies part. Full pieces are bins of their own; the rest
    (from word `start` on) goes to the tightest bin that fits. Bins are filled within shards of about `shard` documents, dealt by a seeded hash
    of the row, so that no task grows with the table; larger items first. A text without words is a piece of 0 words. Repeated rows are packed
    each; an empty table gives no rows; columns other than doc_id, text and source aren't read.
    """
    if cluster is None:
        cluster = F.xxhash64(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("n"), F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), cluster).alias("cluster"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-base.count() // shard))
    base = base.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(whole=pdf["n"] // capacity, left=pdf["n"] % capacity)
        pdf.loc[(pdf["left"] == 0) & (pdf["whole"] > 0), "left"] = -1  # nothing is left
        rest = pdf[pdf["left"] >= 0].sort_values(["left", "doc_id", "row"], ascending=[False, True, True])
        source, cluster = [None if pd.isna(x) else x for x in rest["source"]], [None if pd.isna(x) else int(x) for x in rest["cluster"]]
        bins, places = best_fit(rest["left"].astype(int).tolist(), source, cluster, capacity, per_source)
        first = int(pdf["shard"].iloc[0]) << 32
        parts = [pd.DataFrame({"doc_id": rest["doc_id"], "piece": rest["whole"], "start": rest["whole"] * capacity, "n_words": rest["left"], "bin_id": [first + b for b in bins], "place": places})]
        full = pdf[pdf["whole"] > 0]
        full = full.loc[full.index.repeat(full["whole"])]
        piece = full.groupby("row").cumcount()
        start = first + (max(bins, default=-1) + 1)
        parts.append(pd.DataFrame({"doc_id": full["doc_id"], "piece": piece, "start": piece * capacity, "n_words": capacity, "bin_id": range(start, start + len(full)), "place": 0}))
        return pd.concat(parts).astype({"piece": "int64", "start": "int64", "n_words": "int64", "bin_id": "int64", "place": "int64"})

    return base.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_words long, bin_id long, place long")
