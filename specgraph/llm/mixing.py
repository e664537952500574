"""Mixing overlapping sources to target weights by a minimum-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import words, written

WEIGHTS, REPEATS = (5, 2, 1), 3


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS) -> list[float]:
    """The sum of sizes, shared by weights that repeat over the list; none above `most` times its size, what is above reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = w[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = REPEATS) -> list[dict[int, int]]:
    """How many words each pattern gives each of its sources.

    patterns: (sources, size). A minimum-cost flow by successive shortest paths: start -> pattern by one arc per repetition, whose costs 0, 1, 2, ...
    are convex, pattern -> each of its sources, source -> end by its quota. The graph holds patterns and sources only, never documents; each path
    fills an arc, so there are no more paths than arcs.
    """
    n, m = len(patterns), len(quotas)
    give: list[dict[int, int]] = [{} for _ in patterns]
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]
    begin, end = n + m, n + m + 1

    def arc(a: int, b: int, r: int, c: int) -> None:
        for x, y, k, z in ((a, b, r, c), (b, a, 0, -c)):
            out[x].append(len(head))
            head.append(y)
            room.append(k)
            cost.append(z)

    for i in range(n):
        for r in range(most):
            arc(begin, i, patterns[i][1], r)
        for s in patterns[i][0]:
            arc(i, n + s, most * patterns[i][1], 0)
    for s in range(m):
        arc(n + s, end, quotas[s], 0)
    while True:
        dist, by, queue, waits = {begin: 0}, {}, deque([begin]), {begin}
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for e in out[a]:
                if room[e] and dist[a] + cost[e] < dist.get(head[e], 1 << 60):
                    dist[head[e]], by[head[e]] = dist[a] + cost[e], e
                    if head[e] not in waits:
                        waits.add(head[e])
                        queue.append(head[e])
        if end not in dist:
            break
        path, at = [], end
        while at != begin:
            path.append(by[at])
            at = head[by[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0 and n <= head[e] < n + m and room[e ^ 1]:
                give[i][head[e] - n] = room[e ^ 1]
    return give


#: Tables of so many rows at most (one for each set of sources, or each set and size) are broadcast: some 3 MB.
SMALL = 100_000


def mix(docs: DataFrame, sources="source", weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and the columns named in keep.

    sources: a column with a document's source, or with an array of them if sources overlap; a null (or an empty array) is a source of its own, the
    last. size: the words of the text, null: 0. source_size and target are of the document's source, for an array of its first one in code point order.
    taken: words of the document in the mix, a multiple of its size up to `most` times. Whole repetitions follow from the flow; what remains of a
    pattern's share goes to documents in a seeded order that depends on doc_id and size alone, and the last gap to the largest documents that fit,
    as many of each size as fit.
    Documents of size 0 are never taken; repeated rows count each; an empty table gives no rows.
    """
    col = F.col(sources) if isinstance(sources, str) else sources
    kind = docs.select(col.alias("s")).schema["s"].dataType.typeName()
    of = F.array_sort(F.array_distinct(F.coalesce(col, F.array()))) if kind == "array" else F.array(col)
    of = F.when(F.size(of) > 0, of).otherwise(F.array(F.lit(None).cast("string")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("size"), of.alias("pattern"), *keep)
    base = base.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("row", F.monotonically_increasing_id())
    base = written(base, "sizes")
    found = base.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # a row for each set of sources
    names = sorted({s for r in found for s in r["pattern"]}, key=lambda s: (s is None, (s or "").encode()))
    index = {s: i for i, s in enumerate(names)}
    whole = [0] * len(names)
    for r in found:
        for s in r["pattern"]:
            whole[index[s]] += r["size"]
    # Overlapping sources have more words than there are: the shares are of what there is.
    total = sum(r["size"] for r in found)
    scale = total / sum(whole) if kind == "array" and sum(whole) else 1
    goal = targets([x * scale for x in whole] if scale != 1 else whole, weights, most)
    flow = route([(tuple(index[s] for s in r["pattern"]), r["size"]) for r in found], [round(x) for x in goal], most)
    plan = [(list(r["pattern"]), whole[index[r["pattern"][0]]], goal[index[r["pattern"][0]]], (f := sum(g.values())) // max(1, r["size"]), f % max(1, r["size"])) for r, g in zip(found, flow, strict=True)]
    plan = docs.sparkSession.createDataFrame(plan, "pattern array<string>, source_size long, target double, times long, rest long")
    plan = plan.withColumn("p", F.xxhash64(F.to_json(F.struct("pattern"))))
    small = F.broadcast if len(found) <= SMALL else (lambda df: df)
    base = base.withColumn("p", F.xxhash64(F.to_json(F.struct("pattern")))).drop("pattern")
    chosen = _chosen(base.where("size > 0").select("p", "row", "size", "u"), plan.where("rest > 0").select("p", "rest"), small)
    out = base.join(small(plan.drop("pattern")), "p").join(chosen.withColumn("more", F.lit(1)), "row", "left")
    taken = F.col("size") * (F.col("times") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)


def _chosen(rows: DataFrame, gaps: DataFrame, small) -> DataFrame:
    """The row numbers that fill each pattern's rest: in the order of u as far as it goes, then as many of each size as fit, the largest first."""
    first, later = _in_order(rows, gaps, small)
    sizes = later.groupBy("p", "size", "gap").agg(F.count("*").alias("n"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        gap, got = int(pdf["gap"].iloc[0]) if len(pdf) else 0, []
        for size, n in sorted(zip(pdf["size"], pdf["n"], strict=True), reverse=True):
            if use := min(int(n), gap // int(size)):
                gap -= use * int(size)
                got.append((pdf["p"].iloc[0], size, use * int(size)))
        return pd.DataFrame(got, columns=["p", "size", "rest"]).astype("int64")

    use = written(sizes.groupBy("p").applyInPandas(fill, "p long, size long, rest long"), "fills")
    # Rows of one size fill what they have to without a gap.
    both = F.xxhash64("p", "size").alias("p")
    few = F.broadcast if use.count() <= SMALL else (lambda df: df)
    more, _ = _in_order(later.join(few(use.select("p", "size")), ["p", "size"], "left_semi").select(both, "row", "size", "u"), use.select(both, "rest"), few)
    return first.union(more)


def _in_order(rows: DataFrame, gaps: DataFrame, small) -> tuple[DataFrame, DataFrame]:
    """The row numbers that fill each pattern's rest in the order of u, up to the first row that is too large, and the later rows (p, row, size, u, gap) that fit the gap.

    By bins of u, then by bins within the bin where the rest ends, then by row. small: broadcasts what has a row for each pattern, if these are few.
    """
    rows = rows.join(small(gaps.select("p")), "p", "left_semi").withColumn("b1", F.shiftrightunsigned("u", 52)).withColumn("b2", F.shiftrightunsigned("u", 40) % 4096)
    rows = written(rows, "rows")

    def edge(binned: DataFrame, gaps: DataFrame, b: str) -> DataFrame:
        """p, the bin where the rest ends, and what is left of the rest there."""
        before = F.sum("size").over(W.partitionBy("p").orderBy(b).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
        sums = binned.groupBy("p", b).agg(F.sum("size").alias("size")).withColumn("before", before).join(small(gaps), "p")
        return sums.where("before <= rest").groupBy("p").agg(F.max_by(F.struct(F.col(b).alias("at"), (F.col("rest") - F.col("before")).alias("rest")), b).alias("e")).select("p", F.col("e.at").alias(f"{b}_at"), F.col("e.rest").alias("rest"))

    one = edge(rows, gaps, "b1")
    one = written(one, "edges")
    two = edge(rows.join(small(one.select("p", "b1_at")), "p").where("b1 = b1_at"), one.select("p", "rest"), "b2")
    at = written(one.select("p", "b1_at").join(small(two), "p"), "edges")
    rows = rows.join(small(at), "p")
    full = rows.where("b1 < b1_at or (b1 = b1_at and b2 < b2_at)").select("row")
    last = rows.where("b1 = b1_at and b2 = b2_at").withColumn("sum", F.sum("size").over(W.partitionBy("p").orderBy("u", "row")))
    fit = last.where("sum <= rest")
    filled = fit.groupBy("p").agg(F.max("sum").alias("sum"))
    left = written(at.join(filled, "p", "left"), "gaps").select("p", (F.col("rest") - F.coalesce("sum", F.lit(0))).alias("gap"))
    later = rows.where("b1 > b1_at or (b1 = b1_at and b2 > b2_at)").select("p", "row", "size", "u").union(last.where("sum > rest").select("p", "row", "size", "u"))
    return full.union(fit.select("row")), written(later.join(small(left), "p").where("size <= gap"), "later")
