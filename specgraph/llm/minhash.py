"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document's signature has K coordinates; two documents whose shingle sets have a Jaccard index of 0.8 agree in Bin(K, 0.8) of them,
in fewer than MATCH with a probability below 3e-6. So a linked pair shares MATCH coordinate values, and, with the values ordered by how many
documents carry them, one value among the first K - MATCH + 1 of each: only these prefixes are posted. Values that one document alone carries
come first in that order and need no posting, so most documents post nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, IdFilter, Rolling, bytes_of, in_small_batches, lean, mix, slices, written
from .components import stars

K, MATCH = 64, 36
_RNG = np.random.default_rng(20240801)
ODD = _RNG.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
FLIP = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)
STEPS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, rolling: Rolling):
    """Per row, the sorted distinct hashes of its word shingles."""
    n = len(data)
    if not n:
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.uint64)
        return
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    rolling.load(data, Rolling.TABLE[LOWER])
    word = rolling.of(start, end)
    near = np.searchsorted(start, offsets)
    m = len(word)
    if m >= size:
        whole = word[: m - size + 1] * STEPS[0]
        for k in range(1, size):
            whole = whole + word[k : m - size + 1 + k] * STEPS[k]
        whole = mix(whole)
    for a, b in zip(near[:-1], near[1:], strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(word[a:b] * STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def signature(of: np.ndarray) -> np.ndarray:
    x, out = (of >> np.uint64(32)).astype(np.uint32), np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 16384):
        part = x[i : i + 16384]
        out = np.minimum(out, ((part[None, :] ^ FLIP[:, None]) * ODD[:, None]).min(1))
    return out


def node_of(of: np.ndarray) -> int:
    """A set's identity: two documents with one set are one node."""
    return int.from_bytes(hashlib.blake2b(of.tobytes(), digest_size=8).digest(), "little", signed=True)


PACKED, ODD_BITS = [f"s{k}" for k in range(8)], [f"o{k}" for k in range(8)]


def parities(of: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of hashes falls on each. Two sets' bits differ in no more places than the sets in elements."""
    return np.packbits((np.bincount((of & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node, sig (null for an empty set) of each row, sig's low bytes in eight longs, and the set's parities in eight more."""

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            count, nodes, sigs, odd = [], [], np.zeros((len(batch), K), np.uint32), np.zeros((len(batch), 8), np.int64)
            for lo, hi in slices(offsets):
                for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size, rolling):
                    if len(s):
                        sigs[len(count)], odd[len(count)] = signature(s), parities(s)
                    nodes.append(node_of(s) if len(s) else None)
                    count.append(len(s))
            low = sigs.astype(np.uint8).view(np.int64)
            full = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * K, pa.int32()), pa.array(sigs.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(nodes, pa.int64()), full, *(pa.array(x[:, k].copy()) for x in (low, odd) for k in range(8))], ["doc_id", "n_shingles", "node", "sig", *PACKED, *ODD_BITS])

    schema = "doc_id long, n_shingles long, node long, sig array<int>, " + ", ".join(f"{s} long" for s in PACKED + ODD_BITS)
    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(lean(run), schema)


def agree(left: str, right: str) -> str:
    """SQL for the number of coordinates whose low bytes agree, eight at a time: at least as many as coordinates agree."""
    terms = []
    for s in PACKED:
        x = f"({left}.{s} ^ {right}.{s})"
        # The or of a byte's bits is the or of eight shifts at its lowest bit.
        whole = " | ".join([x, *(f"shiftrightunsigned({x}, {k})" for k in range(1, 8))])
        terms.append(f"bit_count(({whole}) & 72340172838076673L)")
    return f"{K} - (" + " + ".join(terms) + ")"


def full_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """node and its shingle hashes, eight bytes each, of the documents that stand for a node in reps."""
    wanted = IdFilter(reps.select(F.col("rep").alias("id")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").select("text", wanted.spots("doc_id").alias("spots"))
    may = wanted.may

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            # The filter is asked here, not in a step before: that would hold a second Python worker for each task.
            batch = batch.filter(pa.array(may(batch.column("spots")), pa.bool_()))
            data, offsets = bytes_of(batch.column("text"))
            nodes, sets = [], []
            for lo, hi in slices(offsets):
                for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size, rolling):
                    nodes.append(node_of(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "items"])

    return in_small_batches(docs).mapInArrow(lean(run), "node long, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


#: Posting lists are compared in chunks of about so many members, each pair of chunks by itself.
CHUNK, BLOCK = 1024, 512
#: Rounds in which each posting list links its members to one of them, before members of different groups are compared one by one.
STARS = 3


#: Pairs whose signatures are compared at once.
PAIRS = 1 << 15


def across(percent: int):
    """Compares the members of each pair of chunks of a posting list that belong to different groups: sizes, parities, then coordinates.

    Two members may meet in many lists; only the list of the lowest coordinate that both have posted and share returns the pair.
    """
    bit = np.arange(K, dtype=np.uint64)

    def compare(g):
        nth, i, j, own, node, root, n, mask = (g[:, c] for c in range(8))
        odd, sig = np.ascontiguousarray(g[:, 8:16]).view(np.uint64), np.ascontiguousarray(g[:, 16:]).view(np.uint32)
        mask = mask.copy().view(np.uint64)
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        for a in range(0, len(left), BLOCK):
            x = left[a : a + BLOCK]
            for b in range(0, len(right), BLOCK):
                y = right[b : b + BLOCK]
                p, q = n[x][:, None], n[y][None, :]
                apart = sum(np.bitwise_count(odd[x, k][:, None] ^ odd[y, k][None, :]).astype(np.int64) for k in range(8))
                ok = (root[x][:, None] != root[y][None, :]) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q)) & ((100 + percent) * apart <= (100 - percent) * (p + q))
                us, vs = np.nonzero(ok)
                for c in range(0, len(us), PAIRS):
                    u, v = x[us[c : c + PAIRS]], y[vs[c : c + PAIRS]]
                    same = sig[u] == sig[v]
                    posted = ((mask[u] & mask[v])[:, None] >> bit) & np.uint64(1) == 1
                    here = (same.sum(1) >= MATCH) & ((same & posted).argmax(1) == nth[0] >> 32)
                    yield node[u[here]], node[v[here]]

    def run(batches):
        rest = None
        for batch in batches:
            cols = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:-1]], 1)
            sig = np.ascontiguousarray(np.asarray(batch.column("sig").flatten()).astype(np.int32)).reshape(-1, K).view(np.int64)
            cols = np.concatenate((cols, sig), 1)
            cols = np.concatenate((rest, cols)) if rest is not None else cols
            cut = np.flatnonzero((cols[1:, :3] != cols[:-1, :3]).any(1)) + 1
            rest = cols[cut[-1] :] if len(cut) else cols
            yield batch_of([cols[a:z] for a, z in zip(np.concatenate(([0], cut[:-1])), cut, strict=False)] if len(cut) else [])
        if rest is not None and len(rest):
            yield batch_of([rest])

    def batch_of(groups):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g in groups:
            if len(g) > 1:
                found += compare(g)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack((low, high), 1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by a Jaccard index of `percent` per cent or more over word shingles.

    A document's set: the distinct shingles of `size` words, A-Z lower-cased; with fewer words the whole sequence as one; without words (or with a
    null text) the set is empty and linked with nothing. component_id is the smallest doc_id that links reach; kept: it is the document's own.
    Exact copies (equal sets) are one node from the start, whatever their number. A row with a null doc_id carries a null component_id and isn't
    kept; rows that share a doc_id give one row each. An empty table gives no rows; columns other than doc_id and text aren't read.

    Links are found in rounds. In a star round each posting list offers one member of its largest group to its members of other groups, another one
    each round; what the full sets confirm joins groups, so a large group of near copies is one group after two or three rounds of as many pairs as
    the lists have rows. Rounds end when one confirms nothing, or after STARS. Then members of different groups are compared, list by list: the
    largest group's members in chunks, each with all the others, so that what a list sends grows with what is still apart in it.

    The lists beyond a member's prefix are the long ones; they are skipped, and only probed (coordinate by coordinate) for pairs that the prefixes
    bring together.
    """
    sk = written(sketches(docs, size), "sketches")
    sketch = ["n", *PACKED, *ODD_BITS]
    firsts = [F.first(s).alias(s) for s in PACKED + ODD_BITS]
    reps = sk.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), *firsts)
    reps = written(reps, "reps")
    token = reps.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.expr("shiftleft(cast(k as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("token"))
    common = token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = (
        token.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
        .where(F.size("held") >= MATCH)
        .select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - MATCH + 1)).alias("t")).select("node", "t.token")
    )
    posted = written(posted, "posted")
    active = posted.select("node").distinct().join(reps.select("node", "rep"), "node")
    sets = written(full_sets(docs, active, size), "sets", "uncompressed")  # hashes can't be compressed
    group = active.select("node", F.col("node").alias("root"))
    held = posted.withColumn("root", F.col("node"))
    for turn in range(STARS):
        offers = written(_offers(held.withColumn("turn", F.lit(turn)), reps.select("node", *sketch), percent), "offers")
        links = written(confirmed(offers, _only(sets, offers) if turn else sets, percent).distinct(), "links")
        if links.isEmpty():
            break
        group = written(_merged(group, links), "groups")
        held = written(_mixed(held.select("token", "node").join(group, "node")), "held")
    second = written(_apart(held, reps, percent), "pairs")
    if not second.isEmpty():
        group = written(_merged(group, confirmed(second, _only(sets, second), percent)), "groups")
    nodes = written(reps.select("node", "rep").join(group, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep"), "nodes")
    least = nodes.groupBy("root").agg(F.min("rep").alias("component"))
    nodes = nodes.join(least, "root").select("node", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = sk.select("doc_id", "n_shingles", "node").join(nodes, "node", "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in pairs; where these are few, Spark broadcasts them and shuffles no sets."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return written(sets.join(ids, "node", "left_semi"), "some-sets", "uncompressed")


def _mixed(held: DataFrame) -> DataFrame:
    """The lists (token, node, root) that still hold more than one group."""
    lists = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return held.join(lists, "token").select("token", "node", "root")


def _offers(held: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a star round that sizes, parities and coordinates allow: in each list, a member of its largest group with all of other groups.

    held: token, node, root, turn (a column, so that the rounds share their compiled code).
    """
    by_root = held.groupBy("token", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "turn"), "node")).alias("one"))
    hub = by_root.groupBy("token").agg(F.max(F.struct("n", F.col("one.col1").alias("u"), F.col("one.node").alias("node"), "root")).alias("h"), F.count("*").alias("roots")).where("roots > 1")
    met = held.join(hub.select("token", F.col("h.node").alias("hub"), F.col("h.root").alias("hub_root")), "token").where("root <> hub_root")
    met = met.groupBy("hub", "node").agg(F.count("*").alias("hits"))
    parity = " + ".join(f"bit_count(p.{s} ^ q.{s})" for s in ODD_BITS)
    fits = f"100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n) and {100 + percent} * ({parity}) <= {100 - percent} * (p.n + q.n) and {agree('p', 'q')} >= greatest({MATCH}, hits)"
    names = sketch.columns[1:]
    met = met.join(sketch.select("node", F.struct(*names).alias("q")), "node").join(sketch.select(F.col("node").alias("hub"), F.struct(*names).alias("p")), "hub")
    return met.where(fits).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """group (node, root) after links (a, b): the graph that is searched has a node for each group only."""
    own = lambda side: group.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    between = links.join(own("b"), "b").join(own("a"), "a").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
    whole = stars(between).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return group.join(whole, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))


def _apart(held: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of different groups in one list whose sizes, parities and coordinates allow a link.

    A list's largest group needs no comparison within: chunks of the others (0 and up) meet each other and the chunks of the largest group (behind them).
    """
    roots = held.groupBy("token", "root").agg(F.count("*").alias("n"))
    lists = roots.groupBy("token").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    lists = lists.select("token", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / CHUNK).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK).cast("int").alias("others"))
    held = held.join(lists, "token")
    masks = held.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("mask"))
    spot, of_top = F.xxhash64("node", F.lit(3)), F.col("root") == F.col("top")
    own = F.when(of_top, F.col("others") + F.pmod(spot, F.col("tops"))).otherwise(F.pmod(spot, F.col("others"))).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(of_top, F.lit(0)).otherwise(F.col("tops")))))
    held = held.select("token", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = held.join(masks.join(reps.select("node", "n", *ODD_BITS, "sig"), "node"), "node").select("token", "i", "j", "own", "node", "root", "n", "mask", *ODD_BITS, "sig")
    by = ["token", "i", "j"]
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(lean(across(percent)), "a long, b long")
