"""Removal of long repeated byte strings: suffix order by column-wise construction over what can repeat at all.

A column-wise construction over whole documents takes as many rounds as the longest document has bytes, each over all that is there. So it gets only
what needs it. Every string of LENGTH bytes contains an anchor, a piece of PIECE bytes picked by the string's own content (the least hash in it), so
equal strings share their anchor. (1) Where an anchor occurs once, nothing repeats. (2) Where occurrences of an anchor agree in all strings that it was
picked for, all of these repeat. (3) What remains, the borders of repeats, is cut into groups that share a core of CORE bytes; the transform and the
common prefixes of each group's strings, with the core as one symbol, say which of them begin with LENGTH bytes that occur elsewhere. A group of more
than HOT rows is parted first, by further symbols of its strings: half of what a string has beside the core joins the core, on the left or on the right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import Columns
from .common import IdFilter, Rolling, bytes_of, lean, mix, slices, written

LENGTH, PIECE, STEP = 400, 128, 50
CORE = LENGTH - STEP + 1
#: Groups of more rows are parted by longer cores before they are ordered; rows of one construction.
HOT, TOGETHER = 20_000, 4096
_BITS = 21


def anchors_of(data: np.ndarray, offsets: np.ndarray, rolling: Rolling):
    """row, anchor, first and last start picked for it, anchor hash, hash of all bytes of its strings: arrays over one slice's rows."""
    parts = []
    for lo, hi in slices(offsets, (1 << _BITS) - LENGTH):
        end = int(offsets[hi])
        at = int(offsets[lo])
        while at < end:  # a row longer than a chunk is taken in several
            stop = min(end, at + (1 << _BITS))
            parts.append(_chunk(data[at:stop], np.clip(offsets[lo : hi + 1], at, stop) - at, lo, at, rolling))
            if stop == end:
                break
            at = stop - LENGTH + 1
    parts = [p for p in parts if p is not None]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6


def _chunk(data, offsets, first_row, shift, rolling):
    n = len(data) - LENGTH + 1
    if n <= 0 or not (np.diff(offsets) >= LENGTH).any():
        return None
    rolling.load(data)
    pieces = rolling.windows(PIECE)
    mask = np.uint64((1 << _BITS) - 1)
    packed = (pieces & ~mask) | (mask - np.arange(len(pieces), dtype=np.uint64))  # of equal ones the rightmost
    width, span, least = LENGTH - PIECE + 1, 1, packed
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    pick = (mask - (least & mask)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    valid = np.arange(n) + LENGTH <= offsets[np.minimum(row + 1, len(offsets) - 1)]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return None
    p = pick[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    s0, s1, p = starts[head], starts[tail], p[head]
    whole = rolling.of(s0, s1 + LENGTH) ^ mix((p - s0).astype(np.uint64))
    r = row[s0]
    return r + first_row, p + shift, s0 + shift, s1 + shift, pieces[p].view(np.int64), whole.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def _anchors(batches):
    rolling = Rolling()
    for b in batches:
        data, offsets = bytes_of(b.column("text"))
        row, p, s0, s1, piece, whole = anchors_of(data, offsets, rolling)
        base = offsets[row] if len(row) else row
        rid = np.asarray(b.column("rid"))
        yield pa.RecordBatch.from_arrays([pa.array(rid[row] if len(row) else np.zeros(0, np.int64)), *(pa.array(x - base) for x in (p, s0, s1)), pa.array(piece), pa.array(whole)], ["rid", "p", "s0", "s1", "piece", "whole"])


def _cut(batches):
    """For each border occurrence and each step of offsets: the group's core, and the bytes left and right of it."""
    for b in batches:
        data, offsets = bytes_of(b.column("text"))
        out: list[list] = [[] for _ in range(8)]
        for i, (rid, found) in enumerate(zip(b.column("rid").to_pylist(), b.column("found").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            for x in found:
                p, s0, s1 = x["p"], x["s0"], x["s1"]
                for g in range((p - s1) // STEP, (p - s0) // STEP + 1):
                    d0, d1 = max(p - s1, g * STEP), min(p - s0, g * STEP + STEP - 1)
                    a = p - g * STEP
                    core = hashlib.blake2b(text[a : a + CORE] + bytes((g,)), digest_size=16).digest()
                    for k, v in enumerate((core, LENGTH - CORE, text[p - d1 : a], text[a + CORE : p - d0 + LENGTH], rid, p - d1, p - d0, x["need"])):
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, _CUT_TYPES, strict=True)], _CUT_NAMES)


#: core: a digest of the group's core and all that it was made of; more: the bytes that a string has beside it; a, z: the first and last start.
CUT = "core binary, more int, left binary, right binary, rid long, a long, z long, need boolean"
_CUT_NAMES = [x.split()[0] for x in CUT.split(", ")]
_CUT_TYPES = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def parted(core: bytes, more: int, left: bytes, right: bytes, a: int, z: int):
    """A row's strings by longer cores: those with `half` bytes or more left of the core, and the others, which have the rest right of it."""
    half = (more + 1) // 2
    most, least = len(left), len(left) - (z - a)  # bytes left of the core, in the row's first and last string
    if most >= half:
        stop = max(least, half)
        yield hashlib.blake2b(core + b"<" + left[most - half :], digest_size=16).digest(), more - half, left[: most - half], right[: more - stop], a, a + most - stop
    if least < half:
        begin = min(most, half - 1)
        side = more - half + 1
        yield hashlib.blake2b(core + b">" + right[:side], digest_size=16).digest(), half - 1, left[most - begin :], right[side:], z - (begin - least), z


def _part(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for x in b.to_pylist():
            for core, more, left, right, a, z in parted(x["core"], x["more"], x["left"], x["right"], x["a"], x["z"]):
                for k, v in enumerate((core, more, left, right, x["rid"], a, z, x["need"])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, _CUT_TYPES, strict=True)], _CUT_NAMES)


def _repeated(rows: list[dict]) -> list[list[int]]:
    """Per row, the starts (from its first) whose LENGTH bytes another row of the same core has too."""
    cores: dict[bytes, int] = {}
    strings, longs = [], []
    for x in rows:
        c = cores.setdefault(x["core"], 257 + len(cores))
        if len(cores) > len(longs):
            longs.append(LENGTH - x["more"])
        strings.append(np.concatenate((np.frombuffer(x["left"], np.uint8).astype(np.uint32) + 1, [c], np.frombuffer(x["right"], np.uint8).astype(np.uint32) + 1)))
    weights = np.ones(257 + len(cores), np.int32)
    weights[257:] = longs
    built = Columns(strings, weights).build()
    _, lcp, names = built.read()
    starts = built.ends - built.sizes
    built.close()
    hit = np.maximum(lcp, np.append(lcp[1:], 0)) >= LENGTH
    out: list[list[int]] = [[] for _ in rows]
    at = np.sort(names[hit & (names < built.ends[-1])])
    of = np.searchsorted(built.ends, at, "right")
    for i, k in zip(of.tolist(), (at - starts[of]).tolist(), strict=True):
        if k <= rows[i]["z"] - rows[i]["a"]:
            out[i].append(k)
    return out


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for k in starts:
        if out and out[-1][1] + 1 == k:
            out[-1][1] = k
        else:
            out.append([k, k])
    return [(a, z) for a, z in out]


def _order(batches):
    """Rows come sorted by core, all of one core in one task."""

    def solve(rows):
        got = [(r["rid"], r["a"] + a, r["a"] + z + LENGTH) for r, s in zip(rows, _repeated(rows), strict=True) if r["need"] for a, z in _runs(s)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(3)], ["rid", "a", "z"])

    held: list[dict] = []
    for b in batches:
        for x in b.to_pylist():
            if len(held) >= TOGETHER and x["core"] != held[-1]["core"]:
                yield solve(held)
                held = []
            held.append(x)
    if held:
        yield solve(held)


#: A piece that occurs more often is busy; so many busy pieces at most are broadcast (some 3 MB).
BUSY, SMALL = 4096, 100_000


def _shared(found: DataFrame, twice: DataFrame) -> DataFrame:
    """Occurrences with `same` of pieces that occur twice. Those of busy pieces are joined where they lie, so that none of them meets in one task; should
    there be very many busy pieces, all are dealt by piece like the others."""
    busy = twice.where(f"n > {BUSY}").select("piece", "same")
    if not 0 < busy.count() <= SMALL:
        return found.join(twice.drop("n"), "piece")
    rest = found.join(F.broadcast(busy.select("piece")), "piece", "left_anti").join(twice.where(f"n <= {BUSY}").drop("n"), "piece")
    return found.join(F.broadcast(busy), "piece").unionByName(rest)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of [start, end) byte runs) of every row.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too: in another row, or in its own (overlaps count). Texts are UTF-8
    bytes, a null text is empty; strings never cross rows. Repeated rows repeat each other. A null doc_id is a value like any other. An empty table
    gives no rows; columns other than doc_id and text aren't read. Hashes of 64 bits for anchors and again for their strings stand for their bytes in
    steps 1 and 2, and of 128 bits for cores. A text of any length is read whole, in chunks of 2 MB. However many rows share a core, a task orders HOT + TOGETHER of them at most.
    """
    docs = _keyed(docs)
    found = docs.where(F.octet_length("text") >= LENGTH).mapInArrow(lean(_anchors), "rid long, p long, s0 long, s1 long, piece long, whole long")
    found = written(found.withColumn("p", F.col("p").cast("int")).withColumn("s0", F.col("s0").cast("int")).withColumn("s1", F.col("s1").cast("int")), "anchors")
    twice = found.groupBy("piece").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1").select("piece", "n", (F.col("lo") == F.col("hi")).alias("same"))
    marked = written(_shared(found, written(twice, "pieces")), "shared")
    span = lambda df: df.select("rid", F.col("s0").alias("a"), (F.col("s1") + LENGTH).alias("z"))
    mixed = marked.where("not same")
    kinds = mixed.groupBy("piece", "whole").agg(F.count("*").alias("n"), F.min(F.struct("rid", "p", "s0", "s1")).alias("one"))
    kinds = written(kinds, "kinds")
    full = mixed.join(kinds.where("n > 1").select("piece", "whole"), ["piece", "whole"])
    border = kinds.select("one.*", (F.col("n") == 1).alias("need")).groupBy("rid").agg(F.collect_list(F.struct("p", "s0", "s1", "need")).alias("found"))
    texts = IdFilter(border.select(F.col("rid").alias("id"))).keep(docs, "rid")
    cut = written(texts.join(border, "rid").select("rid", "text", "found").mapInArrow(lean(_cut), CUT), "cut")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = span(marked.where("same")).union(span(full)).select("rid", F.col("a").cast("long").alias("a"), F.col("z").cast("long").alias("z"))
    while True:
        groups = cut.groupBy("core").agg(F.count("*").alias("n"), F.max("need").alias("any"), F.min("more").alias("more")).where("n > 1 and any").select("core", "n", "more")
        groups = written(groups, "groups")
        of = lambda some, cut=cut, groups=groups: cut.join(groups.where(some).select("core"), "core")
        spans = spans.union(of(f"more > 0 and n <= {HOT}").repartition(parts, "core").sortWithinPartitions("core").mapInArrow(lean(_order), "rid long, a long, z long"))
        # Nothing beside the core: the group's rows are one string.
        spans = spans.union(of("more = 0").where("need").select("rid", "a", (F.col("a") + LENGTH).alias("z")))
        if groups.where(f"more > 0 and n > {HOT}").isEmpty():
            break
        cut = written(of(f"more > 0 and n > {HOT}").mapInArrow(lean(_part), CUT), "cut")
    spans = written(spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans")), "spans")
    touched = IdFilter(spans.select(F.col("rid").alias("id")))

    def keep(batches):
        for b in batches:
            data, offsets = bytes_of(b.column("text"))
            size, gone, runs, sha = [], [], [], []
            for i, found in enumerate(b.column("spans").to_pylist()):
                text, merged = data[offsets[i] : offsets[i + 1]].tobytes(), []
                for x in found or ():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["z"])
                    else:
                        merged.append([x["a"], x["z"]])
                h, at = hashlib.sha256(), 0
                for a, z in merged:
                    h.update(text[at:a])
                    at = z
                h.update(text[at:])
                size.append(len(text))
                gone.append(sum(z - a for a, z in merged))
                runs.append(merged)
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    maybe, clean = touched.split(docs, "rid")
    changed = maybe.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(lean(keep), schema)
    same = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast("array<array<long>>").alias("spans"))
    return changed.union(same)
