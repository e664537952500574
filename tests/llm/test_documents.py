"""Document operators against plain versions, over the given documents and a table of odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import bwt, minhash, mixing, packing, pii, quality, repeats

LONG = " ".join(f"w{i}" for i in range(40))
ODD = [(1, None, "s"), (2, "", "s"), (3, "one two", None), (3, "one two", None), (None, LONG, "s"), (None, None, None), (4, LONG, "t"), (5, LONG.upper(), "t"), (6, "x" * 5000, "é"), (7, "ab " * 3000, "t"), (8, LONG + " and more", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(None).cast("long")).withColumn("node", F.lit(1)).withColumn("size", F.lit("x")).withColumn("spans", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which).where("doc_id is not null")
    rows = [(r.doc_id, shingles(r.text, 4)) for r in df.select("doc_id", "text").collect()]
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    got = minhash.near_duplicates(df, 4, 80).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(s), root[i], root[i] == i) for i, s in rows)


def test_second_round_returns_each_pair_once(monkeypatch):
    """Posting lists of random near-equal signatures, in chunks (one of them empty) and in cut batches, against all pairs."""
    import pyarrow as pa

    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "PAIRS", 5)
    rng = np.random.default_rng(3)
    n, names = 60, ["token", "i", "j", "own", "node", "root", "n", "mask", *minhash.ODD_BITS, "sig"]
    sig = np.where(rng.random((n, minhash.K)) < 0.3, rng.integers(0, 3, (n, minhash.K)), 9).astype(np.int32)
    posted = rng.random((n, minhash.K)) < 0.4
    root, size = rng.integers(0, 20, n), rng.integers(90, 130, n)
    mask = [int(np.packbits(p, bitorder="little").view(np.int64)[0]) for p in posted]
    rows = []
    for k in range(minhash.K):
        for v in np.unique(sig[:, k]):
            for d in np.flatnonzero((sig[:, k] == v) & posted[:, k]):
                own = int(d) % 2 * 2
                rows += [((k << 32) | int(v), min(own, o), max(own, o), own, int(d), int(root[d]), int(size[d]), mask[d], *[0] * 8, sig[d].tolist()) for o in range(3)]
    rows.sort(key=lambda r: r[:3])
    types = [pa.int64()] * 16 + [pa.list_(pa.int32())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 97], strict=True), types, strict=True)], names) for a in range(0, len(rows), 97)]
    got = [(a, b) for out in minhash.across(80)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    fits = lambda a, b: root[a] != root[b] and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]) and (sig[a] == sig[b]).sum() >= minhash.MATCH and ((sig[a] == sig[b]) & posted[a] & posted[b]).any()
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if fits(a, b)]
    assert want and sorted(got) == want


def test_transform_against_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        strings = [rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint32) for _ in range(rng.integers(1, 6))]
        built = bwt.Columns(strings, np.array([0, 1, 1, 2], np.int32)).build()
        got, lcp, _ = built.read()
        built.close()
        order = sorted(((*map(int, s[k:]), 0, j - 1000), j, k) if False else ([(int(v), 0) for v in s[k:]] + [(0, j)], j, k) for j, s in enumerate(strings) for k in range(len(s) + 1))
        assert [int(strings[j][k - 1]) if k else 0 for _, j, k in order] == got.tolist()
        weight, want = (0, 1, 1, 2), [0]
        for (a, _, _), (b, _, _) in zip(order, order[1:]):
            n = 0
            for x, y in zip(a[:-1], b[:-1]):
                if x != y:
                    break
                n += weight[x[0]]
            want.append(n)
        assert want == lcp.tolist()


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    text = "".join(chr(97 + i * i % 23) for i in range(3000))
    more = spark.createDataFrame([(101, text[:1000]), (102, "q" + text[100:499]), (103, text[100:500] + "z"), (104, "ab" * 300), (105, "a" * 399)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    count = {}
    for _, b in rows:
        for s in range(len(b) - 399):
            count[b[s : s + 400]] = count.get(b[s : s + 400], 0) + 1
    want = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        want.append((i, len(b), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    got = [tuple(r)[:5] for r in repeats.remove_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_mixing(docs, odd):
    for df in (docs, odd):
        got = mixing.mix(df, keep=("source",)).toPandas()
        again = mixing.mix(df.repartition(3), keep=("source",)).toPandas()
        assert len(got) == df.count()
        key = ["doc_id", "size", "taken"]
        assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
        assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
        by = got.fillna({"source": "￿"}).groupby("source")
        size, target, taken = by["size"].sum(), by["target"].first(), by["taken"].sum()
        assert target.tolist() == pytest.approx(mixing.targets(size.tolist()))
        assert ((taken - target).abs() <= by["size"].max()).all() and (taken <= target + 1).all()


def test_mixing_flow_with_overlap(spark):
    give = mixing.route([((0,), 10), ((1,), 10), ((0, 1), 10)], [25, 20])
    assert sum(g.get(0, 0) for g in give) == 25 and sum(g.get(1, 0) for g in give) == 20
    assert all(sum(g.values()) <= 30 for g in give) and sum(sum(g.values()) > 20 for g in give) == 0  # nobody thrice while others are taken once
    df = spark.createDataFrame([(i, "a b c", ["x", "y"] if i % 2 else ["x"]) for i in range(40)], "doc_id long, text string, tags array<string>")
    got = mixing.mix(df, "tags").toPandas()
    assert len(got) == 40 and abs(got["taken"].sum() - 120) <= 6


def test_mixing_fills_a_long_documents_gap(spark):
    rows = [(i, "w " * 100, s) for s in "ab" for i in range(200)] + [(200 + i, "w " * 15_000, s) for s in "ab" for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        got = mixing.mix(df, weights=(4, 3), seed=seed, keep=("source",)).toPandas().groupby("source")
        taken, target = got["taken"].sum(), got["target"].first()
        assert (taken <= target).all() and (taken > target - 100).all(), (seed, taken, target)


def test_packing(docs, odd):
    for df in (docs, odd):
        got = packing.pack(df, capacity=512, shard=64).toPandas()
        size = {}
        for r in df.collect():
            size.setdefault(r.doc_id, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        assert got.groupby("doc_id", dropna=False)["n_words"].sum().sum() == sum(map(sum, size.values()))
        assert got.groupby("bin_id")["n_words"].sum().max() <= 512
        assert not got.duplicated(["bin_id", "place"]).any()


def test_best_fit_takes_the_tightest_bin_without_conflict():
    rng = np.random.default_rng(2)
    sizes, source, cluster = sorted(rng.integers(0, 60, 300).tolist(), reverse=True), rng.integers(0, 3, 300).tolist(), rng.integers(0, 40, 300).tolist()
    bins, _ = packing.best_fit(sizes, source, cluster, 100, 2)
    held = []
    for s, o, c, b in zip(sizes, source, cluster, bins):
        fits = [h["left"] for h in held if h["left"] >= s and h["source"].count(o) < 2 and c not in h["cluster"]]
        if b == len(held):
            assert not fits
            held.append({"left": 100, "source": [], "cluster": []})
        else:
            assert held[b]["left"] == min(fits)
        h = held[b]
        assert h["left"] >= s and h["source"].count(o) < 2 and c not in h["cluster"]
        h["left"] -= s
        h["source"].append(o)
        h["cluster"].append(c)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii(spark, docs, odd):
    lines = ["a@b.c_d@e.f x", "1.2.3.4.5.6 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111  1111 1111 1111", "+1 (234) 555-1234, +49 1", "\U0001f600 x@y.zz é 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 " * 500, "call (555) 123-4567", "order 123-456-7890"]
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(lines, 900)), "doc_id long, text string"))
    for r in pii.with_spans(df).withColumn("red", pii.redact(F.col("text"), F.col("spans"))).collect():
        t = r.text or ""
        want = sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if holds(n, m.group()))
        assert [tuple(x) for x in r.base] == want
        assert set(r.base) <= set(r.spans)
        if not r.spans:
            assert r.red == r.text
        if r.doc_id == 906:
            assert [x.kind for x in r.spans] == ["phone"] and r.red == "call [PHONE]"
        if r.doc_id == 907:
            assert not r.spans


def test_quality(spark, data, docs, odd):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.quality(docs, labels).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all() and got["score"].between(0, 1).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.9
    assert len(quality.quality(odd, labels).collect()) == len(ODD)
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_empty_tables(odd, spark, data):
    none, labels = odd.limit(0), spark.read.parquet(f"{data}/labels.parquet")
    for out in (minhash.near_duplicates(none), repeats.remove_repeats(none), mixing.mix(none), packing.pack(none), pii.with_spans(none), quality.quality(none, labels)):
        assert out.count() == 0
