"""Page and vector operators and the pipeline against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import hilbert, html, rabitq, warc

PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three&nbsp;&#233;</p><section class="comments"><p>Reader</p></section></article><form>Mail</form><footer>&copy;</footer>'


def test_lines_and_zones():
    assert [t for z, t in html.lines(PAGE) if z == html.MAIN] == ["A & B", "One two", "Three é"]
    assert html.lines("") == [] and html.lines("<<<") == [(html.PLAIN, "<<<")]


def test_common_is_longest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        i, j = html.common(a, b)
        assert len(i) == best[-1][-1] and [a[k] for k in i] == [b[k] for k in j] and i == sorted(set(i)) and j == sorted(set(j))


def test_extract(spark):
    site = lambda body: f"<body><p>Welcome to the site</p>{body}<p>All rights kept</p></body>"
    rows = [(1, "http://a.x/p/1", site("<p>First text</p>")), (2, "http://a.x/p/2", site("<p>Second text</p>")), (3, "http://b.x/", PAGE), (4, None, None), (5, "::", ""), (6, "http://c.x/1", "<p>Same</p>"), (7, "http://c.x/2", "<p>Same</p>"), (3, "http://b.x/", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).coalesce(1)
    got = {(r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got >= {(1, "First text", 10), (2, "Second text", 11), (3, "A & B\nOne two\nThree é", 21), (4, "", 0), (5, "", 0), (6, "Same", 4), (7, "Same", 4)}
    assert html.extract(df).count() == 8 and html.extract(df.limit(0)).count() == 0


def test_shared_lines_in_wrappers_go(spark):
    heads = ["<main>", "<div id=main>", '<div class="article">', '<section role="main">', '<div itemprop="articleBody">']
    rows = [(10 * h + i, f"http://{h}.x/{i}", f"<body>{head}<header><p>Head {i}</p></header><p>Site line</p><p>Body {i}</p>") for h, head in enumerate(heads) for i in range(2)]
    rows += [(90 + i, f"http://z.x/{i}", f"<main><p>Site line</p><article><p>Mirrored</p><p>Own {i}</p></article></main>") for i in range(2)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {10 * h + i: f"Head {i}\nBody {i}" for h in range(5) for i in range(2)} | {90 + i: f"Mirrored\nOwn {i}" for i in range(2)}


@pytest.mark.parametrize("neighbours", [1, 2])
def test_extract_does_not_depend_on_partitions(spark, neighbours):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for h in range(30):  # many hosts of two pages, one of twenty
        for i in range(20 if h == 7 else 2):
            n += 1
            shared = "".join(f"<p>Line {k}</p>" for k in sorted(rng.choice(6, 4, replace=False)))
            rows.append((n, f"http://{h:02}.x/{i:02}", f"<body><p>Site {h}</p>{shared}<p>Body {n}</p>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 7, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append(sorted(map(tuple, html.extract(df, neighbours).collect())))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got[0]) == len(rows) and not any("Site" in text for _, _, text, _ in got[0])
    assert got[0] == got[1] == got[2]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.x/", PAGE), (2, None, None), (3, "http://é.x/", "é" * 50)], "page_id long, url string, html string")
    source = warc.responses(df)
    got = warc.derivatives(source, ("page_id",)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(i, k) for i in (1, 2, 3) for k in ("metadata", "conversion")]
    by = {r.page_id: r for r in source.collect()}
    for r in got:
        assert r.refers_to == by[r.page_id].record_id and r.payload_digest == by[r.page_id].headers["WARC-Payload-Digest"]
        assert r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode())
        assert json.loads(r.source_headers) == by[r.page_id].headers
    assert json.loads(got[0].block)["Conversion"] == got[1].record_id
    warc.write(warc.derivatives(source), str(tmp_path / "out"))
    files = [b for p in (tmp_path / "out").glob("part-*") for b in warc.parse(p.read_bytes())]
    assert sorted((h["WARC-Record-ID"], b.decode()) for h, b in files) == sorted((r.record_id, r.block) for r in got)
    head = lambda r: "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()) + "\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc").write_bytes(b"".join(head(r).encode() + r.http + b"\r\n\r\n" for r in by.values()))
    assert sorted((r.record_id, bytes(r.http)) for r in warc.read(spark, str(tmp_path / "in")).collect()) == sorted((r.record_id, bytes(r.http)) for r in by.values())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[50:60] = x[49] + 0.01 * rng.normal(size=(10, 16))
    x[100:120] = x[99]
    x[130] = 2 * x[129]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (None, rows[0][1], 0), (904, [], 0), (905, rows[0][1][:8], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)), x


def test_nearest(vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in hilbert.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 300, 50))
    for q, found in got.items():
        s = np.round(u @ u[q], 12)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [found[k][0] for k in range(1, 6)] == want
        assert [found[k][1] for k in range(1, 6)] == pytest.approx([s[i] for i in want])


def test_nearest_of_near_copies_and_scaled_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 16))
    x[:60] = x[0] + 1e-5 * rng.normal(size=(60, 16))
    x[60:120] = x[60] * rng.uniform(0.5, 2, size=(60, 1))
    got = {}
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 240, 20):
        s = np.round(u @ u[q], 12)
        want = sorted((i for i in range(240) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q][n] for n in range(1, 6)] == want


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))
    ids = list(range(40))
    ids[1:8] = [0] * 7  # one id on eight vectors
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    rows += [rows[20], (0, rows[20][1]), rows[30], rows[30]]  # whole rows twice and thrice, and a query's id on another's vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in hilbert.nearest(df, F.col("vec_id") % 10 == 0, 5).collect())
    want = []
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for n, (q, _) in enumerate(rows):
        if q % 10 == 0:
            s = np.round(u @ u[n], 12)
            best = sorted((m for m in range(len(rows)) if rows[m][0] != q), key=lambda m: (-s[m], rows[m][0]))[:5]
            want += [(q, k + 1, rows[m][0], round(s[m], 9)) for k, m in enumerate(best)]
    assert got == sorted(want)


def test_hilbert_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_embedding_links(vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.array([min(comp[i], comp[link[i]].min(initial=i)) for i in range(300)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.near_duplicates(df).collect() if r.vec_id is not None}
    assert {i: got[i] for i in range(300)} == {i: (link[i].sum(), comp[i], comp[i] == i) for i in range(300)}
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert rabitq.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(2000, 64)), rng.normal(size=(2000, 64))))
    turn = rabitq.rotation(64, 3)
    codes, factors = rabitq.encode(x @ turn)
    got, spread = rabitq.estimate(codes, factors, y @ turn), rabitq.slack(factors, turn.shape[1])
    true = (x * y).sum(1)
    assert abs((got - true).mean()) < 0.005 and (np.abs(got - true) <= spread * np.sqrt(1 - true**2)).all()


def test_bounds_decide_pairs_rightly():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * rng.uniform(0, 1.5, size=(4000, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    turn, true = rabitq.rotation(64, 3), (x * y).sum(1)
    codes, factors = rabitq.encode(x @ turn)
    whole, step, left = rabitq.rounded(y)
    assert left == pytest.approx(np.linalg.norm(whole * step[:, None] - y, axis=1))
    below, above = rabitq.verdicts(rabitq.estimate(codes, factors, (whole * step[:, None]) @ turn), left / factors, rabitq.slack(factors, turn.shape[1]), 0.9)
    assert not (below & (true >= 0.9)).any() and not (above & (true < 0.9)).any()
    assert below[true < 0.6].mean() > 0.9


@pytest.mark.parametrize("noise", [0.05, 1.0])
def test_windows_reach_the_recall(spark, monkeypatch, noise):
    """Many ranges: near vectors in clusters need one range on either side, vectors without structure more."""
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 24))[rng.integers(0, 300, 3000)] * (noise < 1) + noise * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.withColumn("q", F.lit("x")).withColumn("o", F.lit(0)).withColumn("block", F.lit(0))  # columns that the operator names as well
    got = {}
    for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 20):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 150
    assert hilbert.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline as c

    docs, counts = spark.read.parquet(f"{data}/documents.parquet"), []
    first = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, data), "stage")
        assert docs.columns == list(c.COLUMNS)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= first
        first = set(ids)
        counts.append(len(ids))
    assert counts[1] == counts[2] and docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = c.STAGES[-1][1](spark, docs, data).toPandas()
    assert packed.groupby("bin_id")["n_words"].sum().max() <= 2048 and not packed.duplicated(["doc_id", "piece", "bin_id"]).any()
