"""Operators and the whole pipeline against plain versions that share no code with them."""

import base64
import gzip
import hashlib
import json
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import components, html, minhash, mixing, packing, pii, quality, queries, repeats, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCKS = set("address article aside blockquote body div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul head title".split())


class Article(HTMLParser):
    """The text of a page's article element, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.parts, self.skip = 0, [], [], 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "article":
            self.cut()
            self.depth += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if tag in BLOCKS:
            if self.depth:
                self.cut()
            else:
                self.parts = []
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def test_extraction_against_another_parser(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    right = 0
    for r in queries.op1_html_extraction(spark, data).collect():
        p = Article()
        p.feed(source[r.page_id] or "")
        p.cut()
        right += "\n".join(p.blocks) == r.text and r.n_chars == len(r.text)
    assert right >= 0.95 * len(source)  # the plain parser doesn't know furniture inside articles


def test_differencing_alone(spark, data):
    """Without article elements the shared lines decide: what neighbours share goes, the rest stays."""
    rows = [(i, f"https://h.example/{i}", f"<div>Site</div><div>Top {i % 2}</div><p>Own text {i}</p><p>More of {i}</p><div>End of site</div>") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Top {i % 2}\nOwn text {i}\nMore of {i}" for i in range(8)}


def test_long_pages_of_equal_lines(spark):
    page = "<p>same</p>" * 3000
    rows = [(1, "https://h/a", page), (2, "https://h/b", page + "<p>own</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "own" and got[1].count("same") == 3000  # nothing would be left of the first one


def test_derivatives_against_hashes(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    by = defaultdict(dict)
    for r in queries.op6_warc_derivatives(spark, data).collect():
        by[r.page_id][r.record_type] = r
    assert set(by) == set(pages)
    for k, of in by.items():
        body = (pages[k].html or "").encode()
        meta, text = of["metadata"], of["conversion"]
        headers, block = json.loads(meta.source_headers), json.loads(meta.block)
        assert meta.refers_to == text.refers_to == headers["WARC-Record-ID"] and meta.source_headers == text.source_headers and meta.record_id != text.record_id
        assert meta.payload_digest == text.payload_digest == headers["WARC-Payload-Digest"] == sha(body) and text.target_uri == pages[k].url
        for r in of.values():
            assert r.content_length == len(r.block.encode()) and r.block_digest == sha(r.block.encode())
        assert block["Conversion"] == text.record_id and block["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Entity-Length"] == len(body)
        assert "<" not in text.block or "&lt;" in pages[k].html


def test_broken_warc_files(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: abc\r\n\r\nrest\r\n\r\n"
    cut = gzip.compress(good + good)[:-9]
    assert [b for _, b in warc.parse(good + odd + good)] == [b"hello", b"rest\r\n\r\n", b"hello"] and [b for _, b in warc.parse(gzip.compress(good) + gzip.compress(good))] == [b"hello", b"hello"]
    assert [b for _, b in warc.parse(cut)][:1] == [b"hello"] and list(warc.parse(b"")) == [] and list(warc.parse(b"\x1f\x8bxx")) == [] and list(warc.parse(b"WARC/1.1\r\nno end")) == []
    for i, x in enumerate((good, odd, cut, b"", b"\x1f\x8b")):
        (tmp_path / f"{i}.warc").write_bytes(x)
    assert warc.read(spark, str(tmp_path)).count() >= 3
    rows = spark.createDataFrame([("conversion", None, None, None, None, None, 0, None, None, None, "xé"), ("metadata", "<i>", "<r>", "u", "d", "t", 1, "b", "p", "{}", None)], warc.RECORD)
    warc.write(rows.coalesce(1), str(tmp_path / "out"), "none")
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert [(h["WARC-Type"], b) for h, b in warc.parse(data)] == [("conversion", "xé".encode()), ("metadata", b"")]


def shares(sizes, weights=(5, 2, 1), most=3):
    """Target of each source by repeated halving of the common unit."""
    w = [weights[i % 3] for i in range(len(sizes))]
    total = min(sum(sizes), most * sum(sizes))
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(x * mid, most * s) for x, s in zip(w, sizes)) < total:
            lo = mid
        else:
            hi = mid
    return [min(x * hi, most * s) for x, s in zip(w, sizes)]


def test_mixing_against_plain_shares(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(WORD.findall((r.text or "").encode())) for r in docs}
    of = {r.doc_id: r.source for r in docs}
    whole = Counter()
    for k, n in size.items():
        whole[of[k]] += n
    names = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, shares([whole[s] for s in names])))
    got = queries.op7_source_mixing(spark, data).collect()
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == whole[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]], rel=1e-9)
        assert r.taken == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
        taken[of[r.doc_id]] += r.taken
    for s in names:
        # What is left of the target is less than any document that could still be taken.
        copies = {r.doc_id: r.taken // r.size for r in got if of[r.doc_id] == s and r.size}
        again = [size[k] for k, n in copies.items() if n == min(copies.values()) and n < 3]
        assert taken[s] <= want[s] + 1 and (not again or want[s] - taken[s] < min(again) + 1)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_source_mixing(spark, data).collect()))


def test_flow_against_a_plain_optimum():
    """Overlapping sources: as much as can be given at all, at the least cost of repetitions."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        patterns = [(tuple(sorted(set(rng.integers(0, 3, rng.integers(1, 3)).tolist()))), int(rng.integers(1, 6))) for _ in range(3)]
        quotas = rng.integers(0, 12, 3).tolist()
        give = mixing.route(patterns, quotas)
        used = [sum(g.values()) for g in give]
        assert all(u <= 3 * n for u, (_, n) in zip(used, patterns)) and all(sum(g.get(s, 0) for g in give) <= quotas[s] for s in range(3)) and all(set(g) <= set(of) for g, (of, _) in zip(give, patterns))
        cost = lambda u, n: sum(min(max(u - r * n, 0), n) * r for r in range(3))
        best = None
        top = [range(3 * n + 1) for _, n in patterns]
        for a in top[0]:
            for b in top[1]:
                for c in top[2]:
                    # Hall's condition: every set of patterns fits the sources that they reach.
                    x = (a, b, c)
                    if all(sum(x[i] for i in range(3) if m >> i & 1) <= sum(quotas[s] for s in {s for i in range(3) if m >> i & 1 for s in patterns[i][0]}) for m in range(1, 8)):
                        key = (-sum(x), sum(cost(u, n) for u, (_, n) in zip(x, patterns)))
                        best = key if best is None or key < best else best
        assert (-sum(used), sum(cost(u, n) for u, (_, n) in zip(used, patterns))) == best


def test_packing_against_a_plain_best_fit(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    words = {r.doc_id: len(WORD.findall((r.text or "").encode())) for r in docs}
    rows = queries.op8_best_fit_packing(spark, data).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_words
    assert total == Counter(words) and max(Counter({b: sum(x.n_words for x in rows if x.bin_id == b) for b in {x.bin_id for x in rows}}).values()) <= 2048
    # The tightest bin for every rest, largest first, found by looking at every bin.
    norm = lambda t: b" ".join(WORD.findall((t or "").encode().lower()))
    rest = sorted(((words[r.doc_id] % 2048, r.doc_id, r.source, norm(r.text)) for r in docs if words[r.doc_id] % 2048 or not words[r.doc_id]), key=lambda x: (-x[0], x[1]))
    bins = []
    for n, _, source, text in rest:
        fits = [b for b in bins if b["left"] >= n and b["of"][source] < 4 and text not in b["texts"]]
        if not fits:
            bins.append({"left": 2048, "of": Counter(), "texts": set()})
            fits = bins[-1:]
        b = min(fits, key=lambda x: x["left"])
        b["left"] -= n
        b["of"][source] += 1
        b["texts"].add(text)
    mine = {r.bin_id for r in rows if r.n_words < 2048}
    assert abs(len(mine) - len(bins)) <= max(1, len(bins) // 50)
    source = {r.doc_id: r.source for r in docs}
    for b in mine:
        inside = [r.doc_id for r in rows if r.bin_id == b]
        assert max(Counter(source[k] for k in inside).values()) <= 4 and len({norm(next(x.text for x in docs if x.doc_id == k)) for k in inside}) == len(inside)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(4)
    x = {0: rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)), 1: rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5)) + 0.7}
    model = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    mean, cov = {k: v.mean(0) for k, v in x.items()}, {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (80 * cov[0] + 120 * cov[1]) / 200
    z = rng.normal(size=(50, 5))
    log = []
    for k, n in ((0, 80), (1, 120)):
        s = 0.85 * cov[k] + 0.1 * np.diag(np.diag(cov[k])) + 0.05 * pooled + 1e-4 * np.eye(5)
        gap = z - mean[k]
        log.append(np.log(n / 200) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (gap * np.linalg.solve(s, gap.T).T).sum(1))
    assert model.score(z) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))
    assert (quality.Discriminant({0: (1.0, x[0][0], np.outer(x[0][0], x[0][0]))}).score(z) == 0.5).all()


def test_signatures_miss_no_pair_at_the_threshold():
    """Sets of a Jaccard index of 0.8 agree in as many coordinates as independent ones would; fewer than MATCH practically never."""
    rng, agree = np.random.default_rng(5), []
    for _ in range(2000):
        n = int(rng.integers(9, 120))
        both = rng.integers(0, 1 << 63, 8 * n, dtype=np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 1 << 63, n, dtype=np.uint64))) for _ in range(2))
        agree.append(int((minhash.signature(np.sort(a)) == minhash.signature(np.sort(b))).sum()))
    agree = np.array(agree)
    assert abs(agree.mean() / minhash.K - 0.8) < 0.01 and 2.4 < agree.std() < 4.2 and agree.min() >= minhash.MATCH


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root[x] for x in linked}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_core_is_parted(spark, monkeypatch):
    """Very many strings around one passage: each construction holds a few rows, the result is that of counting all strings."""
    monkeypatch.setattr(repeats, "HOT", 16)
    monkeypatch.setattr(repeats, "TOGETHER", 16)
    monkeypatch.setattr(repeats, "BUSY", 8)
    rng = np.random.default_rng(7)
    core = bytes(rng.integers(97, 123, 380).tolist()).decode()
    side = lambda k: "".join(chr(97 + int(x)) for x in rng.integers(0, 2, k))
    rows = [(i, side(30) + core + side(30)) for i in range(300)]
    count = Counter(t[s : s + 400] for _, t in rows for s in range(len(t) - 399))
    want = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if count[t[s : s + 400]] > 1:
                gone[s : s + 400] = True
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 0 < sum(v > 0 for v in want.values())


def test_a_very_long_text(spark):
    """Beyond the chunks of 2 MB: a repeat across a chunk's border, and thousands of addresses."""
    rng = np.random.default_rng(8)
    long = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, (2 << 20) + 5000))
    piece = long[(1 << 21) - 300 : (1 << 21) + 300]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame([(1, long), (2, "X" + piece + "Y")], "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 600, 1), 2: (602, 600, 1)}
    text = " ".join(f"u{i}@example.com" for i in range(8000))
    r = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r.base) == 8000 and (r.base[-1].start, r.base[-1].end) == (text.rindex("u7999"), len(text))


def test_spans_give_way_only_to_spans_that_stay(spark):
    rows = [(0, 10, 0.9), (8, 20, 0.8), (18, 30, 0.7), (40, 50, 0.5), (45, 60, 0.5), (100, 101, 0.1)]
    df = spark.createDataFrame([([{"start": a, "rank": 0, "end": z, "kind": "x", "score": s} for a, z, s in rows],)], f"c {pii._SCORED}")
    assert [(x.start, x.end) for x in df.select(pii._apart(F.col("c")).alias("k")).first().k] == [(0, 10), (18, 30), (40, 50), (100, 101)]


def test_spelled_addresses(spark):
    lines = ["write john.doe [at] example.com now", "mail jane_roe(at)example(dot)org please", "look at the dot on it"]
    got = pii.with_spans(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[lines[i][x.start : x.end] for x in r.spans] for i, r in enumerate(got)] == [["john.doe [at] example.com"], ["jane_roe(at)example(dot)org"], []]


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_pipeline_run_against_plain_stages(spark, data):
    """run() from end to end: documents that quality keeps, one of each brute-force group, without base personal data, in whole copies, in bins."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = {r.doc_id: r.text for r in c.good(spark, docs, data).collect()}
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(good) <= all_ids and 0.3 * len(all_ids) < len(good)
    sets = {k: shingles(t, 5) for k, t in good.items()}
    ids = sorted(good)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    first = {k for k in ids if find(k) == k}
    unique = {r.doc_id for r in c.unique(spark, c.good(spark, docs, data), data).collect()}
    assert unique == first
    out = c.run(spark, data).collect()
    seen, room = Counter(), Counter()
    for r in out:
        seen[r.doc_id] += r.n_words
        room[r.bin_id] += r.n_words
    assert set(seen) <= first and max(room.values()) <= 2048
    redacted = {r.doc_id: r.text for r in c.redacted(spark, c.unique(spark, c.good(spark, docs, data), data), data).collect()}
    for k, t in redacted.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")
        n = len(WORD.findall((t or "").encode()))
        assert (seen[k] % n == 0 and seen[k] // n <= 3) if n and k in seen else True


def test_pipeline_stages_on_odd_and_empty_tables(spark, data):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two", None, "s", 7), (3, "one two", None, "s", 7), (None, "a b c", "en", None, 5), (4, "w " * 5000, "en", "s", 10000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(1)).withColumn("size", F.lit(2))
    for name, stage in c.STAGES:
        kept = stage(spark, odd, data)
        assert kept.count() >= 0 and stage(spark, odd.limit(0), data).count() == 0
        if name != "packing":
            assert kept.columns == list(c.COLUMNS)
