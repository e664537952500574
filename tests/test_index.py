"""A small source tree from files to dependencies, held to a golden set; storage, journal, queues and watching."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from specgraph.extraction import run as X
from specgraph.operators import graph as G
from specgraph.operators import indexing as N
from specgraph.operators import quality as Q
from specgraph.operators import references as J
from specgraph.operators import relations as R
from specgraph.operators import retrieval as A
from specgraph.operators import writing as Wr
from specgraph.operators.paths import cut
from specgraph.sources import files as S
from specgraph.streaming import watch as V

TREE = {
    "shop": {
        "package.json": '{"name": "@acme/shop", "workspaces": ["packages/*"], "dependencies": {"@acme/shared": "1"}}',
        "packages/ui/package.json": '{"name": "@acme/ui", "dependencies": {"axios": "1"}}',
        "src/controller.ts": 'import { save } from "./store";\nimport { OrderDto } from "./dto";\nexport class OrderController {\n  create(o) {\n    save(o);\n    router.post("/api/orders", o);\n    return "/api/orders/all";\n  }\n}\n',
        "src/store.ts": 'export { save as save } from "./deep/db";\nexport function other() { return 1; }\n',
        "src/deep/db.ts": "export function save(o) { return o; }\n",
        "src/dto.ts": "export interface OrderDto { id: string; }\n",
        "src/gen/api.generated.ts": 'fetch("/api/never");\n',
        "README.md": "# Shop\n\nThe OrderController calls save. See [store](src/store.ts).\n",
        "bin.ts": "a\x00b",
    },
    "web": {
        "package.json": '{"name": "web", "dependencies": {"@acme/shop": "1"}}',
        "src/client.ts": 'import axios from "axios";\nexport async function load() {\n  await axios.get("/api/orders/all");\n}\n',
        "src/bus.ts": 'import { Kafka } from "kafkajs";\nexport function on() { consumer.subscribe("order.made", f); }\n',
        "dist/out.ts": 'fetch("/api/skip");',
    },
    "mail": {"app.py": 'import kafka\n\ndef run(p):\n    p.send("Order.Made", b"")\n\ndef go():\n    return run(1)\n', "requirements.txt": "kafka-python\n"},
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for repo, files in TREE.items():
        (root / repo / ".git").mkdir(parents=True)
        for path, text in files.items():
            (root / repo / path).parent.mkdir(parents=True, exist_ok=True)
            (root / repo / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def files(spark, tree):
    out = None
    for path in S.discover(str(tree)):
        repo = path.rsplit("/", 1)[-1]
        part = S.scan(spark, path, f"repo:{repo}", include=("**/*.ts", "**/*.md", "**/*.json", "**/*.py", "**/*.txt"), ignored=("*.log", "secret/"))
        out = part if out is None else out.unionByName(part)
    return out.cache()


@pytest.fixture(scope="module")
def parsed(files):
    return X.parsed(files).cache()


def test_scan(files, tree):
    got = {(r.repo_id, r.path): r.language for r in files.collect()}
    assert ("repo:shop", "bin.ts") not in got and ("repo:shop", "src/gen/api.generated.ts") not in got and ("repo:web", "dist/out.ts") not in got
    assert got[("repo:shop", "README.md")] == "markdown" and got[("repo:mail", "app.py")] == "python" and len(got) == 12
    assert [p.rsplit("/", 1)[-1] for p in S.discover(str(tree))] == ["mail", "shop", "web"] and S.git(str(tree), "status") == ""
    assert S.changed(files, files.where("path <> 'app.py'").select("file_id", "hash")).select("path").collect()[0].path == "app.py"


def test_globs_and_ignores(spark):
    paths = ["a.ts", "x/y/a.ts", "x/a.js", "node_modules/q/a.ts", "logs/a.ts", "logs/keep.ts", "mock_a.go", "a.pb.go", "deep/tmp/z.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    ok = {r.path for r in df.where(S.wanted(F.col("path"), ("**/*.ts", "**/*.go"), ("**/node_modules/**",), ("# no", "/logs/*", "!logs/keep.ts", "tmp/"))).collect()}
    assert ok == {"a.ts", "x/y/a.ts", "logs/keep.ts"}


def test_manifests_follow_workspaces(files):
    got = {(r.path, r.name): r.dependencies for r in S.manifests(files.where("repo_id = 'repo:shop'")).collect()}
    assert set(got) == {("package.json", "@acme/shop"), ("packages/ui/package.json", "@acme/ui")} and got[("package.json", "@acme/shop")] == {"@acme/shared": "1"}


def test_golden(spark, files):
    found = cut(X.resolve_sdk(X.facts(files, cut(X.enabled(X.frameworks(files))))))
    repos = spark.createDataFrame([(f"repo:{r}", r, "") for r in TREE], "repo_id string, name string, remote string")
    every = found.unionByName(X.owners(found, repos))
    t = {k: cut(v) for k, v in X.tables(cut(every)).items()}
    relations, deps = R.rebuild(t["specs"], t["edges"], t["contracts"], t["pending"])
    named = cut(deps).join(t["contracts"].select(F.col("contract_id").alias("source_contract"), "kind", "key"), "source_contract")
    key = lambda *c: F.concat_ws("|", *c).alias("key")
    api = t["contracts"].where("kind in ('api', 'event', 'schema', 'dto')")
    roles = t["edges"].join(api, "contract_id")
    want_contracts = [("dto|OrderDto", "dto"), ("api|POST:/api/orders", "api"), ("api|/api/orders/all", "api"), ("api|GET:/api/orders/all", "api"), ("event|order.made", "event")]
    want_roles = [("repo:shop|shared|dto|OrderDto", "shared"), ("repo:shop|consumer|api|POST:/api/orders", "consumer"), ("repo:shop|producer|api|/api/orders/all", "producer"), ("repo:web|consumer|api|GET:/api/orders/all", "consumer"), ("repo:web|consumer|event|order.made", "consumer"), ("repo:mail|producer|event|order.made", "producer")]
    want_deps = [("repo:web|repo:shop|api|/api/orders/all", "api"), ("repo:web|repo:mail|event|order.made", "event"), ("repo:web|repo:shop|package|@acme/shop", "package")]
    frame = lambda rows: spark.createDataFrame(rows, "key string, type string")
    got = {
        "contracts": cut(api.select(key("kind", "key"), F.col("kind").alias("type"))),
        "participants": cut(roles.select(key("repo_id", "role", "kind", "key"), F.col("role").alias("type")).distinct()),
        "dependencies": cut(named.where("kind in ('api', 'event') or key = '@acme/shop'").select(key("from_repo", "to_repo", "type", F.regexp_replace("key", "^[A-Z]+:", "")), "type").distinct()),
    }
    score = Q.golden(got, {"contracts": frame(want_contracts), "participants": frame(want_roles), "dependencies": frame(want_deps)}, frame([("api|/api/never", "api"), ("api|/api/skip", "api")]))
    rows = {(r.subject, r.type): (r.precision, r.recall) for r in score.collect()}
    assert {k for k, _ in rows} == {"contracts", "participants", "dependencies", "absent"} and set(rows.values()) == {(1.0, 1.0)}, rows
    assert {(r.from_spec.split(":")[0], r.kind) for r in relations.collect()} == {("spec", "CALLS_ENDPOINT"), ("spec", "PUBLISHES_EVENT"), ("spec", "SUBSCRIBES_EVENT")}


def test_owners_by_alias(spark):
    names = X.C.NAMES
    row = lambda **k: tuple({"repo_id": "r", "file_id": "f", "path": "package.json", "kind": "package", "key": "", "name": "", "role": "", "line": 1, "raw": "", "rule": "", "confidence": 1.0, "spec_kind": None, "spec": None, "framework": None, "symbol": None, "refs": []}[n] if n not in k else k[n] for n in names)
    found = spark.createDataFrame([row(repo_id="repo:a", key="@x/Lib", role="owner", rule="package-json-name"), row(repo_id="repo:b", key="lib", role="consumer", rule="package-json-dependency"), row(repo_id="repo:b", key="@x/lib", role="consumer", rule="package-json-dependency"), row(repo_id="repo:b", key="none", role="consumer", rule="package-json-dependency")], X.C.FACT)
    repos = spark.createDataFrame([("repo:a", "alpha", ""), ("repo:b", "beta", "")], "repo_id string, name string, remote string")
    got = {r.key: (r.repo_id, r.rule, r.confidence) for r in X.owners(found, repos, spark.createDataFrame([("none", "repo:b")], "alias string, repo_id string")).collect()}
    assert got == {"lib": ("repo:a", "package-owner-alias", 0.7), "@x/lib": ("repo:a", "package-json-name", 1.0), "none": ("repo:b", "package-owner-alias", 0.7)}


def test_references(files, parsed):
    symbols, imports, calls = X.symbols(parsed), X.imports(parsed), X.calls(parsed)
    edges = {(r.from_file.split(":")[-1], r.to_file.split(":")[-1]) for r in J.resolve_imports(files, imports).collect()}
    assert edges == {("src/controller.ts", "src/store.ts"), ("src/controller.ts", "src/dto.ts"), ("src/store.ts", "src/deep/db.ts")}
    got = {(r.from_code.split(":")[-2], r.to_code.split(":")[-2]): (r.confidence, r.resolution) for r in J.resolve_calls(files, imports, symbols, calls).collect()}
    assert got[("OrderController.create", "save")] == (0.8, "probable")  # imported through a file that passes it on
    assert got[("go", "run")] == (0.9, "exact")
    sections = files.where("language = 'markdown'").select("repo_id", F.lit("s1").alias("section_id"), F.col("source").alias("text"))
    hit = {r.code_id.split(":")[-2] for r in J.documenting(sections, symbols).collect()}
    assert hit == {"OrderController", "save"}


def test_frameworks_gate_readers(files):
    found = {(r.repo_id, r.name) for r in X.frameworks(files).collect()}
    assert {("repo:shop", "js:package-json"), ("repo:mail", "python:kafka"), ("repo:shop", "js:axios")} - found <= {("repo:shop", "js:axios")} and ("repo:shop", "python:generic") not in found
    on = {(r.repo_id, r.reader) for r in X.enabled(X.frameworks(files), exclude=("js_event",)).collect()}
    assert ("repo:mail", "py_http") in on and ("repo:shop", "py_http") not in on and ("repo:web", "js_event") not in on


def test_plugin_facts_are_normalized(spark):
    rows = [("r", "a.x", "api", "/a", "producer", None, "raw", None, 7.0, '{"kind": "http-endpoint"}'), ("r", "a.x", "api", "", "producer", 1, "", "", 0.5, None), ("r", "a.x", "api", "/b", "boss", 1, "", "", 0.5, None)]
    got = X.normalized(spark.createDataFrame(rows, "repo_id string, path string, kind string, key string, role string, line int, raw string, rule string, confidence double, spec string")).collect()
    assert [(r.key, r.line, r.rule, r.confidence, r.spec_kind) for r in got] == [("/a", 1, "plugin", 1.0, "http-endpoint")]


def test_graph_storage_and_journal(spark, tmp_path):
    g = N.open_graph(spark, str(tmp_path / "g"))
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(RuntimeError), g.transaction():
        g.put("t", one)
        with g.transaction():
            raise RuntimeError
    assert g.get("t") is None
    with g.transaction(), g.transaction():
        g.put("t", one)
        g.put("u", one)
    assert g.get("t").collect() == one.collect() and g._manifest()["version"] == 1
    clock = iter(range(1, 100))
    j = N.Journal(g, lambda: float(next(clock)))
    a, b, c = j.begin(), j.begin(), j.begin()
    j.commit(a)
    j.fail(b, "no")
    rows = spark.createDataFrame([(a, 1), (b, 2), (c, 3), (None, 4)], "batch_id string, v int")
    assert {(r.v, r.active) for r in j.visible(rows).collect()} == {(1, None), (2, False), (3, False), (4, None)}
    assert j.recover() == [c] and {r.v for r in j.cleanup(rows).collect()} == {1, 4}
    j.cleaned()
    assert {(r.batch_id, r.status) for r in j.states().collect()} == {(a, "committed"), (b, "failed"), (c, "failed")}
    N.record_state(g, spark.createDataFrame([("r", "c1", 1), ("r", "c2", 2)], "repo_id string, commit string, finished_at int"))
    N.record_state(g, spark.createDataFrame([("q", "c3", 3)], "repo_id string, commit string, finished_at int"))
    assert {(r.repo_id, r.commit) for r in g.get("index_state").collect()} == {("r", "c2"), ("q", "c3")}
    with pytest.raises(ValueError):
        N.open_graph(spark, "x", "nowhere")
    store = N.SemanticStore(g)
    store.upsert(spark.createDataFrame([("n", [1.0])], "node_id string, embedding array<double>"))
    store.upsert(spark.createDataFrame([("n", [2.0]), ("m", [3.0])], "node_id string, embedding array<double>"))
    assert {(r.node_id, r.embedding[0]) for r in store.records().collect()} == {("n", 2.0), ("m", 3.0)}

    class Broken:
        def get(self, _):
            raise OSError("down")

    late = N.SemanticStore(Broken(), g)
    assert late.records().count() == 2 and late.events == ["down"]
    N.stage({"t": one}, str(tmp_path), "b1")
    assert spark.read.parquet(str(tmp_path / "_staging" / "b1" / "t")).first().batch_id == "b1"


@pytest.mark.parametrize("given, want", [({}, ("append-copy", True, True)), ({"changed_only": True}, ("bulk-upsert", True, True)), ({"mode": "bulk-upsert"}, ("bulk-upsert", True, False)), ({"mode": "merge"}, ("merge", False, False)), ({"batched_full": True, "empty": True}, ("bulk-copy", True, False)), ({"batched_full": True}, ("append-copy", True, False)), ({"full_copy": True}, ("bulk-copy", True, False)), ({"native": False}, ("merge", False, False))])
def test_writer_choice(given, want):
    assert N.writer(**given) == want


def test_partition_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b b", 2), ("c", 3)], "repo_id string, v int")
    Wr.bulk_copy(rows, path)
    with pytest.raises(ValueError):
        Wr.bulk_copy(rows, path)
    Wr.write_repos(rows.where("repo_id = 'a'").withColumn("v", F.lit(9)), path, ["a", "b b"])
    assert {(r.repo_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("c", 3)}
    table = spark.createDataFrame([("k", 1, "x"), ("l", 2, "y")], "k string, n int, s string")
    more = spark.createDataFrame([("k", None, "z", 1), ("k", 5, None, 2), ("m", 7, None, 1)], "k string, n int, s string, o int")
    assert {tuple(r) for r in Wr.merge_set(table, more, ["k"], "o").collect()} == {("k", 5, "z"), ("l", 2, "y"), ("m", 7, None)}


def test_stale_files_cascade(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "files": frame([("r", "f1", None), ("r", "f2", None), ("q", "f3", None)], "repo_id string, file_id string, active boolean"), "code": frame([("c1", "f1"), ("c2", "f2")], "code_id string, file_id string"),
        "calls": frame([("c1", "c2"), ("c2", "c2")], "from_code string, to_code string"), "evidence": frame([("e1", "f1")], "evidence_id string, file_id string"), "edges": frame([("e1",), ("e2",)], "evidence_id string"),
        "deps": frame([("q", "r"), ("r", "q")], "from_repo string, to_repo string"),
    }
    out, stale = Wr.stale_marked(tables, frame([("r", "f2")], "repo_id string, file_id string"), frame([("r",), ("q",)], "repo_id string"))
    assert {r.file_id for r in stale.collect()} == {"f1", "f3"}
    off = lambda name, key: {r[key] for r in out[name].where("active = false").collect()}
    assert off("files", "file_id") == {"f1", "f3"} and off("code", "code_id") == {"c1"} and off("calls", "from_code") == {"c1"} and off("edges", "evidence_id") == {"e1"} and off("deps", "from_repo") == {"q"}


def test_queues():
    now = [0.0]
    q = N.Queue(5, lambda: now[0])
    go = threading.Event()
    first, second = q.add("one", lambda: go.wait(5)), q.add("two", lambda: 1 / 0, "watch")
    while not q.status()["running"]:
        time.sleep(0.01)
    now[0] = 6.0
    s = q.status()
    assert s["running"]["stuck"] and [j["label"] for j in s["pending"]] == ["two"]
    go.set()
    assert first.result(5) is True
    with pytest.raises(ZeroDivisionError):
        second.result(5)
    assert (q.completed, q.failed, q.last_failed["label"]) == (1, 1, "two")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("again")
        return "ok"

    def bad():
        raise ValueError("bad")

    got = N.run_all([flaky, bad, lambda: 3], 2)
    assert got[0] == "ok" and isinstance(got[1], ValueError) and got[2] == 3
    with pytest.raises(ValueError):
        N.run_all([bad], abort=True)


def test_flushes_share_one_timer(spark):
    t = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("a", "x", t(0)), ("b", "y", t(1500)), ("a", "x", t(3400)), ("a", "z", t(5400)), ("a", "x", t(20000))]
    got = sorted((r.flush, r.repo, r.path, r.n) for r in V.flushes(spark.createDataFrame(rows, "repo string, path string, ts timestamp")).collect())
    assert got == [(1, "a", "x", 2), (1, "b", "y", 1), (2, "a", "z", 1), (3, "a", "x", 1)]
    assert [V.clamped(x) for x in (None, 5, 10**9)] == [2000, 100, 60000]


def test_routes_and_filters(spark):
    roots = spark.createDataFrame([("a", "/w/a"), ("in", "/w/a/in/"), ("b", "/w/b")], "repo string, root string")
    paths = ["/w/a/x.ts", "/w/a/in/y.ts", "/w/ab/z.ts", "/w/b/q.log", "/w/b"]
    got = {(r.repo, r.path) for r in V.routed(spark.createDataFrame([(p,) for p in paths], "path string"), roots).collect()}
    assert got == {("a", "x.ts"), ("in", "y.ts"), ("b", "q.log")}
    assert [r.path for r in V.filtered(spark.createDataFrame([("x.ts",), ("q.log",), ("dist/a.ts",), ("a.min.js",)], "path string")).collect()] == ["x.ts"]


def test_a_watch_drops_nothing(spark, tmp_path):
    src = str(tmp_path / "events")
    schema = "repo string, path string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put(("a", "x", t), ("a", "y", t))
    seen, status = [], V.Status()

    def sync(repo, paths):
        seen.append((repo, tuple(paths)))
        if len(seen) == 1:
            raise OSError("first one fails")

    q = V.watch(spark.readStream.schema(schema).parquet(src), sync, str(tmp_path / "c"), 300, status)
    try:
        deadline = time.time() + 150
        while len(seen) < 1 and time.time() < deadline:
            time.sleep(0.2)
        put(("a", "late", t - dt.timedelta(days=400)))  # older than anything before it
        while not any("late" in paths for _, paths in seen) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        q.stop()
    assert seen[0] == ("a", ("x", "y")) and {"late", "x", "y"} <= {p for _, paths in seen[1:] for p in paths} and status.state == "active"


def test_failures_pause_a_repository():
    s = V.Status()
    for n in range(4):
        s.synced("a", {f"f{n}"}, lambda *_: 1 / 0)
    assert s.paused == {"a"} and s.failures["a"] == 3 and s.kept["a"] == {"f0", "f1", "f2", "f3"} and s.state == "partial"
    s.trouble(OSError(24, "too many"))
    assert s.state == "degraded"
    with pytest.raises(OSError):
        s.trouble(OSError(5, "io"))
    assert V.may_watch("/mnt/c/x", {}, wsl=True)[0] is False and V.may_watch("/mnt/data", {}, wsl=True)[0] and not V.may_watch("/x", {"SPECGRAPH_NO_WATCH": "1"})[0] and V.may_watch("/mnt/c/x", {"SPECGRAPH_FORCE_WATCH": "1"}, wsl=True)[0]
    assert V.may_watch_any([], {})[0] is False
    ran = []
    V.catch_up("blocking", lambda: ran.append(1), lambda f: None)
    V.catch_up("background", lambda: ran.append(2), lambda f: f())
    V.catch_up("off", lambda: ran.append(3), lambda f: f())
    assert ran == [1, 2]


def test_questions(spark):
    asked = {"who uses it": "impact", "the ref here": "impact", "prefer": "general", "create it": "workflow", "what imports x": "dependency", "a bug": "debugging", "a class": "symbol"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.k for r in df.select("q", A.question_kind(F.col("q")).alias("k")).collect()} == asked == {q: A.plan(q)[0] for q in asked}
    q = "Why does GET /api/orders/{id}, or api:/x/y. fail? 订单"
    assert A.plan(q)[1] == ["Why", "does", "GET", "api", "orders", "id", "or", "api", "fail", "订单"] and A.contract_targets(q) == ["/x/y", "/api/orders/{id}"]
    one = spark.createDataFrame([(q,), ("?",)], "q string").select(A.terms(F.col("q")).alias("t"), A.targets(F.col("q")).alias("g")).collect()
    assert one[0].t == A.plan(q)[1] and one[0].g == A.contract_targets(q) and one[1].t == ["?"]
    text = spark.createDataFrame([("UserService sends OrderEvent to Order; a Promise, User.",)], "t string").select(A.entities(F.col("t")).alias("e")).first().e
    assert text == ["UserService", "OrderEvent", "Order", "User"]


def test_records_and_embeddings(spark):
    repos = spark.createDataFrame([("r", "r", "/r", "ts", None)], "repo_id string, name string, path string, language string, summary string")
    files = spark.createDataFrame([("r", "f", "a.ts", "typescript"), ("r", "d", "a.md", "markdown")], "repo_id string, file_id string, path string, language string")
    code = spark.createDataFrame([("c", "r", "f", "class", "UserService", "class UserService", None)], "code_id string, repo_id string, file_id string, kind string, qualified_name string, signature string, summary string")
    sections = spark.createDataFrame([("s", "r", "d", "Head", 1, None, "text")], "section_id string, repo_id string, file_id string, heading string, level int, summary string, text string")
    count = lambda level: {r.node_kind: r["count"] for r in A.records(repos, files, code, sections, level).groupBy("node_kind").count().collect()}
    assert count("all") == {"System": 1, "Repo": 1, "File": 2, "Section": 1, "Code": 1, "Entity": 1} and count("off") == {} and count("docs") == {"System": 1, "Repo": 1, "File": 1, "Section": 1, "Entity": 1} and count("code") == {"Code": 1, "Section": 1, "Entity": 1}
    now = A.records(repos, files, code, sections).select("node_id", "source_text", "source_hash")
    before = now.where("node_id in ('c', 's')").withColumn("embedding", F.when(F.col("node_id") == "c", F.array(F.lit(5.0))).otherwise(F.array().cast("array<double>"))).select("node_id", "source_hash", "embedding")
    got = {r.node_id: (r.embedding[0], r.reused) for r in A.embedded(now, before, lambda texts: [[float(len(t))] for t in texts], 2).collect()}
    assert got["c"] == (5.0, True) and got["s"] == (float(len("Head\ntext")), False) and len(got) == 7


def test_context_skips_what_does_not_fit(spark):
    rows = [("q", "contract", 0, 1.0, "exact", "x" * 3000), ("q", "code", 1, None, None, "small"), ("q", "section", 2, None, None, "y" * 700), ("q", "semantic", 3, 0.5, None, "tiny"), ("q", "code", 4, None, None, " ")]
    df = A.scored(spark.createDataFrame(rows, "query_id string, kind string, seq int, confidence double, resolution string, body string").withColumn("location", F.lit("a:1")))
    got = A.packed(df, 1000, 600).collect()
    assert [(r.citation, r.score) for r in got] == [("C1", 132.0), ("C2", 70.0), ("C4", 45.0)] and "[TRUNCATED]" in got[0].content and sum(len(r.content) for r in got) <= 1000
    assert A.answer("Q?", got).startswith("# Q?\n\nFound 1 contract, 1 code, 1 semantic.") and "No matching" in A.answer("Q?", [])


def test_provider_policy():
    pauses, n = [], []
    p = A.Policy(sleep=pauses.append, max_calls=3, max_chars=10)

    def busy():
        n.append(1)
        if len(n) < 3:
            raise A.ProviderError(A.error_kind(429))
        return "done"

    assert p.call(busy, 4) == "done" and len(pauses) == 2 and pauses[0] < pauses[1] and p.retried == 2
    with pytest.raises(A.ProviderError) as e:
        p.call(lambda: (_ for _ in ()).throw(A.ProviderError(A.error_kind(401))))
    assert e.value.kind == "auth" and len(pauses) == 2
    with pytest.raises(A.ProviderError, match="budget"):
        p.call(lambda: 1, 7)
    assert [A.error_kind(s, m) for s, m in ((503, ""), (None, "request timed out"), (400, ""))] == ["server", "timeout", "client"]


def test_retrieval_and_graph_reads(spark):
    repos = spark.createDataFrame([("r", "shop", "ts", None)], "repo_id string, name string, language string, summary string")
    files = spark.createDataFrame([("r", "f", "src/order.ts", None), ("r", "g", "old.ts", False)], "repo_id string, file_id string, path string, active boolean")
    code = spark.createDataFrame([("c1", "f", "order", "Shop.order", "fn order()", "Orders.", None), ("c2", "f", "pay", "Shop.pay", "fn pay()", "", None), ("c3", "g", "order", "x.order", "", "", None)], "code_id string, file_id string, name string, qualified_name string, signature string, summary string, active boolean")
    sections = spark.createDataFrame([("s1", "f", "Order flow", "how", "long text", 1, 2, None)], "section_id string, file_id string, heading string, summary string, text string, start_line int, end_line int, active boolean")
    contracts = spark.createDataFrame([("k", "api", "GET:/api/order", "n")], "contract_id string, kind string, key string, name string")
    edges = spark.createDataFrame([("r", "k", "producer", "e", 3, 0.9, None)], "repo_id string, contract_id string, role string, evidence_id string, line int, confidence double, active boolean")
    calls = spark.createDataFrame([("c1", "c2", 0.8, "", "pay()", None)], "from_code string, to_code string, confidence double, resolution string, raw string, active boolean")
    deps = spark.createDataFrame([("r", "q", "api", "k", "e", 0.9)], "from_repo string, to_repo string, type string, contract_id string, evidence_id string, confidence double")
    none = lambda s: spark.createDataFrame([], s)
    t = {
        "repos": repos, "files": files, "code": code, "sections": sections, "contracts": contracts, "edges": edges, "deps": deps, "calls": calls,
        "mentions": spark.createDataFrame([("Order", "r", "code", "Shop.order", "src/order.ts", 1, "", "sig", 0.6, None)], "entity_name string, repo_id string, source_kind string, name string, path string, line long, text string, evidence string, confidence double, active boolean"),
        "contract_mentions": none("entity_name string, repo_id string, kind string, key string, contract_name string, role string, path string, line long, evidence string, confidence double, active boolean"),
        "operations": none("entity_name string, repo_id string, verb string, description string, role string, confidence double, active boolean"), "workflows": none("entity_name string, repo_id string, name string, description string, step int, role string, confidence double, active boolean"),
    }
    found = A.retrieve("workflow of order at /api/order", t)
    assert found["kind"] == "workflow" and {r.code_id for r in found["code"].collect()} == {"c1", "c2"} and [r.section_id for r in found["sections"].collect()] == ["s1"] and found["contracts"].count() == 1 and found["dependencies"].count() == 1 and found["entities"].count() == 1
    assert [(r.from_name, r.to_name, r.resolution) for r in found["edges"].collect()] == [("Shop.order", "Shop.pay", "probable")]
    context = A.packed(A.candidates(found)).collect()
    assert [r.kind for r in context] == ["contract", "dependency", "entity", "call-edge", "code", "section"] or {r.kind for r in context} == {"contract", "dependency", "entity", "call-edge", "code", "section"}
    assert G.has_symbol(code, "Shop.pay") and not G.has_symbol(code, "nothing") and G.stats(repos, files, code, sections, none("x int"), contracts, edges).first().files == 1
    docs = spark.createDataFrame([("s1", "c1", None)], "section_id string, code_id string, active boolean")
    assert G.sections_documenting(repos, files, sections, docs, spark.createDataFrame([("c1",)], "code_id string")).count() == 1 and G.find_impact(repos, files, code, "fn pay").count() == 1
    assert A.summaries(repos, files, code.withColumn("repo_id", F.lit("r")), edges.join(contracts, "contract_id")).first().summary == "shop (ts): 2 files, 3 symbols. Produces: GET:/api/order."
