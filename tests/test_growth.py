"""What the work of a query grows with: rows that its joins make, and results equal to those of plain versions where the method is another."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from specgraph.operators import dependencies as D
from specgraph.operators import impact as I
from specgraph.operators import matching as M
from specgraph.operators import quality as Q
from specgraph.operators import references as J


def nodes(plan):
    """All operators of an executed plan, with those of its stages."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def ran(df):
    """The rows of df, and of each join that ran its class and how many rows it made."""
    rows = df.collect()
    joins = [x for x in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in x.getClass().getSimpleName()]
    return rows, [(x.getClass().getSimpleName(), x.metrics().apply("numOutputRows").value()) for x in joins if x.metrics().contains("numOutputRows")]


def most(joins):
    return max(n for _, n in joins)


def test_repositories_meet_once_a_topic(spark):
    dice = random.Random(5)
    rows = [(f"e{i}", f"r{dice.randrange(3)}", f"k{i % 2}", dice.choice(["producer", "consumer", "shared", "owner"]), f"T{i % 2} ", dice.choice(["a", "b", "c", "d", None])) for i in range(40)]
    rows += [("n1", "r1", "k9", "producer", None, "a"), ("n2", "r2", "k9", "consumer", None, "a"), ("x1", "r1", "k5", "producer", "u", "a"), ("x2", "r2", "k5", "consumer", "u", "b")]
    specs = spark.createDataFrame(rows, "spec_id string, repo_id string, contract_id string, role string, topic string, payload string")
    want = {tuple(r) for r in D.semantic(M.event(specs).withColumn("evidence_id", F.col("from_spec")), specs).collect()}
    assert {tuple(r) for r in D.events(specs).collect()} == want and {r[-1] for r in want} == {0.85, 0.95}


def test_deps_semantic_makes_no_pairs_of_payloads(spark, tmp_path):
    from specgraph.catalogue import queries

    rows = spark.range(2400).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"), F.lit("a").alias("event_type"), F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"))
    rows.where("event_id % 50 = 0").write.parquet(f"{tmp_path}/events.parquet")
    got, joins = ran(queries()["deps_semantic"](spark, str(tmp_path)))
    assert {(r.from_repo, r.to_repo, r.confidence) for r in got} == {("u:0", "u:2", 0.85), ("u:2", "u:0", 0.85)} and most(joins) <= 2  # 256 pairs of payloads


def specs_of(spark, rows):
    return spark.createDataFrame(rows, "spec_id string, repo_id string, role string, method string, path string")


def test_http_equals_a_comparison_of_all_pairs(spark):
    dice = random.Random(3)
    paths = ["/".join([""] + [dice.choice(["a", "B", "7", "{id}", "{x", "a{b}"]) for _ in range(dice.randrange(4))]) or "/" for _ in range(90)]
    rows = [(f"s{i}", f"r{dice.randrange(4)}", dice.choice(["producer", "consumer", "shared", "owner"]), dice.choice([None, "GET", "POST"]), p) for i, p in enumerate(paths + [None])]
    parts = lambda p: [s for s in p.lower().split("/") if s]
    is_open = lambda s: s.startswith("{") and s.endswith("}") and len(s) > 2
    pairs = {}
    for c, p in itertools.product(rows, rows):
        if c[2] in ("consumer", "shared") and p[2] != "consumer" and c[1] != p[1] and c[4] and p[4] and (c[3] is None or p[3] is None or c[3] == p[3]):
            a, b = parts(c[4]), parts(p[4])
            of_c, of_p = any(map(is_open, a)), any(map(is_open, b))
            if c[4].lower() == p[4].lower():
                kind, rank = ("exact", 0) if c[3] and c[3] == p[3] else ("path-only", 1)
            elif len(a) == len(b) and (of_c or of_p) and all(x == y or is_open(x) or is_open(y) for x, y in zip(a, b, strict=True)):
                kind, rank = ("static-to-template" if of_c != of_p else "template-compatible"), 2
            else:
                continue
            pairs.setdefault((c[0], p[1]), []).append((rank, c[0], p[0], kind))
    want = {r[1:] for of in pairs.values() for r in of if r[0] == min(of)[0]}
    got = M.http(specs_of(spark, rows)).collect()
    assert {(r.consumer, r.producer, r.kind) for r in got} == want and len(got) == len(want) > 100


def test_http_pairs_no_paths_that_dont_fit(spark):
    rows = [(f"c{i}", "web", "consumer", None, f"/en/{i}") for i in range(60)] + [(f"p{i}", "api", "producer", None, f"/en/{i + 1000}") for i in range(60)]
    got, joins = ran(M.http(specs_of(spark, [*rows, ("t", "api", "producer", None, "/en/{id}")])))
    assert {(r.consumer, r.producer) for r in got} == {(f"c{i}", "t") for i in range(60)} and most(joins) <= 121  # 3,600 pairs of the bucket


def busy(spark, kind):
    """200 consumers and 100 producers of one key, in two repositories."""
    rows = [(f"s{i}", f"r{i % 2}", "producer" if i % 3 == 0 else "consumer", "T", "m" if i % 5 else "*") for i in range(300)]
    df = spark.createDataFrame(rows, "spec_id string, repo_id string, role string, name string, method string")
    return {
        "event": lambda: M.event(df.select("*", F.col("name").alias("topic"), F.col("method").alias("payload"))),
        "rpc": lambda: M.rpc(df.select("*", F.col("name").alias("service"), F.lit(None).cast("string").alias("package"))),
        "exact_key": lambda: M.exact_key(df.withColumn("key", F.col("name"))),
        "dubbo": lambda: M.dubbo(df.select("*", F.col("name").alias("interface"), F.lit("").alias("group"), F.lit("").alias("version"))),
    }[kind](), rows


@pytest.mark.parametrize("kind", ["event", "rpc", "exact_key", "dubbo"])
def test_a_busy_key_is_dealt_over_tasks_and_never_sorted(spark, kind):
    df, rows = busy(spark, kind)
    fits = {"rpc": lambda p, c: p == c, "dubbo": lambda p, c: p == c or "*" in (p, c)}.get(kind, lambda p, c: True)
    want = {(c[0], p[0]) for p, c in itertools.product(rows, rows) if p[2] == "producer" and c[2] == "consumer" and p[1] != c[1] and fits(p[4], c[4])}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, joins = ran(df)
        tasks = df.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = [(r[1], r[0]) for r in got if r[2] == "PUBLISHES_EVENT"] if kind == "event" else [tuple(r[:2]) for r in got]
    assert set(pairs) == want and len(pairs) == len(want) and {x for x, _ in joins} == {"ShuffledHashJoinExec"} and tasks > 2


def test_caller_equals_a_look_at_every_symbol(spark):
    dice = random.Random(7)
    symbols = [(f"s{i:02}", dice.choice("ab"), a, a + dice.randrange(-1, 40)) for i, a in enumerate(dice.randrange(-3, 60) for _ in range(60))]
    calls = [(i, dice.choice("abc"), dice.choice([None, *range(-5, 100)])) for i in range(150)]
    got, joins = ran(J.caller(spark.createDataFrame(calls, "call_id int, file_id string, line int"), spark.createDataFrame(symbols, "code_id string, file_id string, start_line int, end_line int")))
    want = {i: min(((e - s, code) for code, f, s, e in symbols if f == file and s <= line <= e), default=(0, None))[1] if line is not None else None for i, file, line in calls}
    assert {r.call_id: r.caller for r in got} == want and len(got) == len(calls)


def test_a_call_does_not_meet_the_symbols_of_its_file(spark):
    symbols = spark.range(400).select(F.col("id").alias("code_id"), F.lit("f").alias("file_id"), F.col("id").alias("start_line"), (F.col("id") + 300).alias("end_line"))
    calls = spark.range(500).select(F.lit("f").alias("file_id"), F.col("id").alias("line"))
    got, joins = ran(J.caller(calls, symbols))
    assert [r.caller for r in sorted(got)] == [max(0, n - 300) for n in range(500)] and most(joins) <= 500 * 9  # 200,000 pairs


def test_imports_look_up_one_key(spark):
    from specgraph.operators.documents import resolved

    dice = random.Random(9)
    paths = ["a.ts", "lib/a.ts", "lib/a", "lib/b/index.ts", "lib/b.vue", "lib/b/index", "x/y/a.js", "x/.env.ts", "b/index.js", "lib/.ts", "/abs/a.ts", "x//d.ts"]
    files = spark.createDataFrame([(r, f"{r}{i}", p, "typescript") for r in "rs" for i, p in enumerate(paths)], "repo_id string, file_id string, path string, language string")
    modules = ["./a", "../a", "./b", "../lib/b", "../lib/a.ts", "./b/index", "../../lib/b", ".", "..", "./", "./.env", "..a", "./a#x", "./a?x=1", ".//a", "./b/../a", "./../a", "../../a", "./y/./a", "b", "./b/index.ts", "../abs/a", "./d"]
    rows = [(f"{dice.choice('rs')}{dice.randrange(len(paths))}", m, f"import {m}") for m in modules for _ in range(12)]
    imports = spark.createDataFrame(rows, "file_id string, module string, raw string")
    base = imports.join(files, "file_id").where("module like '.%'").select("repo_id", "file_id", "module", resolved(F.col("path"), F.col("module")).alias("b")).distinct().collect()
    known = {(r.repo_id, r.path): r.file_id for r in files.collect()}
    want = {(r.file_id, r.module): next(known[(r.repo_id, r.b + s)] for s in J.SUFFIXES if (r.repo_id, r.b + s) in known) for r in base if r.b is not None and any((r.repo_id, r.b + s) in known for s in J.SUFFIXES)}
    got, joins = ran(J.resolve_imports(files, imports))
    assert {(r.from_file, r.module): r.to_file for r in got} == want and len(got) == len(want) > 60 and most(joins) <= len(rows)  # eleven rows of each import before


def symbols_and_calls(spark):
    dice = random.Random(11)
    files = [(dice.choice("rs"), f"f{i}", f"f{i}.ts", "typescript") for i in range(8)]
    repo = {f: r for r, f, _, _ in files}
    symbols = []
    for i in range(70):
        f, name = dice.choice(files)[1], dice.choice("abc")
        symbols.append((f"s{dice.randrange(1000):03}-{i}", repo[f], f, name, dice.choice([name, f"C.{name}", "a", "C.b"]), "method", i, i))
    calls = [(s[2], dice.choice("abcd"), None, s[6], f"raw {s[0]}") for s in symbols]
    imports = [(dice.choice(files)[1], f"./f{dice.randrange(8)}", f"import {i}", i, []) for i in range(14)]
    return files, symbols, calls, imports


def test_resolved_calls_equal_a_look_at_every_symbol(spark):
    files, symbols, calls, imports = symbols_and_calls(spark)
    repo = {f: r for r, f, _, _ in files}
    linked = {(f, m[2:]) for f, m, *_ in imports if repo[f] == repo[m[2:]]}
    want = {}
    for (code, *_), (file, callee, _, _, raw) in zip(symbols, calls, strict=True):
        found = []
        for to, r, f, name, full, *_ in symbols:
            if to != code and callee in (name, full.split(".")[-1]):
                known = name == callee or full.endswith(f".{callee}")
                score = min(4 * known + 4 * (f == file) + 3 * ((file, f) in linked) + (r == repo[file]), 10)
                found.append((-score, (file, f) not in linked, f != file, to))
        if found and min(found)[0] <= -4:
            want[code] = (min(found)[3], -min(found)[0] / 10)
    frames = [spark.createDataFrame(rows, of) for rows, of in ((files, "repo_id string, file_id string, path string, language string"), (imports, "file_id string, module string, raw string, line int, bindings array<struct<local:string,imported:string,kind:string>>"), (symbols, "code_id string, repo_id string, file_id string, name string, qualified_name string, kind string, start_line int, end_line int"), (calls, "file_id string, callee string, receiver string, line int, raw string"))]
    got = J.resolve_calls(*frames).collect()
    assert {r.from_code: (r.to_code, r.confidence) for r in got} == want and len(got) == len(want) > 40


def test_calls_of_a_common_name_meet_few_symbols(spark):
    symbols = spark.range(300).select(F.col("id").alias("code_id"), F.lit("r").alias("repo_id"), (F.col("id") % 30).alias("file_id"), F.lit("a").alias("name"), F.lit("a").alias("qualified_name"), F.lit("function").alias("kind"), F.col("id").alias("start_line"), F.col("id").alias("end_line"))
    files = spark.range(30).select(F.lit("r").alias("repo_id"), F.col("id").alias("file_id"), F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"))
    calls = symbols.select("file_id", F.lit("a").alias("callee"), F.lit(None).cast("string").alias("receiver"), F.col("start_line").alias("line"), F.concat(F.lit("c"), "code_id").alias("raw"))
    none = spark.createDataFrame([], "file_id long, module string, raw string, line int, bindings array<struct<local:string,imported:string,kind:string>>")
    got, joins = ran(J.resolve_calls(files, none, symbols, calls))
    assert len(got) == 300 and all(r.to_code == r.from_code % 30 + 30 * (r.from_code < 30) for r in got) and most(joins) <= 3000  # 90,000 pairs


def test_sections_meet_names_once(spark):
    sections = spark.createDataFrame([("r", f"s{i}", f"All about Buildings and {'mach' * (i % 2)}") for i in range(40)] + [("q", "t", "building"), ("r", "u", None), ("r", "v", "ab")], "repo_id string, section_id string, text string")
    rows = [("r", f"c{i}", "Building", "x.Building") for i in range(30)] + [("r", "m", "mach", "Build"), ("r", "n", "ab", None), ("q", "o", "BUILDING", "ild")]
    names, text = {r[1]: r for r in rows}, {r.section_id: r for r in sections.collect()}
    want = {(s, k) for s, x in text.items() for k, (repo, _, a, b) in names.items() if repo == x.repo_id and x.text and any(n and len(n) > 2 and n.lower() in x.text.lower() for n in (a, b))}
    got, joins = ran(J.documenting(sections, spark.createDataFrame(rows, "repo_id string, code_id string, name string, qualified_name string")))
    assert {(r.section_id, r.code_id) for r in got} == want and len(got) == len(want) and sorted(n for _, n in joins)[-2] <= 200  # 2,400 pairs before the last join


def graph(spark, n=40):
    """Specs of which some have two homes, and relations; with the inner calls as (entry, consumer) and their consumers' best relation."""
    dice = random.Random(13)
    specs = [(i, dice.choice("rs"), dice.choice(["f", "g", None]), dice.choice(["http-endpoint", "event", "grpc-method"]), dice.choice(["x", "y", None])) for i in range(n)]
    specs += [(i, dice.choice("rs"), "f", dice.choice(["http-endpoint", "grpc-method"]), "x") for i in range(0, n, 4)]
    relations = sorted({(dice.randrange(n), dice.randrange(n), dice.choice(["CALLS_ENDPOINT", "PUBLISHES_EVENT", "USES_SCHEMA", "SUBSCRIBES_EVENT", "IMPLEMENTS"]), dice.choice([0.6, 0.7, 0.9])) for _ in range(2 * n)})
    used = {}
    for a, b, kind, sure in relations:
        if kind in ("CALLS_ENDPOINT", "SUBSCRIBES_EVENT"):
            used[a] = max(used.get(a, (0.0, 0)), (sure, b))
    inner = {(e[0], m[0]) for e in specs for m in specs if m[0] in used and e[0] != m[0] and e[3] != "grpc-method" and e[2] and e[4] and (e[1], e[2], e[4]) == (m[1], m[2], m[4])}
    frames = spark.createDataFrame(relations, "from_spec int, to_spec int, kind string, confidence double"), spark.createDataFrame(specs, "spec_id int, repo_id string, file_id string, spec_kind string, action string")
    return *frames, relations, used, inner


def test_inner_calls_come_once(spark):
    relations, specs, _, used, inner = graph(spark)
    got = M.internal_calls(relations, specs).collect()
    assert {(r.from_spec, r.to_spec) for r in got} == inner and len(got) == len(inner) > 20
    assert all((r.via_from, r.via_to, r.confidence) == (r.to_spec, used[r.to_spec][1], min(used[r.to_spec][0], 0.75)) for r in got)


def test_impact_equals_a_walk_over_all_pairs(spark):
    relations, specs, known, used, inner = graph(spark)
    steps = []
    for a, b, kind, sure in known:
        if kind != "IMPLEMENTS":
            steps.append(((b, a) if kind != "PUBLISHES_EVENT" else (a, b)) + ((False, -sure, kind), (a, b, sure)))
    for e, m in inner:
        sure = min(used[m][0], 0.75)
        steps.append((m, e, (True, -sure, "INTERNAL_CALL"), (m, used[m][1], sure)))
        steps += [(e, b, (True, -min(s, 0.75), "INTERNAL_CALL"), (m, b, min(s, 0.75))) for a, b, kind, s in known if a == m and kind in ("CALLS_ENDPOINT", "SUBSCRIBES_EVENT")]
    want, front = {3: (0, None), 5: (0, None)}, [3, 5]
    for hop in (1, 2):
        met = {}
        for x, y, first, then in steps:
            if x in front and y not in want:
                met[y] = min(met.get(y, (first, x, then)), (first, x, then))
        want |= {y: (hop, of) for y, of in met.items()}
        front = list(met)
    starts = spark.createDataFrame([(3,), (5,)], "spec_id int")
    got, more = I.propagate(relations, specs, starts, 2)
    assert {r.spec_id: (r.hop, r.hop and ((r.inferred, -r.confidence, r.kind), int(r.via), (r.via_from, r.via_to, r.confidence)) or None) for r in got.withColumn("via_from", F.col("via_from").cast("int")).withColumn("via_to", F.col("via_to").cast("int")).collect()} == want and len(want) > 12
    assert more == any(x in front and y not in want for x, y, *_ in steps)


def test_trace_equals_a_walk_over_all_pairs(spark):
    relations, specs, known, _, inner = graph(spark)
    every = {(a, b, kind, False) for a, b, kind, _ in known} | {(e, m, "INTERNAL_CALL", True) for e, m in inner}
    nodes, edges = {3: (0, "target")}, {}
    more = False
    for i, role in ((0, "downstream"), (1, "upstream")):
        seen, front = {3}, {3}
        for hop in (1, 2):
            for x in every:
                if x[i] in front:
                    edges.setdefault(x, (hop, ("outgoing", "incoming")[i]))
            front = {x[1 - i] for x in every if x[i] in front} - seen
            seen |= front
            for y in front:
                nodes.setdefault(y, (hop, role))
        more |= any(x[i] in front for x in every)
    got, walked, further = I.trace(relations, specs, spark.createDataFrame([(3,)], "spec_id int"), 2)
    assert {r.spec_id: (r.hop, r.role) for r in got.collect()} == nodes and further == more and len(nodes) > 10
    assert {(r.from_spec, r.to_spec, r.kind, r.inferred): (r.hop, r.direction) for r in walked.collect()} == edges


def test_walks_write_no_pairs_of_internal_calls(spark, monkeypatch):
    n = 90
    specs = spark.range(n).select(F.col("id").alias("spec_id"), F.lit("r").alias("repo_id"), F.lit("f").alias("file_id"), F.lit("event").alias("spec_kind"), F.lit("x").alias("action"))
    relations = spark.range(n).select(F.col("id").alias("from_spec"), F.lit(0).cast("long").alias("to_spec"), F.lit("CALLS_ENDPOINT").alias("kind"), F.lit(0.9).alias("confidence"))
    written, cut = [], I.cut
    monkeypatch.setattr(I, "cut", lambda df: (lambda out: written.append(out.count()) or out)(cut(df)))
    starts = spark.createDataFrame([(1,)], "spec_id long")
    assert I.propagate(relations, specs, starts, 2)[0].count() == n and I.trace(relations, specs, starts, 2)[0].count() == n
    assert max(written) <= n  # 8,010 pairs before


def test_missing_mapping_counts_before_it_joins(spark):
    consumers = spark.createDataFrame([(f"c{i}", "/a") for i in range(30)], "repo_id string, key string")
    producers = spark.createDataFrame([(f"p{i % 3}", f"/a/{i}") for i in range(50)], "repo_id string, key string")
    got, joins = ran(Q.missing_mapping(consumers, producers))
    assert {tuple(r) for r in got} == {(f"c{i}", "/a", 50, "/a/0") for i in range(30)} and most(joins) <= 30  # 1,500 before


def test_evidence_of_several_contracts_keeps_the_last(spark):
    dice = random.Random(17)
    contracts = [(f"c{i}", kind, key) for i, (kind, key) in enumerate([("api", "/a"), ("api", "GET:/a"), ("api", "POST:/a"), ("event", "e"), ("package", "p"), ("schema", "s"), ("api", "/b")])]
    edges = [(dice.choice(contracts)[0], dice.choice("rst"), dice.choice(["consumer", "producer", "shared", "owner"]), f"e{dice.randrange(12)}", dice.choice([D.IMPORT_RULE, "r"]), dice.choice([0.5, 0.7, 0.9]), dice.choice([None, True, True, False])) for _ in range(90)]
    kinds = {k: (kind, key.split(":")[-1], ":" in key) for k, kind, key in contracts}
    live = [x for x in edges if x[6] is not False]
    want = {}
    for u, m in itertools.product([x for x in live if x[2] in ("consumer", "shared")], [x for x in live if x[2] != "consumer"]):
        (kind, bare, verb), (k2, b2, v2) = kinds[u[0]], kinds[m[0]]
        if u[1] != m[1] and (u[0] == m[0] or kind == k2 == "api" and bare == b2 and verb != v2):
            of = kind if kind in ("api", "event") else ("import" if u[4] == D.IMPORT_RULE else "package") if kind == "package" else "shared-contract"
            at, row = (u[1], m[1], of, u[3]), (u[0], m[0], u[5] if u[0] == m[0] else min(u[5], 0.6))
            want[at] = max(want.get(at, row), row)
    got = D.by_evidence(spark.createDataFrame(edges, "contract_id string, repo_id string, role string, evidence_id string, rule string, confidence double, active boolean"), spark.createDataFrame(contracts, "contract_id string, kind string, key string")).collect()
    assert {(r.from_repo, r.to_repo, r.type, r.evidence_id): (r.source_contract, r.target_contract, r.confidence) for r in got} == want and len(got) == len(want) > 25


def test_participants_are_dealt_by_the_size_of_their_sources(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 500).alias("contract_id"), F.concat(F.lit("r"), F.col("id") % 7).alias("repo_id"), F.lit("consumer").alias("role"), F.col("id").cast("string").alias("evidence_id"), F.lit(0.9).alias("confidence"), F.lit(True).alias("active"))
    rows.write.parquet(f"{tmp_path}/edges.parquet")
    found = []
    for piece in (4000, 2000):
        monkeypatch.setattr(D, "PIECE", piece)
        df = D.participants(spark.read.parquet(f"{tmp_path}/edges.parquet"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and df.count() == 3000  # nothing is grouped in the tasks that read
        found.append(int(re.search(r"hashpartitioning\(contract_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)[1]))
    assert found[0] > 4 and abs(found[1] - 2 * found[0]) <= 1
