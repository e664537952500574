"""Matching, schema references, rebuild, traces and impacts over a small graph."""

import json

import pytest
from pyspark.sql import functions as F

from specgraph.operators import dependencies as D
from specgraph.operators import impact as I
from specgraph.operators import matching as M
from specgraph.operators import relations as R


def spec(spec_id, kind, repo, key, file="f", verb=None, path=None, topic=None, contract=None, **payload):
    return (spec_id, contract or f"contract:{key}", kind, repo, file, f"ev:{spec_id}", key, verb, path, topic, json.dumps(payload), 0.9)


SPECS = [
    spec("orders.api", "http-endpoint", "orders", "POST:/orders/create", "api.ts", "POST", "/orders/create", requestBodyType="OrderDto"),
    spec("web.call", "http-endpoint", "web", "POST:/orders/create", "client.ts", "POST", "/orders/create"),
    spec("web.api", "http-endpoint", "web", "POST:/shop/create", "client.ts", "POST", "/shop/create"),
    spec("mobile.call", "http-endpoint", "mobile", "/shop/create", "m.ts", None, "/shop/create"),
    spec("orders.dto", "schema", "orders", "OrderDto", "dto.ts", name="OrderDto", fields=[{"name": "id", "type": "string", "optional": False}, {"name": "note", "type": "string", "optional": True}]),
    spec("other.dto", "schema", "other", "orderdto", "dto.ts", name="orderdto", fields=[]),
    spec("orders.event", "event", "orders", "order.created", "api.ts", topic="Order.Created", payloadType="OrderDto", broker="kafka"),
    spec("mail.event", "event", "mail", "order.created", "on.ts", topic="order.created", payloadType="Other"),
    spec("a.rpc", "grpc-method", "a", "p.S/Get", service="S", method="Get", package="p", requestType="Req"),
    spec("b.rpc", "grpc-method", "b", "S/Get", service="S", method="Get"),
    spec("p.req", "schema", "c", "p.Req", name="p.Req", fields=[]),
    spec("a.dub", "dubbo-method", "a", "x.y#run", interfaceName="X.Y", method="run", group="g", version="1"),
    spec("b.dub", "dubbo-method", "b", "x.y#run", interfaceName=" x.y ", method="run", group="g", version="2"),
    spec("c.dub", "dubbo-method", "c", "x.y", interfaceName="x.y", method="*"),
    spec("a.gql", "graphql-operation", "a", "query.order", fullName="query.order"),
    spec("b.gql", "graphql-operation", "b", "query.order", fullName="query.order"),
]
ROLES = {"orders.api": "producer", "web.call": "consumer", "web.api": "producer", "mobile.call": "consumer", "orders.event": "producer", "mail.event": "consumer", "a.rpc": "owner", "b.rpc": "consumer", "a.dub": "producer", "b.dub": "consumer", "c.dub": "consumer", "a.gql": "producer", "b.gql": "consumer"}


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(SPECS, R.SPEC)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(s[3], s[1], ROLES[s[0]], s[5], 0.9, None, "r") for s in SPECS if s[0] in ROLES]
    rows.append(("orders", "contract:POST:/orders/create", "consumer", "ev:x", 0.9, None, "r"))  # producer comes first
    return spark.createDataFrame(rows, "repo_id string, contract_id string, role string, evidence_id string, confidence double, active boolean, rule string")


def test_roles_take_the_first_and_default_to_shared(specs, edges):
    got = {r.spec_id: r.role for r in M.with_roles(specs, edges).collect()}
    assert got["orders.api"] == "producer" and got["a.rpc"] == "owner" and got["orders.dto"] == "shared" and len(got) == len(SPECS)


def test_resolve(specs, edges):
    got = {(r.from_spec, r.to_spec, r.kind): r.confidence for r in R.resolve(specs, edges).collect()}
    assert got == {
        ("web.call", "orders.api", "CALLS_ENDPOINT"): 0.95,
        ("mobile.call", "web.api", "CALLS_ENDPOINT"): 0.75,
        ("orders.api", "orders.dto", "REQUEST_SCHEMA"): 0.7,  # equal case before another
        ("orders.event", "mail.event", "PUBLISHES_EVENT"): 0.85,
        ("mail.event", "orders.event", "SUBSCRIBES_EVENT"): 0.85,
        ("orders.event", "orders.dto", "EVENT_PAYLOAD"): 0.7,
        ("b.rpc", "a.rpc", "CALLS_ENDPOINT"): 0.9,
        ("a.rpc", "p.req", "REQUEST_SCHEMA"): 1.0,
        ("b.dub", "a.dub", "CALLS_ENDPOINT"): 0.8,
        ("c.dub", "a.dub", "CALLS_ENDPOINT"): 0.6,
        ("b.gql", "a.gql", "CALLS_ENDPOINT"): 0.95,
    }


def test_pending_references(spark, specs):
    rows = [("orders.api", "schema-ref:OrderDto", "USES_SCHEMA", "e1", 0.8), ("spec:contract:OrderDto:pending", "schema-ref:OrderDto", "USES_SCHEMA", "e2", 0.8), ("spec:contract:order.created:pending", "schema-ref:p.Req", "USES_SCHEMA", "e3", 0.8), ("web.api", "schema-ref:None", "USES_SCHEMA", "e4", 0.8)]
    got = {(r.from_spec, r.to_spec) for r in R.pending_relations(spark.createDataFrame(rows, R.RELATION), specs).collect()}
    assert got == {("orders.api", "orders.dto"), ("orders.event", "p.req"), ("mail.event", "p.req")}  # no spec refers to itself


def test_scoped_rebuild_equals_the_full_one_of_its_repositories(spark, specs, edges):
    contracts = specs.select("contract_id", F.when(F.col("spec_kind") == "http-endpoint", "api").when(F.col("spec_kind") == "event", "event").otherwise("schema").alias("kind"), "key").distinct()
    full, deps = R.rebuild(specs, edges, contracts)
    full, deps = full.collect(), deps.collect()
    of = {s[0]: s[3] for s in SPECS}
    assert ("mail", "orders", "event") in {(d.from_repo, d.to_repo, d.type) for d in deps} and ("web", "orders", "api") in {(d.from_repo, d.to_repo, d.type) for d in deps}
    for repo in ("orders", "b"):
        some, scoped = R.rebuild(specs, edges, contracts, repos=spark.createDataFrame([(repo,)], "repo_id string"))
        assert sorted(some.collect()) == sorted(r for r in full if repo in (of[r.from_spec], of[r.to_spec]))
        assert sorted(map(str, scoped.collect())) == sorted(str(d) for d in deps if repo in (d.from_repo, d.to_repo))


def test_dependencies_by_evidence(spark):
    edges = spark.createDataFrame([("c1", "web", "consumer", "e1", "import-specifier-package-owner", 0.9, None), ("c1", "lib", "owner", "e2", "r", 1.0, None), ("c2", "web", "consumer", "e3", "r", 0.9, True), ("c3", "api", "producer", "e4", "r", 0.9, None), ("c3", "off", "producer", "e5", "r", 0.9, False)], "contract_id string, repo_id string, role string, evidence_id string, rule string, confidence double, active boolean")
    contracts = spark.createDataFrame([("c1", "package", "lib"), ("c2", "api", "/a"), ("c3", "api", "GET:/a")], "contract_id string, kind string, key string")
    got = {tuple(r) for r in D.by_evidence(edges, contracts).collect()}
    assert got == {("web", "lib", "import", "c1", "c1", "e1", 0.9), ("web", "api", "api", "c2", "c3", "e3", 0.6)}


@pytest.mark.parametrize("text, want", [
    ("GET /Api/Users/:id?x=1", "http:GET:/api/users/{id}"), ("api:/a//b/", "http:/a/b"), ("http POST https://h/x", "http:POST:/x"), (" event  Order.Created ", "event:order.created"), ("dto OrderDto", "schema:OrderDto"),
    ("grpc:Pkg.Svc/Get", "grpc:pkg.Svc/Get"), ("dubbo A.B # run", "dubbo:a.b#run"), ("graphql order", "graphql:query.order"), ("graphql Mutation.add", "graphql:mutation.add"), ("package @a/b", "package:@a/b"), ("OrderDto", "OrderDto"), ("", ""), ("api:custom:/x/", "http:custom:/x"),
])
def test_targets(text, want):
    assert I.target(text) == want


def acting(specs):
    event = F.get_json_object("spec", "$.eventName")
    return specs.withColumn("action", M.action(F.col("spec_kind"), F.col("key"), F.col("path"), F.col("topic"), event))


def test_trace_crosses_inner_calls(spark, specs, edges):
    relations = R.resolve(specs, edges)
    start = I.target_specs(specs, "POST /orders/create").select("spec_id")
    assert {r.spec_id for r in start.collect()} == {"orders.api", "web.call"}
    nodes, found, more = I.trace(relations, acting(specs), spark.createDataFrame([("orders.api",)], "spec_id string"), 3, "incoming")
    assert {(r.spec_id, r.hop, r.role) for r in nodes.collect()} == {("orders.api", 0, "target"), ("web.call", 1, "upstream"), ("web.api", 2, "upstream"), ("mobile.call", 3, "upstream")} and not more
    assert {(r.from_spec, r.to_spec, r.inferred, r.hop) for r in found.collect()} == {("web.call", "orders.api", False, 1), ("web.api", "web.call", True, 2), ("mobile.call", "web.api", False, 3)}
    assert I.trace(relations, acting(specs), start, 1)[2]


def test_impact_runs_upstream(specs, edges):
    relations = R.resolve(specs, edges)
    assert {r.spec_id for r in I.roots(I.target_specs(specs, "POST /orders/create"), relations).collect()} == {"orders.api"}
    rows, more = I.semantic_impact(acting(specs).drop("action").withColumn("action", M.action(F.col("spec_kind"), F.col("key"), F.col("path"), F.col("topic"), F.lit(None))), relations, "schema:OrderDto", 4)
    got = {(r.spec_id, r.hop) for r in rows.collect()}
    assert got == {("orders.dto", 0), ("orders.api", 1), ("orders.event", 1), ("web.call", 2), ("mail.event", 2), ("web.api", 3), ("mobile.call", 4)} and not more


def test_change_impact_grades_and_searches(spark, specs, edges):
    relations, with_action = R.resolve(specs, edges), acting(specs)
    sources = spark.createDataFrame([("orders", "dto.ts", "dto.ts", "x\nreturn row.note // note"), ("orders", "api.ts", "api.ts", "none")], "repo_id string, file_id string, path string, source string")
    got = I.change_impact(with_action, relations, "schema:OrderDto", "field-removed", "note", sources=sources)
    rows = {(r.repo_id, r.file_id, r.line, r.relation): r.severity for r in got.collect()}
    assert rows[("orders", "dto.ts", None, "IMPACTS")] == "risky"  # the field is optional
    assert rows[("orders", "dto.ts", 2, "USES_SCHEMA")] == "breaking" and rows[("orders", "api.ts", None, "REQUEST_SCHEMA")] == "risky"
    assert I.roll_up(got).first().overall == "breaking"
    removed = {(r.spec_id, r.severity, round(r.confidence, 2)) for r in I.change_impact(with_action, relations, "api:POST:/orders/create", "endpoint-removed").collect()}
    assert removed == {("orders.api", "breaking", 0.9), ("web.call", "breaking", 0.95), ("web.api", "breaking", 0.75), ("mobile.call", "breaking", 0.75)}


def test_unruled_changes_are_risky(spark):
    rows = [("http-endpoint", "rpc-removed", None, 0.9), ("thrift", "rpc-removed", None, 0.9), ("dubbo-method", "field-removed", None, 0.9), ("schema", "field-removed", True, 0.9), ("schema", "field-removed", False, 0.9), ("event", "field-added", None, 0.9)]
    got = sorted((r.spec_kind, r.change_type, r.severity, r.confidence) for r in I.graded(spark.createDataFrame(rows, "spec_kind string, change_type string, optional boolean, confidence double")).collect())
    assert got == sorted([("http-endpoint", "rpc-removed", "risky", 0.6), ("thrift", "rpc-removed", "risky", 0.4), ("dubbo-method", "field-removed", "risky", 0.9), ("schema", "field-removed", "risky", 0.9), ("schema", "field-removed", "breaking", 0.9), ("event", "field-added", "compatible", 0.9)])


def test_summaries(specs):
    got = {r.spec_id: r.s for r in specs.select("spec_id", I.summary(F.col("spec_kind")).alias("s")).collect()}
    assert got["orders.dto"] == "OrderDto (2 fields)" and got["orders.event"] == "payload=OrderDto  broker=kafka"
    assert got["a.dub"] == "group=g  version=1" and got["a.gql"] == "query.order"
