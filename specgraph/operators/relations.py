"""From specs and roles to relations and dependencies: all matchers, schema references, and the rebuild over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.operators import dependencies as D
from specgraph.operators import matching as M
from specgraph.operators.paths import cut

#: Columns of a spec; spec is its payload as JSON.
SPEC = "spec_id string, contract_id string, spec_kind string, repo_id string, file_id string, evidence_id string, key string, method string, path string, topic string, spec string, confidence double"
RELATION = "from_spec string, to_spec string, kind string, evidence_id string, confidence double"
#: How far a payload's type name is trusted to mean a schema, and which fields hold one.
TYPED = {
    "http-endpoint": (("REQUEST_SCHEMA", "requestBodyType"), ("RESPONSE_SCHEMA", "responseBodyType")),
    "grpc-method": (("REQUEST_SCHEMA", "requestType"), ("RESPONSE_SCHEMA", "responseType")),
    "graphql-operation": (("REQUEST_SCHEMA", "requestType"), ("RESPONSE_SCHEMA", "responseType")),
    "event": (("EVENT_PAYLOAD", "payloadType"),),
}
TRUST = {"http-endpoint": 0.7, "grpc-method": 1.0, "graphql-operation": 1.0, "event": 0.7}
PENDING = ("USES_SCHEMA", "REQUEST_SCHEMA", "RESPONSE_SCHEMA", "EVENT_PAYLOAD")


def field(name: str) -> Column:
    """A field of the payload; null where it lacks, is empty or the payload is no JSON."""
    got = F.get_json_object("spec", f"$.{name}")
    return F.when(got != "", got)


def schemas_of(specs: DataFrame) -> DataFrame:
    return specs.where("spec_kind = 'schema'").select("spec_id", "repo_id", field("name").alias("name")).where("name is not null")


def typed_relations(specs: DataFrame) -> DataFrame:
    """RELATION rows from endpoints, methods, operations and events to the schemas that their types name.

    A gRPC type without a dot is looked up within its package first, then bare.
    """
    refs = None
    for kind, fields in TYPED.items():
        pairs = F.array(*[F.struct(F.lit(relation).alias("kind"), field(name).alias("name")) for relation, name in fields])
        part = specs.where(F.col("spec_kind") == kind).select("spec_id", "repo_id", "evidence_id", field("package").alias("package"), F.lit(TRUST[kind]).alias("confidence"), F.lit(kind).alias("of"), F.inline(pairs))
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.where("name is not null").withColumn("ref_id", F.concat_ws("|", "spec_id", "kind"))
    full = F.when((F.col("of") == "grpc-method") & F.col("package").isNotNull() & ~F.col("name").contains("."), F.concat_ws(".", "package", "name"))
    schemas = schemas_of(specs)
    tried = refs.select("ref_id", "repo_id", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("nth"), F.coalesce(full, F.col("name")).alias("name")), F.when(full.isNotNull(), F.struct(F.lit(1).alias("nth"), F.col("name").alias("name")))))).alias("t"))
    tried = tried.select(F.struct("ref_id", "t.nth").alias("ref_id"), "repo_id", "t.name")
    found = M.schema_lookup(tried, schemas).groupBy(F.col("ref_id.ref_id").alias("ref_id")).agg(F.min_by("spec_id", F.col("ref_id.nth")).alias("to_spec"))
    return refs.join(found, "ref_id").select(F.col("spec_id").alias("from_spec"), "to_spec", "kind", "evidence_id", "confidence")


def pending_relations(pending: DataFrame, specs: DataFrame) -> DataFrame:
    """RELATION rows of references not yet resolved: to_spec 'schema-ref:<name>', from_spec a spec or 'spec:<contract>:pending' for all of a contract's."""
    waiting = pending.where(F.col("kind").isin(*PENDING) & F.col("to_spec").startswith("schema-ref:")).withColumn("name", F.regexp_replace("to_spec", "^schema-ref:", "")).drop("to_spec")
    of = F.regexp_extract("from_spec", "^spec:(.+):pending$", 1)
    known = specs.select(F.col("spec_id").alias("resolved"), "repo_id", "contract_id")
    direct = waiting.join(known, F.col("from_spec") == F.col("resolved")).drop("contract_id")
    rest = waiting.join(known, F.col("from_spec") == F.col("resolved"), "left_anti").withColumn("of", of).where("of <> ''")
    via = rest.join(known, F.col("of") == F.col("contract_id")).drop("contract_id", "of")
    refs = direct.unionByName(via).withColumn("ref_id", F.concat_ws("|", "resolved", "kind", "name"))
    found = M.schema_lookup(refs.select("ref_id", "repo_id", "name"), schemas_of(specs))
    out = refs.join(found, "ref_id").where("resolved <> spec_id")
    return out.groupBy(F.col("resolved").alias("from_spec"), F.col("spec_id").alias("to_spec"), "kind").agg(F.min("evidence_id").alias("evidence_id"), F.max("confidence").alias("confidence"))


def calls(specs: DataFrame) -> DataFrame:
    """RELATION rows of all matchers over specs with roles."""
    evidence = specs.select(F.col("spec_id").alias("from_spec"), "evidence_id")
    forward = lambda df: df.select(F.col("consumer").alias("from_spec"), F.col("producer").alias("to_spec"), F.lit("CALLS_ENDPOINT").alias("kind"), "confidence")
    own = lambda kind: specs.where(F.col("spec_kind") == kind)
    found = forward(M.http(own("http-endpoint").select("spec_id", "repo_id", "role", "method", "path")))
    found = found.unionByName(M.event(own("event").select("spec_id", "repo_id", "role", "topic", field("payloadType").alias("payload"))))
    found = found.unionByName(forward(M.rpc(own("grpc-method").select("spec_id", "repo_id", "role", field("package").alias("package"), field("service").alias("service"), field("method").alias("method")))))
    found = found.unionByName(forward(M.dubbo(own("dubbo-method").select("spec_id", "repo_id", "role", field("interfaceName").alias("interface"), field("method").alias("method"), field("group").alias("group"), field("version").alias("version")))))
    found = found.unionByName(forward(M.exact_key(own("graphql-operation").select("spec_id", "repo_id", "role", "key"))))
    return found.join(evidence, "from_spec").select("from_spec", "to_spec", "kind", "evidence_id", "confidence")


def resolve(specs: DataFrame, edges: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """All RELATION rows of specs (SPEC), roles (contract_id, repo_id, role) and pending references; of one (from, to, kind) the most confident."""
    # Roles are written once: every matcher reads them.
    found = calls(cut(M.with_roles(specs, edges))).unionByName(typed_relations(specs))
    if pending is not None:
        found = found.unionByName(pending_relations(pending, specs).select("from_spec", "to_spec", "kind", "evidence_id", "confidence"))
    best = F.max_by(F.struct("evidence_id", "confidence"), F.struct("confidence", F.col("evidence_id").alias("e")))
    return found.groupBy("from_spec", "to_spec", "kind").agg(best.alias("b")).select("from_spec", "to_spec", "kind", "b.evidence_id", "b.confidence")


def touching(relations: DataFrame, specs: DataFrame, repos: DataFrame) -> DataFrame:
    """The relations at whose either end one of the repositories (repo_id) stands."""
    mine = specs.join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select(F.col("spec_id").alias("mine"))
    at = lambda end: relations.join(mine, F.col(end) == F.col("mine"), "left_semi")
    return at("from_spec").unionByName(at("to_spec")).distinct()


def near(specs: DataFrame, repos: DataFrame) -> DataFrame:
    """The specs that could match one of the repositories: its own, and those of other repositories with a bucket, topic, method, interface or name in common."""
    http = F.col("spec_kind") == "http-endpoint"
    bucket = F.when(F.regexp_extract("path", "^/?([^/]*)", 1).startswith("{"), F.lit("*")).otherwise(F.lower(F.regexp_extract("path", "^/?([^/]*)", 1)))
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    anchor = (
        F.when(http, F.when(bucket == "*", F.lit("h:*")).otherwise(F.concat(F.lit("h:"), bucket)))
        .when(F.col("spec_kind") == "event", F.concat(F.lit("e:"), F.lower(F.trim("topic")))).when(F.col("spec_kind") == "grpc-method", F.concat(F.lit("g:"), field("service"), F.lit("/"), field("method")))
        .when(F.col("spec_kind") == "dubbo-method", F.concat(F.lit("d:"), bare(field("interfaceName")))).when(F.col("spec_kind") == "graphql-operation", F.concat(F.lit("q:"), "key"))
        .otherwise(F.lit("s:"))
    )
    keyed = specs.withColumn("__anchor", anchor)
    own = keyed.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    wanted = own.select("__anchor").distinct()
    # A path that begins with a template meets every bucket, on either side; schemas are looked up by name among all.
    all_http = own.where("__anchor = 'h:*'").select(F.lit(True).alias("__all")).limit(1)
    some = keyed.join(wanted, "__anchor", "left_semi").unionByName(keyed.where("__anchor = 'h:*'")).unionByName(keyed.where("spec_kind = 'schema'"))
    some = some.unionByName(keyed.where("spec_kind = 'http-endpoint'").join(all_http, F.lit(True), "left_semi"))
    return some.drop("__anchor").dropDuplicates(["spec_id"])


def rebuild(specs: DataFrame, edges: DataFrame, contracts: DataFrame, pending: DataFrame | None = None, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Relations, and the dependencies that follow from them and from roles alone; with repos only those of these repositories, which equals the full
    rebuild restricted to them, from the specs near them alone.

    edges: repo_id, contract_id, role, evidence_id, confidence, active, rule. Dependencies: from_repo, to_repo, type, source_contract, target_contract, evidence_id, confidence.
    """
    some = near(specs, repos) if repos is not None else specs
    relations = cut(resolve(some, edges, pending))
    if repos is not None:
        relations = touching(relations, specs, repos)
    made = D.semantic(relations, specs)
    legacy = D.legacy(edges, contracts).select("from_repo", "to_repo", "type", F.col("contract_id").alias("source_contract"), F.col("contract_id").alias("target_contract"), "evidence_id", "confidence")
    if repos is not None:
        mine = repos.select("repo_id").distinct()
        hit = lambda end: legacy.join(mine, F.col(end) == F.col("repo_id"), "left_semi")
        legacy = hit("from_repo").unionByName(hit("to_repo")).distinct()
    return relations, D.merged(made, legacy, ["from_repo", "to_repo", "type", "source_contract", "target_contract"])
