"""Registered queries and the SQL each is held to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.functions import keys
from specgraph.operators import dependencies as D
from specgraph.operators import matching as M
from specgraph.operators import paths as G
from specgraph.operators import reading as Q
from specgraph.sources import projection as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prefix: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (P.PREFIX + " " if prefix else "") + sql
        return f

    return add


@query("SELECT (SELECT count(*) FROM repo) AS repos, (SELECT count(*) FROM contract) AS contracts, (SELECT count(DISTINCT evidence_id) FROM live) AS evidences, (SELECT count(*) FROM live WHERE role = 'producer') AS produces, (SELECT count(*) FROM live WHERE role = 'consumer') AS consumes, (SELECT count(*) FROM edge) AS edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e = P.edges(spark, d)
    on = keys.is_active(F.col("active"))
    one = e.agg(F.count_distinct(F.when(on, F.col("evidence_id"))).alias("evidences"), F.count(F.when(on & (F.col("role") == "producer"), 1)).alias("produces"), F.count(F.when(on & (F.col("role") == "consumer"), 1)).alias("consumes"), F.count("*").alias("edges"))
    return P.repos(spark, d).agg(F.count("*").alias("repos")).crossJoin(P.contracts(spark, d).agg(F.count("*").alias("contracts"))).crossJoin(one)  # one row each


_SUMMARY = "SELECT kind, key, name, coalesce(count(DISTINCT CASE WHEN role = 'producer' THEN repo_id END), 0) AS producers, coalesce(count(DISTINCT CASE WHEN role = 'consumer' THEN repo_id END), 0) AS consumers, count(DISTINCT evidence_id) AS evidences FROM contract LEFT JOIN live USING (contract_id) GROUP BY contract_id, kind, key, name ORDER BY kind, key LIMIT 100"


@query(_SUMMARY)
def contract_summary(spark, d):
    return Q.contract_summary(P.contracts(spark, d), P.edges(spark, d))


@query("SELECT contract_id, kind, key, name FROM contract WHERE EXISTS (SELECT 1 FROM live WHERE live.contract_id = contract.contract_id AND repo_id = 'repo:3' AND role = 'producer') ORDER BY kind, key LIMIT 100")
def contracts_outgoing(spark, d):
    return Q.contracts_of(P.contracts(spark, d), P.edges(spark, d), "repo:3", "producer")


@query("SELECT contract_id, kind, key, name FROM contract WHERE EXISTS (SELECT 1 FROM live WHERE live.contract_id = contract.contract_id AND repo_id = 'repo:3' AND role = 'consumer') ORDER BY kind, key LIMIT 100")
def contracts_incoming(spark, d):
    return Q.contracts_of(P.contracts(spark, d), P.edges(spark, d), "repo:3", "consumer")


_PART = "part_ AS (SELECT contract_id, repo_id, role, min(evidence_id) AS evidence_id, max(confidence) AS confidence FROM live GROUP BY ALL), dep AS (SELECT u.repo_id AS from_repo, m.repo_id AS to_repo, CASE WHEN kind IN ('api', 'event', 'package') THEN kind ELSE 'shared-contract' END AS type, u.contract_id, u.evidence_id, least(u.confidence, m.confidence) AS confidence FROM part_ u JOIN part_ m USING (contract_id) JOIN contract USING (contract_id) WHERE u.role = 'consumer' AND m.role = 'producer' AND u.repo_id <> m.repo_id)"


@query(f", {_PART} SELECT from_repo, to_repo, type, count(*) AS n, min(evidence_id) AS evidence_id, max(confidence) AS confidence FROM dep GROUP BY ALL")
def deps_legacy(spark, d):
    return D.legacy(P.edges(spark, d), P.contracts(spark, d)).groupBy("from_repo", "to_repo", "type").agg(F.count("*").alias("n"), F.min("evidence_id").alias("evidence_id"), F.max("confidence").alias("confidence"))


def _list_sql(where: str = "true", limit: int = 20) -> str:
    return f", {_PART} SELECT *, CASE WHEN type IN ('package', 'import', 'api') THEN 'strong' ELSE 'weak' END AS strength, CASE WHEN confidence >= 0.9 THEN 'exact' WHEN confidence >= 0.8 THEN 'probable' ELSE 'heuristic' END AS band FROM dep WHERE {where} ORDER BY strength, from_repo, to_repo, type, contract_id, evidence_id LIMIT {limit}"


@query(_list_sql())
def dependency_list(spark, d):
    return Q.dependency_list(D.legacy(P.edges(spark, d), P.contracts(spark, d)))


@query(_list_sql("type NOT IN ('package', 'import', 'api')"))
def dependency_list_weak(spark, d):
    return Q.dependency_list(D.legacy(P.edges(spark, d), P.contracts(spark, d)), strength="weak")


@query(_list_sql("from_repo = 'repo:7' OR to_repo = 'repo:7'", 50))
def dependency_list_repo(spark, d):
    return Q.dependency_list(D.legacy(P.edges(spark, d), P.contracts(spark, d)), 50, repo="repo:7")


@query("SELECT repo_id, role, count(*) AS n FROM live GROUP BY ALL")
def role_counts(spark, d):
    return Q.live(P.edges(spark, d)).groupBy("repo_id", "role").agg(F.count("*").alias("n"))


@query("SELECT role, repo_id, contract_id, evidence_id, confidence FROM live WHERE confidence < 0.8 QUALIFY row_number() OVER (PARTITION BY role ORDER BY confidence, repo_id, contract_id, evidence_id) <= 50")
def low_confidence(spark, d):
    top = F.row_number().over(W.partitionBy("role").orderBy("confidence", "repo_id", "contract_id", "evidence_id"))
    return Q.live(P.edges(spark, d)).where("confidence < 0.8").withColumn("n", top).where("n <= 50").select("role", "repo_id", "contract_id", "evidence_id", "confidence")


@query("SELECT evidence_id, repo_id, regexp_extract(evidence_id, ':([0-9-]+)$', 1) AS reason FROM live WHERE rule = 'R' AND role = 'consumer' ORDER BY evidence_id, repo_id LIMIT 100")
def unresolved_evidence(spark, d):
    return Q.live(P.edges(spark, d)).where("rule = 'R' and role = 'consumer'").select("evidence_id", "repo_id", F.regexp_extract("evidence_id", ":([0-9-]+)$", 1).alias("reason")).orderBy("evidence_id", "repo_id").limit(100)


@query("SELECT contract_id, count(DISTINCT repo_id) AS n, string_agg(DISTINCT repo_id, ', ' ORDER BY repo_id) AS repos FROM live WHERE role = 'producer' GROUP BY contract_id HAVING count(DISTINCT repo_id) > 1")
def producer_conflicts(spark, d):
    g = Q.live(P.edges(spark, d)).where("role = 'producer'").select("contract_id", "repo_id").distinct().groupBy("contract_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("repo_id")), ", ").alias("repos"))
    return g.where("n > 1")


@query("SELECT lower(k) AS folded, count(DISTINCT k) AS n, min(k) AS least FROM (SELECT CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END AS k FROM part) GROUP BY lower(k) HAVING count(DISTINCT k) > 1", prefix=False)
def case_variants(spark, d):
    k = P.table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type")).alias("k"))
    return k.groupBy(F.lower("k").alias("folded")).agg(F.count_distinct("k").alias("n"), F.min("k").alias("least")).where("n > 1")


@query("SELECT repo_id, count(*) AS n FROM live WHERE role = 'producer' GROUP BY repo_id HAVING count(*) > 1000")
def package_inflation(spark, d):
    return Q.live(P.edges(spark, d)).where("role = 'producer'").groupBy("repo_id").agg(F.count("*").alias("n")).where("n > 1000")


@query("SELECT contract_id, key FROM contract WHERE kind = 'api' AND NOT starts_with(key, '/')")
def no_slash(spark, d):
    return P.contracts(spark, d).where((F.col("kind") == "api") & ~F.col("key").startswith("/")).select("contract_id", "key")


@query("SELECT page_id, path FROM paged")
def api_path_normalize(spark, d):
    return P.table(spark, d, "pages").select("page_id", keys.api_path(F.col("url")).alias("path"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS id, sha256(p_name) AS hash FROM part", prefix=False)
def canonical_keys(spark, d):
    return P.table(spark, d, "part").select("p_partkey", keys.normal_name(F.col("p_name")).alias("id"), keys.content_hash(F.col("p_name")).alias("hash"))


_HTTP = """, s AS (SELECT spec_id, repo_id, role, method, lower(path) AS path, string_split(ltrim(lower(path), '/'), '/') AS seg, regexp_matches(lower(path), '(^|/)\\{[^/]+\\}(/|$)') AS tpl FROM spec),
pair AS (SELECT c.spec_id AS consumer, p.spec_id AS producer, p.repo_id AS p_repo, CASE WHEN c.path = p.path AND c.method = p.method THEN 'exact' WHEN c.path = p.path THEN 'path-only' WHEN p.tpl <> c.tpl THEN 'static-to-template' ELSE 'template-compatible' END AS kind
 FROM s c JOIN s p ON c.role = 'consumer' AND p.role = 'producer' AND len(c.seg) = len(p.seg) AND c.repo_id <> p.repo_id WHERE (c.method = p.method OR c.method IS NULL OR p.method IS NULL)
 AND (c.path = p.path OR ((c.tpl OR p.tpl) AND len(list_filter(list_zip(c.seg, p.seg), lambda x: NOT (x[1] = x[2] OR regexp_matches(x[1], '^\\{.+\\}$') OR regexp_matches(x[2], '^\\{.+\\}$')))) = 0))),
best AS (SELECT *, CASE kind WHEN 'exact' THEN 0 WHEN 'path-only' THEN 1 ELSE 2 END AS r FROM pair QUALIFY r = min(r) OVER (PARTITION BY consumer, p_repo))
SELECT DISTINCT consumer, producer, kind, CASE kind WHEN 'exact' THEN 0.95::DOUBLE WHEN 'path-only' THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM best"""


@query(_HTTP)
def http_match_priority(spark, d):
    return M.http(P.http_specs(spark, d))


def _event_specs(spark, d):
    e = P.table(spark, d, "events")
    role = F.when(F.col("event_id") % 3 == 0, "producer").otherwise("consumer")
    return e.select(F.concat(F.lit("e:"), "event_id").alias("spec_id"), F.concat(F.lit("u:"), F.col("user_id") % 40).alias("repo_id"), role.alias("role"), F.concat_ws("-", F.upper("event_type"), F.col("event_id") % 50).alias("topic"), F.get_json_object("props", "$.k").alias("payload"))


_EVENT = "es AS (SELECT 'e:' || event_id AS spec_id, 'u:' || (user_id % 40) AS repo_id, CASE WHEN event_id % 3 = 0 THEN 'producer' ELSE 'consumer' END AS role, lower(event_type || '-' || (event_id % 50)) AS topic, props::JSON->>'$.k' AS payload FROM events), ep AS (SELECT p.spec_id AS p, c.spec_id AS c, CASE WHEN p.payload <> c.payload THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM es p JOIN es c USING (topic) WHERE p.role = 'producer' AND c.role = 'consumer' AND p.repo_id <> c.repo_id), em AS (SELECT p AS from_spec, c AS to_spec, 'PUBLISHES_EVENT' AS kind, confidence FROM ep UNION ALL SELECT c, p, 'SUBSCRIBES_EVENT', confidence FROM ep)"


@query(f"WITH {_EVENT} SELECT * FROM em", prefix=False)
def event_match(spark, d):
    return M.event(_event_specs(spark, d))


_RPC = "rs AS (SELECT 'r:' || p_partkey AS spec_id, 'repo:' || (p_size % 25) AS repo_id, CASE WHEN p_partkey % 3 = 0 THEN 'producer' ELSE 'consumer' END AS role, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS package, p_brand AS service, CASE WHEN p_partkey % 9 = 0 THEN '*' ELSE split_part(p_type, ' ', 1) END AS method FROM part)"


def _rpc_specs(spark, d):
    p = P.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("r:"), k).alias("spec_id"), F.concat(F.lit("repo:"), F.col("p_size") % 25).alias("repo_id"), F.when(k % 3 == 0, "producer").otherwise("consumer").alias("role"), F.when(k % 4 == 0, None).when(k % 4 == 1, "a").otherwise("b").alias("package"), F.col("p_brand").alias("service"), F.when(k % 9 == 0, "*").otherwise(F.split("p_type", " ")[0]).alias("method"))


@query(f"WITH {_RPC} SELECT c.spec_id AS consumer, p.spec_id AS producer, CASE WHEN p.package IS NOT DISTINCT FROM c.package THEN 0.95::DOUBLE WHEN p.package IS NULL OR c.package IS NULL THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM rs p JOIN rs c USING (service, method) WHERE p.role = 'producer' AND c.role = 'consumer' AND p.repo_id <> c.repo_id", prefix=False)
def rpc_match(spark, d):
    return M.rpc(_rpc_specs(spark, d))


@query(f"WITH {_RPC} SELECT c.spec_id AS consumer, p.spec_id AS producer, 0.95::DOUBLE AS confidence FROM rs p JOIN rs c ON p.service || '.' || p.method = c.service || '.' || c.method WHERE p.role = 'producer' AND c.role = 'consumer' AND p.repo_id <> c.repo_id", prefix=False)
def exact_key_match(spark, d):
    return M.exact_key(_rpc_specs(spark, d).withColumn("key", F.concat_ws(".", "service", "method")))


@query("WITH r AS (SELECT c_custkey AS ref_id, c_nationkey AS repo_id, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT s_suppkey AS spec_id, s_nationkey AS repo_id, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE lower(n_name) END AS name FROM supplier JOIN nation ON n_nationkey = (s_nationkey + s_suppkey % 2) % 25), j AS (SELECT ref_id, spec_id, (r.name = s.name)::INT AS e, (r.repo_id = s.repo_id)::INT AS o FROM r JOIN s ON lower(r.name) = lower(s.name)), k AS (SELECT * FROM j QUALIFY e = max(e) OVER (PARTITION BY ref_id)), l AS (SELECT * FROM k QUALIFY o = max(o) OVER (PARTITION BY ref_id)) SELECT ref_id, min(spec_id) AS spec_id FROM l GROUP BY ref_id HAVING count(*) = 1", prefix=False)
def schema_lookup(spark, d):
    c, s, n = (P.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    refs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").alias("repo_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"))
    schemas = s.join(n, (F.col("s_nationkey") + F.col("s_suppkey") % 2) % 25 == F.col("n_nationkey")).select(F.col("s_suppkey").alias("spec_id"), F.col("s_nationkey").alias("repo_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"))
    return M.schema_lookup(refs, schemas)


@query("SELECT contract_id, repo_id, role, evidence_id, confidence FROM edge QUALIFY row_number() OVER (PARTITION BY contract_id, repo_id, role ORDER BY confidence DESC, evidence_id) = 1")
def edge_dedup_max_conf(spark, d):
    return M.best_edges(P.edges(spark, d), ["contract_id", "repo_id", "role"], [F.desc("confidence"), F.col("evidence_id")]).select("contract_id", "repo_id", "role", "evidence_id", "confidence")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1", prefix=False)
def dedup_last_wins(spark, d):
    return M.best_edges(P.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def _keyed(spark, d):
    s = P.http_specs(spark, d)
    return s.select("repo_id", "role", F.concat(F.coalesce(F.concat("method", F.lit(":")), F.lit("")), "path").alias("key"), F.lit(0.9).alias("confidence"))


@query(", k AS (SELECT DISTINCT repo_id, role, path AS bare, method IS NULL AS o FROM spec) SELECT c.repo_id AS from_repo, p.repo_id AS to_repo, bare AS path, 0.6::DOUBLE AS confidence FROM k c JOIN k p USING (bare) WHERE c.role = 'consumer' AND p.role = 'producer' AND c.o <> p.o AND c.repo_id <> p.repo_id GROUP BY ALL")
def deps_path_bridge(spark, d):
    return D.path_bridge(_keyed(spark, d))


_CALLS = "calls AS (SELECT DISTINCT p_partkey AS src, 1 + (p_partkey * 7 + p_size * 13) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, 1 + (p_partkey * 3 + p_size) % (SELECT count(*) FROM part) FROM part WHERE p_size % 2 = 0)"


def _calls(spark, d):
    p = P.table(spark, d, "part")
    n = p.agg(F.count("*").alias("n"))
    p = p.crossJoin(F.broadcast(n))  # one row
    return p.select(F.col("p_partkey").alias("src"), (1 + (F.col("p_partkey") * 7 + F.col("p_size") * 13) % F.col("n")).alias("dst")).union(p.where("p_size % 2 = 0").select("p_partkey", 1 + (F.col("p_partkey") * 3 + F.col("p_size")) % F.col("n"))).distinct()


def _reach_sql(a: str, b: str) -> str:
    return f"WITH RECURSIVE {_CALLS}, r(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 20 UNION SELECT {b}, hop + 1 FROM r JOIN calls ON node = {a} WHERE hop < 3) SELECT node, min(hop)::INT AS hop FROM r GROUP BY node"


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed') ORDER BY doc_id LIMIT 20", prefix=False)
def section_search(spark, d):
    return Q.search(P.table(spark, d, "documents"), ["text", "source"], "licensed", ["doc_id"], 20).select("doc_id", "source")


@query("SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT) / 3, 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50", prefix=False)
def keyword_score(spark, d):
    return P.table(spark, d, "documents").select("doc_id", F.round(Q.keyword_score(F.col("text"), ["the", "der", "que"]), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


_VEC = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b"


def _scored(spark, d):
    e = P.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 7").select(F.col("v").alias("q"))  # one row
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(Q.cosine(F.col("v"), F.col("q")), 6).alias("score"))


@query(f"{_VEC} ORDER BY score DESC, vec_id LIMIT 10", prefix=False)
def vector_topk(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH v AS ({_VEC}), k AS (SELECT doc_id AS vec_id, round(0.65 * (contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT) / 2, 6) AS w FROM documents) SELECT vec_id, greatest(score, coalesce(w, 0)) AS score FROM v LEFT JOIN k USING (vec_id) WHERE greatest(score, coalesce(w, 0)) > 0 ORDER BY score DESC, vec_id LIMIT 10", prefix=False)
def hybrid_topk(spark, d):
    k = P.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.round(0.65 * Q.keyword_score(F.col("text"), ["the", "der"]), 6).alias("w"))
    s = _scored(spark, d).join(k, "vec_id", "left").select("vec_id", F.greatest("score", F.coalesce("w", F.lit(0.0))).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "vec_id").limit(10)


@query("WITH j AS (SELECT source AS type, (quality = 1) AS f, (toxic = 0) AS w FROM labels JOIN documents USING (doc_id)), g AS (SELECT CASE WHEN grouping(type) = 1 THEN 'ALL' ELSE type END AS type, count(*) FILTER (f AND w) AS tp, count(*) FILTER (f AND NOT w) AS fp, count(*) FILTER (NOT f AND w) AS fn, count(*) FILTER (f OR w) AS n FROM j GROUP BY ROLLUP (type)), m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM g WHERE n > 0) SELECT type, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM m", prefix=False)
def set_metrics_by_type(spark, d):
    x = P.table(spark, d, "labels").join(P.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("key"), F.col("source").alias("type"), "quality", "toxic")
    return Q.set_metrics(x.where("quality = 1"), x.where("toxic = 0"), "type")


@query("SELECT role, count(*) AS n, count(active) AS flagged FROM live GROUP BY role")
def active_view(spark, d):
    return Q.live(P.edges(spark, d)).groupBy("role").agg(F.count("*").alias("n"), F.count("active").alias("flagged"))


@query("WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_type)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, k", prefix=False)
def debounce_sessions(spark, d):
    from specgraph.streaming.debounce import sessions

    e = P.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = sessions(e, "30 minutes", ["user_id"])
    return out.select("user_id", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "n", F.size("kinds").cast("long").alias("kinds"))


@query(", roots AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]+)', 1) AS root FROM paged UNION SELECT '/' ) SELECT page_id, arg_max(root, length(root)) AS root FROM paged JOIN roots ON starts_with(path, root) GROUP BY page_id")
def longest_prefix_route(spark, d):
    from specgraph.streaming.debounce import route

    pages = P.table(spark, d, "pages").select("page_id", keys.api_path(F.col("url")).alias("path"))
    roots = pages.select(F.regexp_extract("path", "^(/[^/]+)", 1).alias("root")).union(spark.createDataFrame([("/",)], "root string")).distinct()
    return route(pages, roots)


@query("WITH t AS (SELECT conv_id, turn, role, 1 + length(text) - length(replace(text, chr(10), '')) AS n FROM conversations) SELECT conv_id, turn, role AS heading, 1 AS level, 1 AS start_line, 1 + n AS end_line FROM t UNION ALL SELECT conv_id, turn, 'turn ' || turn, 2, 2 + n, 2 + 2 * n FROM t", prefix=False)
def document_sections(spark, d):
    """Every turn as a document of two sections."""
    from specgraph.operators.documents import sections

    text = F.concat(F.lit("# "), "role", F.lit("\n"), "text", F.lit("\n## turn "), F.col("turn").cast("string"), F.lit(" ##\n"), "text")
    t = P.table(spark, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    return sections(t, "text", "role").select("conv_id", "turn", "heading", "level", "start_line", "end_line")


@query("SELECT p_partkey, 1 AS line, 'row.' || p_brand || ' = 1' AS raw FROM part UNION ALL SELECT p_partkey, 3, 'x[\"Brand\"] // ' || p_type FROM part", prefix=False)
def field_search(spark, d):
    """Lines that touch the field Brand in a three-line source made of every part."""
    from specgraph.operators.fields import field_references

    source = F.concat(F.lit("row."), "p_brand", F.lit(" = 1\n// row.Brand "), "p_name", F.lit('\nx["Brand"] // '), "p_type")
    files = P.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.lit("a.ts").alias("path"), source.alias("source"))
    return field_references(files, "Brand").select(F.col("file_id").alias("p_partkey"), "line", "raw")


@query("SELECT doc_id, lang AS state FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) UNION ALL SELECT doc_id, max_by(quality, 2 * quality + toxic)::VARCHAR FROM labels GROUP BY doc_id", prefix=False)
def upsert_rows(spark, d):
    """Labels put into the documents' states; of several labels the last in order stays."""
    from specgraph.operators.writing import upsert

    rows = P.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("state"), (2 * F.col("quality") + F.col("toxic")).alias("seq"))
    return upsert(P.table(spark, d, "documents").select("doc_id", F.col("lang").alias("state")), rows, ["doc_id"], "seq")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus = 'P' THEN false END AS active FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", prefix=False)
def switched_off_rows(spark, d):
    """Order lines switched off where their order counts as rejected."""
    from specgraph.operators.writing import switched_off

    off = P.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return switched_off(P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), off, ["l_orderkey"])
