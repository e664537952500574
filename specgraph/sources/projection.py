"""A contract graph out of the star-schema tables: nations are repositories, parts contracts, order lines evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "case p_size % 4 when 0 then 'api' when 1 then 'event' when 2 then 'package' else 'schema' end"
CONFIDENCE = "case when l_discount < 0.03 then 0.95D when l_discount < 0.07 then 0.85D else 0.7D end"
ACTIVE = "case when l_linestatus = 'O' and l_linenumber % 2 = 1 then null else l_linestatus = 'O' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("repo:"), "n_nationkey").alias("repo_id"), F.col("n_name").alias("name"), F.col("r_name").alias("language"))


def contracts(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("/"), "p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("contract:"), "p_partkey").alias("contract_id"), F.expr(KIND).alias("kind"), key.alias("key"), F.col("p_name").alias("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, contract_id, role, evidence_id, line, rule, confidence, active: a row for each evidence."""
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", F.concat(F.lit("contract:"), "l_partkey").alias("contract_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("evidence_id"),
        F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("rule"), F.expr(CONFIDENCE).alias("confidence"), F.expr(ACTIVE).alias("active"),
    )
    keep = ["contract_id", "evidence_id", "line", "rule", "confidence", "active"]
    supplier, orders, customer = table(spark, d, "supplier"), table(spark, d, "orders"), table(spark, d, "customer")
    made = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(F.concat(F.lit("repo:"), "s_nationkey").alias("repo_id"), F.lit("producer").alias("role"), *keep)
    buyer = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_nationkey")
    used = line.join(buyer, line.l_orderkey == buyer.o_orderkey).select(F.concat(F.lit("repo:"), "c_nationkey").alias("repo_id"), F.lit("consumer").alias("role"), *keep)
    return made.unionByName(used)


def http_specs(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, repo_id, role, method, path of pages: consumers call every page's path, and each host's api serves every path as it is and as a template."""
    from specgraph.functions import keys

    p = table(spark, d, "pages")
    host, path = F.regexp_extract("url", r"^https?://([^/]+)", 1), keys.api_path(F.col("url"))
    used = p.select(F.concat(F.lit("c:"), "page_id").alias("spec_id"), host.alias("repo_id"), F.lit("consumer").alias("role"), F.when(F.col("page_id") % 3 == 0, None).otherwise(F.when(F.col("page_id") % 3 == 1, "GET").otherwise("POST")).alias("method"), path.alias("path"))
    served = p.select(host.alias("host"), F.explode(F.array_distinct(F.array(path, keys.template(path)))).alias("path"), (F.col("page_id") % 2).alias("odd")).groupBy("host", "path").agg(F.min("odd").alias("odd"))
    api = F.concat(F.lit("api."), "host")
    made = served.select(F.concat(F.lit("p:"), "host", "path").alias("spec_id"), api.alias("repo_id"), F.lit("producer").alias("role"), F.when(F.col("odd") == 0, "GET").alias("method"), "path")
    return used.unionByName(made)


SQL = """
repo AS (SELECT 'repo:' || n_nationkey AS repo_id, n_name AS name, r_name AS language FROM nation JOIN region ON n_regionkey = r_regionkey),
contract AS (SELECT 'contract:' || p_partkey AS contract_id, CASE p_size % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'event' WHEN 2 THEN 'package' ELSE 'schema' END AS kind,
  lower(replace(p_brand, '#', '-')) || '/' || p_partkey AS key, p_name AS name FROM part),
ln AS (SELECT l_orderkey, l_suppkey, 'contract:' || l_partkey AS contract_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS evidence_id,
  l_linenumber::BIGINT AS line, l_returnflag AS rule, CASE WHEN l_discount < 0.03 THEN 0.95::DOUBLE WHEN l_discount < 0.07 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
  CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN NULL ELSE l_linestatus = 'O' END AS active FROM lineitem),
edge AS (
  SELECT 'repo:' || s_nationkey AS repo_id, 'producer' AS role, contract_id, evidence_id, line, rule, confidence, active FROM ln JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT 'repo:' || c_nationkey, 'consumer', contract_id, evidence_id, line, rule, confidence, active FROM ln JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
live AS (SELECT * FROM edge WHERE coalesce(active, true)),
spec AS (
  SELECT 'c:' || page_id AS spec_id, regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, 'consumer' AS role, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'GET' ELSE 'POST' END AS method, path FROM paged
  UNION ALL
  SELECT 'p:' || host || path, 'api.' || host, 'producer', CASE WHEN min(odd) = 0 THEN 'GET' END, path FROM (
    SELECT DISTINCT page_id, page_id % 2 AS odd, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest([path, regexp_replace(regexp_replace(path, '/[0-9]+$', '/{id}'), '/[0-9]+([/.#])', '/{id}\\1', 'g')]) AS path FROM paged) GROUP BY host, path)
"""
PATH_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', ''), '^/?', '/'), '/{2,}', '/', 'g'), '(.)/$', '\\1')"
PREFIX = f"WITH RECURSIVE paged AS (SELECT page_id, url, {PATH_SQL} AS path FROM pages), " + SQL.strip()
