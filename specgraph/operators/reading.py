"""Relational reads over the graph: summaries, lists, searches, traces. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.functions.keys import band, is_active

STRONG = ("package", "import", "api")


def live(edges: DataFrame) -> DataFrame:
    return edges.where(is_active(F.col("active")))


def contract_summary(contracts: DataFrame, edges: DataFrame, limit: int | None = 100) -> DataFrame:
    """Each contract's producers (owners too), consumers and evidence; contracts nobody uses count 0.

    Repositories and evidence are made distinct by one grouping, then counted: no row is multiplied.
    """
    side = F.when(F.col("role").isin("producer", "owner"), "p").when(F.col("role") == "consumer", "c")
    rows = live(edges).select("contract_id", side.alias("side"), "repo_id", "evidence_id")
    repos = rows.where("side is not null").groupBy("contract_id", "side", "repo_id").agg(F.lit(1).alias("one")).groupBy("contract_id").agg(F.count_if(F.col("side") == "p").alias("producers"), F.count_if(F.col("side") == "c").alias("consumers"))
    proofs = rows.select("contract_id", "evidence_id").distinct().groupBy("contract_id").agg(F.count("evidence_id").alias("evidences"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = contracts.join(repos, "contract_id", "left").join(proofs, "contract_id", "left").select("kind", "key", "name", zero("producers"), zero("consumers"), zero("evidences")).orderBy("kind", "key")
    return out.limit(limit) if limit else out


def contracts_of(contracts: DataFrame, edges: DataFrame, repo: str, role: str, limit: int = 100) -> DataFrame:
    """Contracts that a repository has in a role."""
    return contracts.join(live(edges).where((F.col("repo_id") == repo) & (F.col("role") == role)), "contract_id", "left_semi").orderBy("kind", "key").limit(limit)


def dependency_list(deps: DataFrame, limit: int = 20, strength: str | None = None, repo: str | None = None, target: str | None = None, direction: str | None = None, type: str | None = None) -> DataFrame:
    """Dependencies, strong kinds first, with a confidence band; of a repository, its outgoing or incoming ones, and between it and a target."""
    strong, a, b = F.col("type").isin(*STRONG), F.col("from_repo"), F.col("to_repo")
    if strength:
        deps = deps.where(strong if strength == "strong" else ~strong)
    if type:
        deps = deps.where(F.col("type") == type)
    if (target or direction) and not repo:
        raise ValueError("target and direction need a repository")
    if repo:
        out_, in_ = (a == repo) & (b == target if target else F.lit(True)), (b == repo) & (a == target if target else F.lit(True))
        deps = deps.where({"outgoing": out_, "incoming": in_}.get(direction, out_ | in_))
    out = deps.withColumn("strength", F.when(strong, "strong").otherwise("weak")).withColumn("band", band(F.col("confidence")))
    return out.orderBy("strength", "from_repo", "to_repo", "type", "contract_id", "evidence_id").limit(limit)


def trace_contract(contracts: DataFrame, edges: DataFrame, kind: str, key: str) -> DataFrame:
    """Who has the contract in which role, with the evidence; an api key that no contract has finds keys of any method that end with it."""
    mine = contracts.where(F.col("kind") == kind)
    hit = mine.where(F.col("key") == key)
    if kind == "api":
        hit = hit.unionByName(mine.where(F.col("key").endswith(":" + key)).join(hit.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left_anti"))
    return live(edges).join(hit, "contract_id").select("repo_id", "role", "evidence_id", "line", "confidence").orderBy("repo_id", "role", "line", "evidence_id")


def search(rows: DataFrame, columns: list[str], text: str, order: list[Column | str], limit: int) -> DataFrame:
    """Rows that hold a text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    return rows.where(hit).orderBy(*order).limit(limit)


def keyword_score(text: Column, terms: list[str]) -> Column:
    """The share of terms that the text holds."""
    return sum((F.contains(F.lower(text), F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / F.lit(len(terms))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def set_metrics(found: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F1 of found against wanted keys, by type and over ALL. Both: key and a type column."""
    j = found.select("key", by).distinct().withColumn("f", F.lit(1)).join(wanted.select("key", by).distinct().withColumn("w", F.lit(1)), ["key", by], "full")
    n = lambda cond: F.count(F.when(cond, 1))
    f, w = F.col("f").isNotNull(), F.col("w").isNotNull()
    g = j.rollup(by).agg(n(f & w).alias("tp"), n(f & ~w).alias("fp"), n(~f & w).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return g.select(F.coalesce(F.col(by), F.lit("ALL")).alias("type"), "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))
