"""Repository dependencies from roles and from matched specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.functions.keys import event_key, is_active


#: Fixed value: how many bytes of its source tables a task takes, as they lie in their files.
PIECE = 4 << 20


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt by a key over as many tasks as its sources' size asks for, so what a task holds doesn't grow with them; what groups by the key and more
    then does so where the rows are, and not in the tasks that read them too."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()) if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation")
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE)), by)


def participants(edges: DataFrame) -> DataFrame:
    """contract_id, repo_id, role with the least evidence and the best confidence: one row each, before anything joins on the contract."""
    return _dealt(edges.where(is_active(F.col("active"))), "contract_id").groupBy("contract_id", "repo_id", "role").agg(F.min("evidence_id").alias("evidence_id"), F.max("confidence").alias("confidence"))


def legacy(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """from_repo, to_repo, type, contract_id, evidence_id, confidence: consumers (and sharers) of a contract depend on its producers (owners, sharers)."""
    p = participants(edges)
    used = p.where("role in ('consumer', 'shared')").select("contract_id", F.col("repo_id").alias("from_repo"), "evidence_id", F.col("confidence").alias("c"))
    made = p.where("role in ('producer', 'owner', 'shared')").select("contract_id", F.col("repo_id").alias("to_repo"), F.col("confidence").alias("d")).groupBy("contract_id", "to_repo").agg(F.max("d").alias("d"))
    kind = F.when(F.col("kind").isin("api", "event", "package"), F.col("kind")).otherwise("shared-contract")
    j = used.join(made, "contract_id").where("from_repo <> to_repo").join(contracts.select("contract_id", "kind"), "contract_id")
    return j.select("from_repo", "to_repo", kind.alias("type"), "contract_id", "evidence_id", F.least("c", "d").alias("confidence"))


#: The rule of evidence that makes a package dependency an import.
IMPORT_RULE = "import-specifier-package-owner"


def by_evidence(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """from_repo, to_repo, type, source_contract, target_contract, evidence_id, confidence: a row for each evidence of a consumer and each producing repository.

    edges: contract_id, repo_id, role, evidence_id, rule, confidence, active; contracts: contract_id, kind, key. An api key without a method also meets
    keys with one on its path, either way, at 0.6 at most. Of rows with one (from, to, type, evidence) that of the last contract stays.
    """
    kinds = contracts.select("contract_id", "kind", F.regexp_replace("key", "^[A-Z]+:", "").alias("bare"), F.col("key").rlike("^[A-Z]+:").alias("with_method"))
    live = edges.where(is_active(F.col("active"))).join(kinds, "contract_id")
    used = live.where("role in ('consumer', 'shared')").select("contract_id", "kind", "bare", "with_method", F.col("repo_id").alias("from_repo"), "evidence_id", "rule", "confidence")
    made = live.where("role in ('producer', 'owner', 'shared')").select("contract_id", "kind", "bare", "with_method", F.col("repo_id").alias("to_repo")).distinct()
    kind = F.when(F.col("kind").isin("api", "event"), F.col("kind")).when(F.col("kind") == "package", F.when(F.col("rule") == IMPORT_RULE, "import").otherwise("package")).otherwise("shared-contract")
    # Of a contract's targets in a repository the last stays, before any evidence meets them.
    of = made.select("contract_id", "to_repo", F.col("contract_id").alias("target_contract"), F.lit(False).alias("bridged"))
    api = made.where("kind = 'api'").select("bare", F.col("with_method").alias("m"), F.col("contract_id").alias("target_contract"), "to_repo")
    bridge = used.where("kind = 'api'").select("contract_id", "bare", "with_method").distinct().join(api, "bare").where("with_method <> m")
    targets = of.unionByName(bridge.select("contract_id", "to_repo", "target_contract", F.lit(True).alias("bridged"))).groupBy("contract_id", "to_repo").agg(F.max(F.struct("target_contract", "bridged")).alias("t"))
    # An evidence's contracts, with the best confidence of each: where there is one, its rows come once without being compared.
    one = _dealt(used, "evidence_id").groupBy("from_repo", kind.alias("type"), "evidence_id", "contract_id").agg(F.max("confidence").alias("confidence"))
    one = one.groupBy("from_repo", "type", "evidence_id").agg(F.collect_list(F.struct("contract_id", "confidence")).alias("of"))
    rows = one.select("from_repo", "type", "evidence_id", (F.size("of") > 1).alias("several"), F.inline("of")).join(targets, "contract_id").where("from_repo <> to_repo")
    least = F.when(F.col("t.bridged"), F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence"))
    rows = rows.select("several", "from_repo", "to_repo", "type", F.col("contract_id").alias("source_contract"), "t.target_contract", "evidence_id", least.alias("confidence"))
    last = F.max(F.struct("source_contract", "target_contract", "confidence")).alias("l")
    several = rows.where("several").groupBy("from_repo", "to_repo", "type", "evidence_id").agg(last).select("from_repo", "to_repo", "type", "l.source_contract", "l.target_contract", "evidence_id", "l.confidence")
    return rows.where("not several").drop("several").unionByName(several)


# What a relation means for repositories, whether it points the other way, and how an impact runs along it.
KINDS = {
    "CALLS_ENDPOINT": ("api", False, "consumer-to-producer"), "SUBSCRIBES_EVENT": ("event", False, "consumer-to-producer"), "PUBLISHES_EVENT": ("event", True, "consumer-to-producer"),
    "USES_SCHEMA": ("shared-contract", False, "schema-to-use"), "REQUEST_SCHEMA": (None, False, "schema-to-use"), "RESPONSE_SCHEMA": (None, False, "schema-to-use"), "EVENT_PAYLOAD": (None, False, "schema-to-use"),
    "IMPLEMENTS": (None, False, "intra-spec"), "COMPATIBLE_WITH": (None, False, "intra-spec"), "BREAKS": (None, False, "intra-spec"), "IMPACTS": (None, False, "intra-spec"),
}
TURNED = [k for k, (_, back, _) in KINDS.items() if back]


def semantic(relations: DataFrame, specs: DataFrame) -> DataFrame:
    """from_repo, to_repo, type, source_contract, target_contract, evidence_id, confidence out of spec relations, across repositories only.

    PUBLISHES_EVENT points the other way; kinds that mean nothing for repositories are left out. One row of each (from, to, type, contracts), with the
    least evidence and the best confidence.
    """
    typed = {k: t for k, (t, _, _) in KINDS.items() if t}
    meta = F.create_map(*[x for k, t in typed.items() for x in (F.lit(k), F.lit(t))])
    turned = F.col("kind").isin(TURNED)
    a = specs.select(F.col("spec_id").alias("from_spec"), F.col("repo_id").alias("a_repo"), F.col("contract_id").alias("a_contract"))
    b = specs.select(F.col("spec_id").alias("to_spec"), F.col("repo_id").alias("b_repo"), F.col("contract_id").alias("b_contract"))
    j = relations.where(F.col("kind").isin(list(typed))).join(a, "from_spec").join(b, "to_spec").where("a_repo <> b_repo")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    out = j.select(
        pick("a_repo", "b_repo").alias("from_repo"), pick("b_repo", "a_repo").alias("to_repo"), meta[F.col("kind")].alias("type"),
        pick("a_contract", "b_contract").alias("source_contract"), pick("b_contract", "a_contract").alias("target_contract"), "evidence_id", "confidence",
    )
    return out.groupBy("from_repo", "to_repo", "type", "source_contract", "target_contract").agg(F.min("evidence_id").alias("evidence_id"), F.max("confidence").alias("confidence"))


def events(specs: DataFrame) -> DataFrame:
    """What semantic() makes of matching.event()'s relations, each with its from_spec as evidence, without their pairs: repositories meet once a topic.

    specs: spec_id, repo_id, contract_id, role, topic, payload. The confidence is the best of all pairs: 0.95 where a payload lacks on either side or two
    are equal, which is a join of the distinct payloads of repositories; else 0.85.
    """
    specs = specs.where("spec_id is not null and repo_id is not null").withColumn("topic", event_key(F.col("topic")))

    def side(name: str, roles: tuple[str, ...]) -> DataFrame:
        of = specs.where(F.col("role").isin(*roles)).groupBy("topic", "repo_id", "contract_id", "payload").agg(F.min("spec_id").alias("least"))
        return of.select(*[F.col(x).alias(f"{name}_{x}") for x in of.columns])

    p, c = side("p", ("producer", "owner", "shared")), side("c", ("consumer", "shared"))
    whole = lambda df, n: df.groupBy(f"{n}_topic", f"{n}_repo_id", f"{n}_contract_id").agg(F.min(f"{n}_least").alias(f"{n}_least"), F.bool_or(F.col(f"{n}_payload").isNull()).alias(f"{n}_lacks"))
    topic, other = F.col("p_topic") == F.col("c_topic"), F.col("p_repo_id") != F.col("c_repo_id")
    ends = [F.col("c_repo_id").alias("from_repo"), F.col("p_repo_id").alias("to_repo"), F.col("c_contract_id").alias("source_contract"), F.col("p_contract_id").alias("target_contract")]
    met = whole(p, "p").join(whole(c, "c"), topic & other).select(*ends, F.least("p_least", "c_least").alias("evidence_id"), F.when(F.col("p_lacks") | F.col("c_lacks"), 0.95).otherwise(0.85).alias("confidence"))
    equal = p.join(c, topic & (F.col("p_payload") == F.col("c_payload")) & other).select(*ends, F.least("p_least", "c_least").alias("evidence_id"), F.lit(0.95).alias("confidence"))
    out = met.unionByName(equal).groupBy("from_repo", "to_repo", "source_contract", "target_contract").agg(F.min("evidence_id").alias("evidence_id"), F.max("confidence").alias("confidence"))
    return out.select("from_repo", "to_repo", F.lit("event").alias("type"), "source_contract", "target_contract", "evidence_id", "confidence")


def merged(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """All of first, and of second what has no equal key there."""
    return first.unionByName(second.join(first.select(*by).distinct(), by, "left_anti"))


def path_bridge(edges: DataFrame) -> DataFrame:
    """from_repo, to_repo, path, confidence: keys without a method meet keys with one on the bare path, at 0.6 at most. edges: repo_id, role, key, confidence."""
    e = edges.withColumn("bare", F.regexp_replace("key", "^[A-Z]+:", "")).withColumn("open", ~F.col("key").rlike("^[A-Z]+:")).groupBy("repo_id", "role", "bare", "open").agg(F.max("confidence").alias("confidence"))
    c = e.where("role = 'consumer'").select(F.col("repo_id").alias("from_repo"), "bare", F.col("open").alias("co"), F.col("confidence").alias("cc"))
    p = e.where("role = 'producer'").select(F.col("repo_id").alias("to_repo"), "bare", F.col("open").alias("po"), F.col("confidence").alias("pc"))
    j = c.join(p, "bare").where("co <> po and from_repo <> to_repo")
    return j.groupBy("from_repo", "to_repo", F.col("bare").alias("path")).agg(F.max(F.least("cc", "pc", F.lit(0.6))).alias("confidence"))
