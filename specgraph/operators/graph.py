"""Reads over repositories, files, code, sections, entities and relations. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.functions.keys import band, is_active
from specgraph.operators.matching import ROLES
from specgraph.operators.reading import live, search


def stats(repos: DataFrame, files: DataFrame, code: DataFrame, sections: DataFrame, entities: DataFrame, contracts: DataFrame, deps: DataFrame) -> DataFrame:
    """One row of seven counts; inactive files, code, sections and dependencies don't count."""
    out = None
    for name, df in (("repos", repos), ("files", live(files)), ("code", live(code)), ("sections", live(sections)), ("entities", entities), ("contracts", contracts), ("dependencies", live(deps))):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def _placed(rows: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """Active rows (file_id, …) with the path of their active file and the name of its repository."""
    f = live(files).select("file_id", "repo_id", F.col("path").alias("file_path"))
    return live(rows).drop("repo_id", "active").join(f, "file_id").join(repos.select("repo_id", F.col("name").alias("repo_name")), "repo_id")


def search_code(repos: DataFrame, files: DataFrame, code: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return search(_placed(code, files, repos), ["name", "qualified_name", "summary", "file_path"], text, ["repo_id", "file_path", "code_id"], limit)


def find_impact(repos: DataFrame, files: DataFrame, code: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return search(_placed(code, files, repos), ["name", "qualified_name", "signature", "file_path"], text, ["repo_id", "file_path", "code_id"], limit)


def list_code(repos: DataFrame, files: DataFrame, code: DataFrame, limit: int = 50) -> DataFrame:
    return _placed(code, files, repos).orderBy("repo_id", "file_path", "code_id").limit(limit)


def search_sections(repos: DataFrame, files: DataFrame, sections: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return search(_placed(sections, files, repos), ["heading", "summary", "text", "file_path"], text, ["repo_id", "file_path", "section_id"], limit)


def sections_documenting(repos: DataFrame, files: DataFrame, sections: DataFrame, documents: DataFrame, codes: DataFrame, limit: int = 50) -> DataFrame:
    """Sections that document (section_id, code_id) one of the codes (code_id)."""
    hit = live(documents).join(codes.select("code_id").distinct(), "code_id", "left_semi").select("section_id").distinct()
    return _placed(sections, files, repos).join(hit, "section_id", "left_semi").orderBy("repo_id", "file_path", "section_id").limit(limit)


def has_symbol(code: DataFrame, name: str) -> bool:
    return not live(code).where((F.col("name") == name) | (F.col("qualified_name") == name)).isEmpty()


def source_symbols(specs: DataFrame, code: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, code_id, …: the symbols (source_symbol) that the contracts' (contract_id) specs come from."""
    s = live(specs).join(contracts.select("contract_id").distinct(), "contract_id", "left_semi").select("contract_id", F.col("source_symbol").alias("code_id")).distinct()
    return s.join(live(code).drop("active"), "code_id")


def producers(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    return live(edges).where("role = 'producer'").join(contracts, "contract_id").select("kind", "key", "repo_id")


def keys_of_kind(contracts: DataFrame, kind: str) -> DataFrame:
    return contracts.where(F.col("kind") == kind).select("key")


def keys_by_role(edges: DataFrame, contracts: DataFrame, kind: str, role: str) -> DataFrame:
    return live(edges).where(F.col("role") == role).join(contracts.where(F.col("kind") == kind), "contract_id").select("repo_id", "key")


def counts_by_role(edges: DataFrame, contracts: DataFrame, kind: str, role: str) -> DataFrame:
    """Edges, not contracts, are counted: one for each evidence."""
    return keys_by_role(edges, contracts, kind, role).groupBy("repo_id").agg(F.count("*").alias("n"))


#: Kinds of specs that have rules; others are opaque: kept in the graph, with a warning instead of a payload.
KNOWN = ("http-endpoint", "event", "schema", "grpc-method", "dubbo-method", "graphql-operation")


def semantic_graph(specs: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active specs, with a column warning that is null for known kinds, and active relations."""
    warning = F.when(~F.col("spec_kind").isin(*KNOWN), F.concat(F.lit("unknown spec kind: "), "spec_kind"))
    return live(specs).withColumn("warning", warning), live(relations)


def known_specs(specs: DataFrame) -> DataFrame:
    return live(specs).where(F.col("spec_kind").isin(*KNOWN))


def around(relations: DataFrame, specs: DataFrame, spec_id: str, direction: str = "both") -> DataFrame:
    """The active relations out of, into, or at a spec, with both ends' keys, kinds and repositories."""
    out_, in_ = F.col("from_spec") == spec_id, F.col("to_spec") == spec_id
    return ends(live(relations).where({"outgoing": out_, "incoming": in_}.get(direction, out_ | in_)), specs)


def ends(relations: DataFrame, specs: DataFrame) -> DataFrame:
    one = lambda side: specs.select(F.col("spec_id").alias(f"{side}_spec"), F.col("key").alias(f"{side}_key"), F.col("spec_kind").alias(f"{side}_kind"), F.col("repo_id").alias(f"{side}_repo"))
    j = relations.join(one("from"), "from_spec").join(one("to"), "to_spec")
    return j.select("from_spec", "to_spec", "kind", "confidence", "from_key", "from_kind", "from_repo", "to_key", "to_kind", "to_repo")


def between(relations: DataFrame, specs: DataFrame, from_repo: str, to_repo: str) -> DataFrame:
    """The active relations whose ends, active too, lie in one repository and the other."""
    return ends(live(relations), live(specs)).where((F.col("from_repo") == from_repo) & (F.col("to_repo") == to_repo))


def call_edges(calls: DataFrame, code: DataFrame, files: DataFrame, repos: DataFrame, codes: DataFrame, limit: int = 100) -> DataFrame:
    """Calls (from_code, to_code, confidence, resolution, raw) at either end of which one of the codes (code_id) stands; a missing resolution is the confidence's band."""
    mine = codes.select("code_id").distinct()
    near = lambda end: live(calls).join(mine, F.col(end) == F.col("code_id"), "left_semi")
    touched = near("from_code").unionByName(near("to_code")).distinct()
    side = lambda s: _placed(code, files, repos).select(F.col("code_id").alias(f"{s}_code"), F.col("qualified_name").alias(f"{s}_name"), F.concat_ws("/", "repo_name", "file_path").alias(f"{s}_file"))
    j = touched.join(side("from"), "from_code").join(side("to"), "to_code")
    resolution = F.when(F.coalesce("resolution", F.lit("")) == "", band(F.col("confidence"))).otherwise(F.col("resolution"))
    return j.select("from_name", "to_name", "from_file", "to_file", "confidence", resolution.alias("resolution"), "raw").orderBy("from_file", "from_name", "to_file", "to_name", "raw").limit(limit)


def trace_entity(term: str, mentions: DataFrame, contract_mentions: DataFrame, operations: DataFrame, workflows: DataFrame, limit: int = 100) -> DataFrame:
    """entity_name, repo_id, source_kind, name, path, line, role, evidence, confidence of everything about a term.

    mentions (of code and sections): entity_name, repo_id, source_kind, name, path, line, text, evidence, confidence, active; contract_mentions: entity_name,
    repo_id, kind, key, contract_name, role, path, line, evidence, confidence, active; operations: entity_name, repo_id, verb, description, role, confidence,
    active; workflows: entity_name, repo_id, name, description, step, role, confidence, active. Of each source at most `limit` rows in a total order, then of
    rows with one (repo, source, name, line, role) one, then `limit` in all.
    """
    hit = lambda df, *columns: search(live(df), list(columns), term, ["repo_id", *columns], limit)
    every = [hit(mentions.where(F.col("source_kind") == kind), "entity_name", "name", "text").select("entity_name", "repo_id", "source_kind", "name", "path", "line", F.lit("mentions").alias("role"), "evidence", "confidence") for kind in ("code", "section")]
    every += [hit(contract_mentions.where(F.col("role") == role), "entity_name", "contract_name", "key").select("entity_name", "repo_id", F.lit("contract").alias("source_kind"), F.concat_ws(":", "kind", "key").alias("name"), "path", "line", "role", "evidence", "confidence") for role in ROLES]
    none, zero = F.lit("").alias("path"), F.lit(0).cast("long").alias("line")
    every.append(hit(operations, "entity_name", "description").select("entity_name", "repo_id", F.lit("operation").alias("source_kind"), F.col("verb").alias("name"), none, zero, "role", F.col("description").alias("evidence"), "confidence"))
    every.append(hit(workflows, "name", "entity_name", "description").select("entity_name", "repo_id", F.lit("workflow").alias("source_kind"), "name", none, F.col("step").cast("long").alias("line"), "role", F.col("description").alias("evidence"), "confidence"))
    found = every[0]
    for part in every[1:]:
        found = found.unionByName(part)
    last = F.max(F.struct("confidence", "entity_name", "path", "evidence")).alias("m")
    one = found.groupBy("repo_id", "source_kind", "name", "line", "role").agg(last)
    return one.select("m.entity_name", "repo_id", "source_kind", "name", "m.path", "line", "role", "m.evidence", "m.confidence").orderBy("source_kind", "repo_id", "name", "line", "role").limit(limit)


def repo_list(repos: DataFrame) -> DataFrame:
    return repos.orderBy("name")


def known_hashes(files: DataFrame, repo: str) -> DataFrame:
    return files.where((F.col("repo_id") == repo) & is_active(F.col("active"))).select("file_id", "hash")
