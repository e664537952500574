"""Producers matched with consumers across repositories.

Specs come with a role: 'owner' counts as a producer, 'shared' as both sides. A spec never matches its own repository.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.functions import keys

#: Of several roles that a repository has in a contract the first counts.
ROLES = ("owner", "producer", "consumer", "shared")


def with_roles(specs: DataFrame, edges: DataFrame) -> DataFrame:
    """specs (contract_id, repo_id, …) and a column role: of the repository's edges to the contract the first in ROLES, 'shared' without any."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    first = edges.groupBy("contract_id", "repo_id").agg(F.min(rank).alias("__rank"))
    named = F.element_at(F.array(*map(F.lit, ROLES)), F.col("__rank").cast("int"))
    return specs.join(first, ["contract_id", "repo_id"], "left").withColumn("role", F.coalesce(named, F.lit("shared"))).drop("__rank")


def _sides(specs: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Producers and consumers, their columns prefixed p_ and c_."""
    take = lambda side, roles: specs.where(F.col("role").isin(*roles)).select(*[F.col(x).alias(f"{side}_{x}") for x in columns])
    return take("p", ("producer", "owner", "shared")), take("c", ("consumer", "shared"))


#: Fixed value: into how many shares the consumers of a key are dealt, each of which meets all of its producers in a task of its own.
SHARES = 8


def meet(p: DataFrame, c: DataFrame, keys_p: list[str], keys_c: list[str], others: Column, by: str = "c_spec_id") -> DataFrame:
    """p joined with c by equal keys where others holds: a hash join that holds a share's rows of p and streams c, so nothing is sorted, buffered by key or spilled however
    busy a key is, and a busy key is dealt over SHARES tasks. p comes SHARES times, the pairs aren't shuffled."""
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number, or tasks of little input would be merged, however many pairs they make
    p = p.withColumn("__of_p", F.explode(F.array(*map(F.lit, range(SHARES))))).repartition(n, *map(F.col, keys_p), "__of_p")
    c = c.withColumn("__of_c", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int")).repartition(n, *map(F.col, keys_c), "__of_c")
    same = [F.col(a) == F.col(b) for a, b in zip((*keys_p, "__of_p"), (*keys_c, "__of_c"), strict=True)]
    return p.hint("shuffle_hash").join(c, reduce(and_, same) & others).drop("__of_p", "__of_c")


def _segments(c) -> Column:
    return F.filter(F.split(c, "/"), lambda s: s != "")


def _open(s: Column) -> Column:
    return s.rlike(r"^\{.+\}$")


def _mask(path: Column) -> Column:
    """A mark for each segment: 1 for a template's, 0 for another."""
    return F.transform(_segments(path), lambda s: F.when(_open(s), 1).otherwise(0))


def _keyed(paths: DataFrame, side: str, others: DataFrame) -> DataFrame:
    """paths (path, mask) once for each mask of as many segments on the other side: what is left of them where neither has a template."""
    met = paths.join(others.select(F.col("mask").alias("other")).distinct(), F.size("mask") == F.size("other")).where(F.array_contains("mask", 1) | F.array_contains("other", 1))
    left = F.transform(_segments(F.col("path")), lambda s, i: F.when((F.get("mask", i) == 0) & (F.get("other", i) == 0), s))
    return met.select(F.col("path").alias(f"{side}_near"), F.col("mask").alias(f"{side}_mask"), F.col("other").alias(f"{side}_other"), left.alias(f"{side}_left"))


def _near(p: DataFrame, c: DataFrame) -> DataFrame:
    """p_near, c_near: different paths of equal length, one of them a template at least, that agree segment by segment, a template segment with anything.

    Two paths agree if they are equal where neither has a template: an equi-join for each pair of masks, of which there are few. No pair is compared.
    """
    of = lambda df, side: df.select(F.col(f"{side}_path").alias("path")).distinct().withColumn("mask", _mask(F.col("path")))
    p, c = of(p, "p"), of(c, "c")
    keys_p, keys_c = ["p_mask", "p_other", "p_left"], ["c_other", "c_mask", "c_left"]
    return meet(_keyed(p, "p", c), _keyed(c, "c", p), keys_p, keys_c, F.col("p_near") != F.col("c_near"), "c_near").select("p_near", "c_near")


def http(specs: DataFrame) -> DataFrame:
    """consumer, producer, kind, confidence: per consumer and producing repository the best kind of match only.

    specs: spec_id, repo_id, role, method, path. Equi-joins only: equal paths by path; templates by what is left of a path where neither side has a
    template. The two branches don't overlap.
    """
    specs = specs.withColumn("path", F.lower("path")).withColumn("open", F.array_contains(_mask(F.col("path")), 1))
    p, c = _sides(specs, ("spec_id", "repo_id", "method", "path", "open"))
    fits = (F.col("c_repo_id") != F.col("p_repo_id")) & F.coalesce(F.col("c_method") == F.col("p_method"), F.lit(True))
    equal = meet(p, c, ["p_path"], ["c_path"], fits)
    near = meet(p, c.join(_near(p, c), F.col("c_path") == F.col("c_near")), ["p_path"], ["p_near"], fits)
    pairs = equal.unionByName(near.select(*equal.columns))
    same = F.col("c_path") == F.col("p_path")
    # The classes and their confidence. What begins with a template falls into a class before 'wildcard', so that one stays empty.
    kind = (
        F.when(same & (F.col("c_method") == F.col("p_method")), "exact").when(same, "path-only").when(F.col("p_open") != F.col("c_open"), "static-to-template")
        .when(F.col("p_open") & F.col("c_open"), "template-compatible").otherwise("wildcard")
    )
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "path-only", 1).otherwise(2)
    confidence = F.when(F.col("kind") == "exact", 0.95).when(F.col("kind") == "path-only", 0.75).when(F.col("kind") == "wildcard", 0.8).otherwise(0.9)
    pairs = pairs.withColumn("kind", kind).withColumn("rank", rank).withColumn("best", F.min("rank").over(W.partitionBy("c_spec_id", "p_repo_id")))
    return pairs.where("rank = best").select(F.col("c_spec_id").alias("consumer"), F.col("p_spec_id").alias("producer"), "kind", confidence.alias("confidence")).distinct()


def event(specs: DataFrame) -> DataFrame:
    """from_spec, to_spec, kind, confidence: PUBLISHES_EVENT and SUBSCRIBES_EVENT of each producer and consumer of a topic in different repositories.

    specs: spec_id, repo_id, role, topic, payload. One join; each pair then gives both edges. There are as many
    pairs as producers times consumers of a topic.
    """
    p, c = _sides(specs.withColumn("topic", keys.event_key(F.col("topic"))), ("spec_id", "repo_id", "topic", "payload"))
    pairs = meet(p, c, ["p_topic"], ["c_topic"], F.col("p_repo_id") != F.col("c_repo_id"))
    conf = F.when(F.col("p_payload").isNotNull() & F.col("c_payload").isNotNull() & (F.col("p_payload") != F.col("c_payload")), 0.85).otherwise(0.95)
    edge = lambda a, b, k: F.struct(F.col(a).alias("from_spec"), F.col(b).alias("to_spec"), F.lit(k).alias("kind"), conf.alias("confidence"))
    return pairs.select(F.inline(F.array(edge("p_spec_id", "c_spec_id", "PUBLISHES_EVENT"), edge("c_spec_id", "p_spec_id", "SUBSCRIBES_EVENT"))))


def rpc(specs: DataFrame) -> DataFrame:
    """consumer, producer, confidence by service and method, whatever the packages: equal (or both missing) 0.95, one missing 0.9, different 0.8."""
    p, c = _sides(specs, ("spec_id", "repo_id", "package", "service", "method"))
    pairs = meet(p, c, ["p_service", "p_method"], ["c_service", "c_method"], F.col("p_repo_id") != F.col("c_repo_id"))
    conf = F.when(F.col("p_package").eqNullSafe(F.col("c_package")), 0.95).when(F.col("p_package").isNull() | F.col("c_package").isNull(), 0.9).otherwise(0.8)
    return pairs.select(F.col("c_spec_id").alias("consumer"), F.col("p_spec_id").alias("producer"), conf.alias("confidence"))


def dubbo(specs: DataFrame) -> DataFrame:
    """consumer, producer, confidence by interface (case and white space aside) and method; a missing or '*' method on either side fits every one (0.6).

    specs: spec_id, repo_id, role, interface, method, group, version. Groups or versions that differ 0.8, one missing 0.9, equal 0.95. Named methods
    meet on (interface, method); only open ones meet a whole interface.
    """
    blank = lambda c: F.when(F.trim(c) != "", c)
    named = F.when(F.col("method") != "*", blank(F.col("method")))
    specs = specs.withColumn("interface", F.lower(F.regexp_replace("interface", r"\s+", ""))).withColumn("method", named).withColumn("group", blank(F.col("group"))).withColumn("version", blank(F.col("version")))
    p, c = _sides(specs, ("spec_id", "repo_id", "interface", "method", "group", "version"))
    other = F.col("p_repo_id") != F.col("c_repo_id")
    exact = meet(p.where("p_method is not null"), c.where("c_method is not null"), ["p_interface", "p_method"], ["c_interface", "c_method"], other)
    open_c = meet(p, c.where("c_method is null"), ["p_interface"], ["c_interface"], other)
    open_p = meet(p.where("p_method is null"), c.where("c_method is not null"), ["p_interface"], ["c_interface"], other)
    pairs = exact.unionByName(open_c).unionByName(open_p)
    differ = F.coalesce((F.col("p_group") != F.col("c_group")), F.lit(False)) | F.coalesce((F.col("p_version") != F.col("c_version")), F.lit(False))
    lacks = F.col("p_group").isNull() | F.col("c_group").isNull() | F.col("p_version").isNull() | F.col("c_version").isNull()
    conf = F.when(F.col("p_method").isNull() | F.col("c_method").isNull(), 0.6).when(differ, 0.8).when(lacks, 0.9).otherwise(0.95)
    return pairs.select(F.col("c_spec_id").alias("consumer"), F.col("p_spec_id").alias("producer"), conf.alias("confidence"))


def exact_key(specs: DataFrame) -> DataFrame:
    """consumer, producer of equal keys in different repositories."""
    p, c = _sides(specs, ("spec_id", "repo_id", "key"))
    pairs = meet(p, c, ["p_key"], ["c_key"], F.col("p_repo_id") != F.col("c_repo_id"))
    return pairs.select(F.col("c_spec_id").alias("consumer"), F.col("p_spec_id").alias("producer"), F.lit(0.95).alias("confidence"))


def schema_lookup(refs: DataFrame, schemas: DataFrame) -> DataFrame:
    """ref_id, spec_id: a name's schema, if after preferring equal case, then the same repository, exactly one is left.

    refs: ref_id, repo_id, name; schemas: spec_id, repo_id, name. Schemas are counted per spelling and repository, and per spelling, before anything
    meets them: a busy name costs a row for each of its spellings, not for each schema.
    """
    folded = F.lower("name").alias("__folded")
    own = schemas.groupBy("name", "repo_id").agg(F.count("*").alias("n1"), F.min("spec_id").alias("s1"))
    name = schemas.groupBy("name").agg(F.count("*").alias("n2"), F.min("spec_id").alias("s2"))
    own_fold = schemas.groupBy(folded, "repo_id").agg(F.count("*").alias("n3"), F.min("spec_id").alias("s3"))
    fold = schemas.groupBy(folded).agg(F.count("*").alias("n4"), F.min("spec_id").alias("s4"))
    j = refs.select("ref_id", "repo_id", "name", folded).join(own, ["name", "repo_id"], "left").join(name, "name", "left").join(own_fold, ["__folded", "repo_id"], "left").join(fold, "__folded", "left")
    one = lambda n, s: F.when(F.col(n) == 1, F.col(s))
    found = (
        F.when(F.col("n1").isNotNull(), one("n1", "s1")).when(F.col("n2").isNotNull(), one("n2", "s2"))
        .when(F.col("n3").isNotNull(), one("n3", "s3")).otherwise(one("n4", "s4"))
    )
    return j.select("ref_id", found.alias("spec_id")).where("spec_id is not null").distinct()


def best_edges(edges: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order given."""
    return edges.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def action(kind: Column, key: Column, path: Column, topic: Column, event_name: Column) -> Column:
    """What a spec does, by the last part of its path, method, field, event name or topic; lower case, null if there is none."""
    last = lambda c, by: F.try_element_at(F.filter(F.split(F.substring_index(c, "?", 1), by), lambda s: s != ""), F.lit(-1))
    bare = F.regexp_replace(key, r"^[^:]*:?", "")
    full = lambda c: F.when(c != "", c)
    got = (
        F.when(kind == "http-endpoint", last(F.coalesce(full(path), bare), "/")).when(kind == "dubbo-method", F.substring_index(key, "#", -1))
        .when(kind == "grpc-method", F.substring_index(key, "/", -1)).when(kind == "graphql-operation", F.substring_index(key, ".", -1))
        .when(kind == "event", F.coalesce(full(event_name), last(F.coalesce(full(topic), bare), "[./:]")))
    )
    return full(F.lower(got))


#: Kinds of specs that an outside caller reaches: what a consumer beside them in the same file may be called by.
ENTRIES = ("http-endpoint", "event", "graphql-operation")


def _homes(specs: DataFrame) -> DataFrame:
    """spec_id, home (repository, file, action), entry, and for specs of several homes all of them and those where they are entries."""
    home = F.struct("repo_id", "file_id", "action")
    of = specs.where("repo_id is not null and file_id is not null and action is not null").groupBy("spec_id")
    of = of.agg(F.collect_set(home).alias("all"), F.collect_set(F.when(F.col("spec_kind").isin(*ENTRIES), home)).alias("entries"))
    many = lambda c: F.when(F.size(c) > 1, F.col(c))
    return of.select("spec_id", F.explode("all").alias("home"), many("all").alias("all"), "entries").withColumn("entry", F.array_contains("entries", F.col("home"))).withColumn("entries", many("entries"))


def callers(relations: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, home, via_to, confidence of what calls through forward relations, the most confident of each; all where there are several homes."""
    used = relations.where("kind in ('CALLS_ENDPOINT', 'SUBSCRIBES_EVENT')").groupBy(F.col("from_spec").alias("spec_id")).agg(F.max(F.struct("confidence", "to_spec")).alias("via"))
    return used.join(_homes(specs), "spec_id").select("spec_id", "home", F.col("via.to_spec").alias("via_to"), F.least("via.confidence", F.lit(0.75)).alias("confidence"), "all")


def served(specs: DataFrame) -> DataFrame:
    """spec_id, home of what an outside caller reaches; entries where there are several homes."""
    return _homes(specs).where("entry").select("spec_id", "home", "entries")


def inner_pairs(calling: DataFrame, serving: DataFrame) -> DataFrame:
    """from_spec, to_spec, via_from, via_to, confidence of callers and served of one home, each pair once: where they share several homes at the first."""
    p = serving.select(F.col("spec_id").alias("p_spec_id"), F.col("home").alias("p_home"), "entries")
    c = calling.select(F.col("spec_id").alias("c_spec_id"), F.col("home").alias("c_home"), "via_to", "confidence", "all")
    once = F.coalesce(F.col("c_home") == F.array_min(F.array_intersect("all", "entries")), F.lit(True))
    pairs = meet(p, c, ["p_home"], ["c_home"], (F.col("p_spec_id") != F.col("c_spec_id")) & once)
    return pairs.select(F.col("p_spec_id").alias("from_spec"), F.col("c_spec_id").alias("to_spec"), F.col("c_spec_id").alias("via_from"), "via_to", "confidence")


def internal_calls(relations: DataFrame, specs: DataFrame) -> DataFrame:
    """from_spec, to_spec, via_from, via_to, confidence: within its file, a spec that serves an action calls the consumer of the same action.

    relations: from_spec, to_spec, kind, confidence, of which forward consumer-to-producer ones count; specs: spec_id, repo_id, file_id, spec_kind, action.
    Of several relations of one consumer the most confident counts. There are as many pairs as callers times served of a home; walks go by homes instead.
    """
    return inner_pairs(callers(relations, specs), served(specs))
