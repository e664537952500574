"""Targets, traces and impacts over relations: what a change of a contract reaches, and how grave that is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.operators import matching as M
from specgraph.operators.dependencies import KINDS, TURNED
from specgraph.operators.fields import field_references
from specgraph.operators.paths import cut
from specgraph.operators.relations import field

# Words that name a kind in front of a key, and the kind of spec that each means.
TARGET_KINDS = {
    "http": "http-endpoint", "api": "http-endpoint", "event": "event", "schema": "schema", "dto": "schema", "grpc": "grpc-method", "dubbo": "dubbo-method",
    "graphql": "graphql-operation", "package": "package", "config": "config",
}
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")


def _path(text: str) -> str:
    text = re.sub(r"(?i)^https?://[^/]+", "", text.strip())
    text = re.sub(r"\?.*$", "", text)
    text = re.sub(r"/:([A-Za-z_]\w*)", r"/{\1}", text)
    text = re.sub(r"\$\{([A-Za-z_]\w*)\}", r"{\1}", text)
    text = re.sub(r"\$\{[^}]+\}", "{param}", text)
    text = re.sub(r"/+", "/", text if text.startswith("/") else f"/{text}")
    return re.sub(r"/$", "", text) or "/"


def http_key(path: str, method: str | None = None) -> str:
    """The key of an endpoint: METHOD:/path, or the path alone; addresses of other schemes keep theirs."""
    path = path.strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not re.match(r"(?i)https?://", path):
        got = re.sub(r"/$", "", re.sub(r"/+", "/", re.sub(r"\?.*$", "", path)))
    else:
        got = _path(path)
    return f"{method.strip().upper()}:{got.lower()}" if method else got.lower()


def target(text: str) -> str:
    """Free text as kind:key: 'GET /a', 'api GET:/a', 'event Order.Created', 'dto Order', 'dubbo a.B#c', 'graphql order'. Other text as it is, trimmed."""
    text = text.strip()
    if not text:
        return text
    m = re.match(r"(?s)([A-Za-z]+)(?::|\s)(.*)", text)
    kind, rest = (m[1].lower(), m[2].strip()) if m and m[1].lower() in TARGET_KINDS else ("", text)
    if not kind and len(words := text.split()) > 1 and words[0].upper() in VERBS:
        kind = "http"
    if kind in ("http", "api"):
        m = re.match(r"(?s)([^\s:]+)[\s:](.*)", rest)
        method = m[1].upper() if m and m[1].upper() in VERBS else None
        return f"http:{http_key(m[2].strip() if method else rest, method)}"
    if kind == "event":
        return f"event:{rest.lower()}"
    if kind in ("schema", "dto"):
        return f"schema:{rest}"
    if kind == "grpc":
        head, slash, method = re.sub(r"\s+", "", rest).rpartition("/")
        owner, _, service = (head or method if slash else method).rpartition(".")
        name = f"{owner.lower()}.{service}" if owner else service
        return f"grpc:{name}/{method}" if slash and method else f"grpc:{name}"
    if kind == "dubbo":
        face, _, method = rest.partition("#")
        face, method = re.sub(r"\s+", "", face).lower(), method.strip()
        return f"dubbo:{face}#{method}" if method else f"dubbo:{face}"
    if kind == "graphql":
        of, dot, name = rest.partition(".")
        return f"graphql:{of.strip().lower()}.{name.strip()}" if dot else f"graphql:query.{rest.strip()}"
    return f"{kind}:{rest}" if kind else text


def target_specs(specs: DataFrame, text: str) -> DataFrame:
    """The specs that a target means: of its kind, with its key, a contract that ends with :key, or (schemas) its name. Text without a kind is a schema's name."""
    kind, colon, key = target(text).partition(":")
    if not colon:
        kind, key = "schema", kind
    hit = (F.col("key") == key) | F.col("contract_id").endswith(f":{key}") | ((F.col("spec_kind") == "schema") & F.coalesce(field("name") == key, F.lit(False)))
    return specs.where((F.col("spec_kind") == TARGET_KINDS.get(kind, kind)) & hit)


_FLOW = [k for k, (_, _, c) in KINDS.items() if c != "intra-spec"]


def roots(matched: DataFrame, relations: DataFrame) -> DataFrame:
    """spec_id: of matched specs that relations link with one another the producing ends; all of them where none are linked."""
    ids = matched.select("spec_id").distinct()
    inner = relations.where(F.col("kind").isin(_FLOW)).join(ids.select(F.col("spec_id").alias("from_spec")), "from_spec", "left_semi").join(ids.select(F.col("spec_id").alias("to_spec")), "to_spec", "left_semi")
    ends = inner.select(F.when(F.col("kind").isin(TURNED), F.col("from_spec")).otherwise(F.col("to_spec")).alias("spec_id")).distinct()
    return ends.unionByName(ids.join(ends.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left_anti"))


def _others(front: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """spec_id of what shares a home with a spec of front other than itself: here and there are callers and served or the reverse. A home's least and
    greatest of front tell all that this needs, so no pair is made."""
    ends = here.join(front.select("spec_id"), "spec_id").groupBy("home").agg(F.min("spec_id").alias("__a"), F.max("spec_id").alias("__b"))
    return there.join(ends, "home").where("spec_id <> __a or spec_id <> __b").select("spec_id")


def trace(relations: DataFrame, specs: DataFrame, starts: DataFrame, max_hops: int = 3, direction: str = "both") -> tuple[DataFrame, DataFrame, bool]:
    """nodes (spec_id, hop, role), edges (from_spec, to_spec, kind, inferred, confidence, hop, direction), and whether a last node has further neighbours.

    Breadth first from starts (spec_id), outward and inward each by itself, over relations and inferred internal calls. A node reached both ways has the
    hop and role ('downstream', 'upstream', 'target') of the outward walk; an edge met twice is that walk's. Nodes are found without the pairs of internal
    calls; edges, which have them, are worked out when they are read.
    """
    known = cut(relations.select("from_spec", "to_spec", "kind", F.lit(False).alias("inferred"), "confidence"))
    calling, serving = cut(M.callers(relations, specs)), cut(M.served(specs))
    nodes = starts.select("spec_id").distinct().select("spec_id", F.lit(0).alias("hop"), F.lit("target").alias("role"))
    edges, more = None, False
    for way in ("outgoing", "incoming"):
        if direction not in (way, "both"):
            continue
        here, there = ("from_spec", "to_spec") if way == "outgoing" else ("to_spec", "from_spec")
        begin, end = (serving, calling) if way == "outgoing" else (calling, serving)

        def beside(front: DataFrame) -> DataFrame:
            along = known.join(front.select(F.col("spec_id").alias(here)), here, "left_semi").select(F.col(there).alias("spec_id"))  # noqa: B023
            return along.unionByName(_others(front, begin, end))  # noqa: B023

        def met(front: DataFrame) -> DataFrame:
            along = known.join(front.select(F.col("spec_id").alias(here)), here, "left_semi")  # noqa: B023
            some = begin.join(front.select("spec_id"), "spec_id", "left_semi")  # noqa: B023
            inner = M.inner_pairs(end, some) if way == "outgoing" else M.inner_pairs(some, end)  # noqa: B023
            return along.unionByName(inner.select("from_spec", "to_spec", F.lit("INTERNAL_CALL").alias("kind"), F.lit(True).alias("inferred"), "confidence"))

        front = cut(starts.select("spec_id").distinct())
        seen, walked = [front.withColumn("hop", F.lit(0))], []
        for hop in range(1, max_hops + 1):
            walked.append(met(front).withColumn("hop", F.lit(hop)).withColumn("direction", F.lit(way)))
            new = beside(front).distinct()
            for old in seen:
                new = new.join(old.select("spec_id"), "spec_id", "left_anti")
            front = cut(new)
            if front.isEmpty():
                break
            seen.append(front.withColumn("hop", F.lit(hop)))
            if hop == max_hops:
                more = more or not beside(front).isEmpty()
        for part in seen[1:]:
            fresh = part.select("spec_id", "hop", F.lit("downstream" if way == "outgoing" else "upstream").alias("role"))
            nodes = nodes.unionByName(fresh)
        for part in walked:
            edges = part if edges is None else edges.unionByName(part)
    rank = F.when(F.col("role") == "target", 0).when(F.col("role") == "downstream", 1).otherwise(2)
    nodes = nodes.groupBy("spec_id").agg(F.min(F.struct(rank.alias("r"), "hop", "role")).alias("m")).select("spec_id", "m.hop", "m.role")
    first = F.min(F.struct((F.col("direction") == "incoming").alias("in"), "hop", "direction", "confidence")).alias("m")
    edges = edges.groupBy("from_spec", "to_spec", "kind", "inferred").agg(first).select("from_spec", "to_spec", "kind", "inferred", "m.confidence", "m.hop", "m.direction")
    return nodes, edges, more


def _two(df: DataFrame, value: str) -> DataFrame:
    """home and value, the two least of each home: one is another than any given spec's."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy("home").orderBy(value))).where("__n <= 2").select("home", value)


def propagate(relations: DataFrame, specs: DataFrame, starts: DataFrame, max_hops: int = 3, downstream: bool = True) -> tuple[DataFrame, bool]:
    """spec_id, hop, via (spec_id), kind, inferred, via_from, via_to, confidence of everything that a change of starts (spec_id) reaches; starts at hop 0.

    An impact moves against forward relations and along turned ones; from a consumer to what serves its action in the same file; with downstream also from
    there to what the consumer calls. Each node comes once, at its first hop, by one step: a materialised one before an inferred one, then the most
    confident. Also whether more lies behind. A home's two best specs of the front stand for all of them, so internal calls aren't paired.
    """
    flow = relations.where(F.col("kind").isin(_FLOW))
    back = F.col("kind").isin(TURNED)
    direct = cut(flow.select(F.when(back, F.col("from_spec")).otherwise(F.col("to_spec")).alias("spec_id"), F.when(back, F.col("to_spec")).otherwise(F.col("from_spec")).alias("next"), "kind", F.col("from_spec").alias("via_from"), F.col("to_spec").alias("via_to"), "confidence"))
    calling, serving = cut(M.callers(relations, specs)), cut(M.served(specs))
    calls = cut(relations.where("kind in ('CALLS_ENDPOINT', 'SUBSCRIBES_EVENT')").select(F.col("from_spec").alias("via_from"), F.col("to_spec").alias("via_to"), F.least("confidence", F.lit(0.75)).alias("confidence")))

    def step(inferred: bool) -> Column:
        return F.struct(F.lit(inferred).alias("inferred"), (-F.col("confidence")).alias("c"), "kind", F.col("spec_id").alias("via"), "via_from", "via_to", "confidence").alias("s")

    def beside(front: DataFrame) -> DataFrame:
        at, inner = front.select("spec_id"), F.lit("INTERNAL_CALL").alias("kind")
        out = direct.join(at, "spec_id").select("next", step(False))
        lift = calling.join(at, "spec_id").select("home", "spec_id", inner, F.col("spec_id").alias("via_from"), "via_to", "confidence").select("home", step(True))
        out = out.unionByName(serving.select(F.col("spec_id").alias("next"), "home").join(_two(lift, "s"), "home").where("next <> s.via").select("next", "s"))
        if downstream:
            least = _two(serving.join(at, "spec_id").select("home", "spec_id"), "spec_id")
            down = calling.select(F.col("spec_id").alias("via_from"), "home").join(least, "home").where("via_from <> spec_id").groupBy("via_from").agg(F.min("spec_id").alias("spec_id"))
            out = out.unionByName(down.join(calls, "via_from").withColumn("kind", inner).select(F.col("via_to").alias("next"), step(True)))
        return out

    none = {"via": "string", "kind": "string", "inferred": "boolean", "via_from": "string", "via_to": "string", "confidence": "double"}
    front = cut(starts.select("spec_id").distinct().select("spec_id", F.lit(0).alias("hop"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))
    seen, more = [front], False
    for hop in range(1, max_hops + 1):
        new = beside(front).groupBy("next").agg(F.min("s").alias("s")).select(F.col("next").alias("spec_id"), F.lit(hop).alias("hop"), "s.via", "s.kind", "s.inferred", "s.via_from", "s.via_to", "s.confidence")
        for old in seen:
            new = new.join(old.select("spec_id"), "spec_id", "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        seen.append(front)
    else:
        rest = beside(front).select(F.col("next").alias("spec_id"))
        for old in seen:
            rest = rest.join(old.select("spec_id"), "spec_id", "left_anti")
        more = not rest.isEmpty()
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out, more


def summary(kind: Column) -> Column:
    """One line about a spec of its kind, from its payload and key."""
    part = lambda label, name: F.concat(F.lit(f"{label}="), field(name))
    join = lambda *c: F.concat_ws("  ", *c)
    many = F.array_join(F.from_json(F.get_json_object("spec", "$.requestTypes"), "array<string>"), ",")
    n = F.coalesce(F.expr("json_array_length(get_json_object(spec, '$.fields'))"), F.lit(0))
    got = (
        F.when(kind == "http-endpoint", join(F.concat_ws(" ", F.coalesce(field("method"), F.lit("ANY")), field("path")), part("request", "requestBodyType"), part("response", "responseBodyType")))
        .when(kind == "event", join(part("topic", "topic"), part("payload", "payloadType"), F.when(field("broker") != "unknown", part("broker", "broker"))))
        .when(kind == "schema", F.concat(field("name"), F.lit(" ("), n.cast("string"), F.when(n == 1, " field)").otherwise(" fields)")))
        .when(kind == "grpc-method", join(field("fullName"), part("request", "requestType"), part("response", "responseType"), part("streaming", "streaming")))
        .when(kind == "dubbo-method", join(field("fullName"), F.when(many != "", F.concat(F.lit("request="), many)), part("response", "responseType"), part("group", "group"), part("version", "version")))
        .when(kind == "graphql-operation", join(field("fullName"), part("request", "requestType"), part("response", "responseType"), part("source", "source")))
    )
    return F.coalesce(F.when(got != "", got), F.col("key"))


def semantic_impact(specs: DataFrame, relations: DataFrame, text: str, max_hops: int = 3) -> tuple[DataFrame, bool]:
    """The specs that a change of the target reaches, with hop, step and summary, and whether more lies behind; affected repositories and files are its distinct columns."""
    reached, more = propagate(relations, specs, roots(target_specs(specs, text), relations), max_hops)
    out = reached.withColumnRenamed("confidence", "step_confidence").join(specs, "spec_id")
    return out.select("spec_id", "contract_id", "spec_kind", "key", "repo_id", "file_id", "hop", summary(F.col("spec_kind")).alias("summary"), "confidence", F.col("kind").alias("relation"), "inferred", "via").orderBy("hop", "repo_id", "key", "spec_id"), more


# The severities of changes by kind of spec; field changes of a schema's own field are breaking unless the field is optional.
_RPC = {"rpc-removed": "breaking", "rpc-renamed": "breaking", "rpc-signature-change": "risky"}
_FIELDS = {"field-removed": "risky", "field-type-changed": "risky", "field-added": "compatible"}
SEVERITY = {
    "http-endpoint": {"endpoint-removed": "breaking", "endpoint-renamed": "breaking", "endpoint-schema-change": "risky", **_FIELDS},
    "event": {"topic-removed": "breaking", "topic-renamed": "breaking", "event-payload-change": "risky", **_FIELDS},
    "schema": {"field-removed": "breaking", "field-type-changed": "risky", "field-added": "compatible"},
    "grpc-method": {**_RPC, **_FIELDS},
    "dubbo-method": {**_RPC, **_FIELDS},
    "graphql-operation": {**_RPC, **_FIELDS},
}
RANK = ("compatible", "risky", "breaking")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(kind, change, severity) for kind, of in SEVERITY.items() for change, severity in of.items()]
    return spark.createDataFrame(rows, "spec_kind string, change_type string, severity string")


def graded(changes: DataFrame) -> DataFrame:
    """changes (spec_kind, change_type, optional, confidence) with a severity and whether a rule gave it.

    A removed field is risky where optional. A schema takes any other change as risky. What no rule knows is risky at a confidence of 0.6 at most; a
    kind of spec that is unknown altogether is risky at 0.4 at most.
    """
    j = changes.join(F.broadcast(rules(changes.sparkSession)), ["spec_kind", "change_type"], "left")
    schema, known = F.col("spec_kind") == "schema", F.col("spec_kind").isin(*SEVERITY)
    severity = F.when(schema & (F.col("change_type") == "field-removed") & F.coalesce("optional", F.lit(False)), "risky").otherwise(F.coalesce("severity", F.lit("risky")))
    ruled = F.col("severity").isNotNull() | schema
    confidence = F.when(~known, F.least("confidence", F.lit(0.4))).when(~ruled, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence"))
    return j.withColumn("confidence", confidence).withColumn("ruled", ruled).withColumn("severity", severity)


def worst(severity: Column) -> Column:
    """The gravest of a group's severities; compatible for none."""
    rank = F.max(F.array_position(F.array(*map(F.lit, RANK)), severity))
    return F.element_at(F.array(*map(F.lit, RANK)), F.coalesce(rank, F.lit(1)).cast("int"))


def change_impact(specs: DataFrame, relations: DataFrame, text: str, change_type: str, detail: str | None = None, max_hops: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """repo_id, file_id, line, symbol, relation, severity, confidence, spec_id: what a proposed change of the target affects.

    The target itself (relation IMPACTS, where a rule of its own knows the change), what upstream steps reach, and with sources (repo_id, file_id, path,
    source), for a schema's field, the lines that touch it. Of rows with one (repo, file, symbol, relation, line) the most confident stays, then the gravest.
    """
    top = cut(roots(target_specs(specs, text), relations))
    reached, _ = propagate(relations, specs, top, max_hops, downstream=False)
    named = F.from_json(F.get_json_object("spec", "$.fields"), "array<struct<name:string,optional:boolean>>")
    optional = F.get(F.filter(named, lambda x: x["name"] == F.lit(detail)), 0)["optional"] if detail else F.lit(None).cast("boolean")
    symbol = F.when(F.col("spec_kind") == "schema", F.concat_ws(".", field("name"), F.lit(detail))).otherwise(F.col("key"))
    base = specs.select("spec_id", "spec_kind", "repo_id", "file_id", "spec", "key", F.col("confidence").alias("own"), optional.alias("optional"), F.lit(change_type).alias("change_type"), symbol.alias("symbol"))
    own = base.join(top, "spec_id", "left_semi").withColumn("relation", F.lit("IMPACTS")).withColumn("confidence", F.col("own"))
    step = reached.where("hop > 0").select("spec_id", F.col("kind").alias("relation"), "confidence", "via_from", "via_to")
    # The relation that a bridged step goes back to.
    source = relations.select(F.col("from_spec").alias("via_from"), F.col("to_spec").alias("via_to"), F.col("kind").alias("k")).groupBy("via_from", "via_to").agg(F.min("k").alias("k"))
    step = step.join(source, ["via_from", "via_to"], "left").select("spec_id", F.when(F.col("relation") == "INTERNAL_CALL", F.col("k")).otherwise(F.col("relation")).alias("relation"), "confidence")
    found = graded(own).where("ruled and (spec_kind = 'schema') = (change_type like 'field-%')").unionByName(graded(base.join(step, "spec_id")))
    found = found.withColumn("confidence", F.when(F.col("ruled"), F.col("confidence")).otherwise(F.least("confidence", "own"))).withColumn("line", F.lit(None).cast("int"))
    columns = ["repo_id", "file_id", "line", "symbol", "relation", "severity", "confidence", "spec_id"]
    out = found.select(*columns)
    if sources is not None and detail:
        schema = specs.join(top, "spec_id", "left_semi").where("spec_kind = 'schema'").select(F.lit(True).alias("__schema")).limit(1)
        files = sources.join(found.select("repo_id", "file_id").distinct(), ["repo_id", "file_id"], "left_semi").join(schema, F.lit(True), "left_semi")
        lines = field_references(files.select(F.struct("repo_id", "file_id").alias("file_id"), "path", "source"), detail).select("file_id.repo_id", "file_id.file_id", "line")
        severity = {"field-removed": "breaking", "field-added": "compatible"}.get(change_type, "risky")
        users = found.select("repo_id", "file_id", "spec_id", F.col("own").alias("confidence")).distinct()
        name = f"{text.split(':')[-1]}.{detail}"
        out = out.unionByName(users.join(lines, ["repo_id", "file_id"]).select("repo_id", "file_id", "line", F.lit(name).alias("symbol"), F.lit("USES_SCHEMA").alias("relation"), F.lit(severity).alias("severity"), "confidence", "spec_id"))
    grave = F.array_position(F.array(*map(F.lit, RANK)), F.col("severity"))
    best = F.max(F.struct("confidence", grave.alias("g"), "severity", "spec_id")).alias("b")
    return out.groupBy("repo_id", "file_id", "symbol", "relation", "line").agg(best).select("repo_id", "file_id", "line", "symbol", "relation", "b.severity", "b.confidence", "b.spec_id")


def roll_up(impacts: DataFrame) -> DataFrame:
    """overall, breaking, risky, compatible: one row."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return impacts.agg(worst(F.col("severity")).alias("overall"), *[n(s) for s in reversed(RANK)])
