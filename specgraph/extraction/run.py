"""Extraction over a table of files (repo_id, file_id, path, language, source): parsed tables, contract facts, and the graph's tables from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.extraction import contracts as C
from specgraph.extraction.parse import parse
from specgraph.functions.keys import normal_name
from specgraph.operators.writing import last_of_each

PARSED = (
    "repo_id string, file_id string, path string, language string, loc int, package string, imports array<struct<module:string,raw:string,line:int,bindings:array<struct<local:string,imported:string,kind:string>>>>, "
    "symbols array<struct<kind:string,name:string,qualified_name:string,start_line:int,end_line:int,signature:string,summary:string>>, calls array<struct<callee:string,receiver:string,args:int,line:int,raw:string>>, "
    "annotations array<struct<name:string,line:int,raw:string>>"
)


def parsed(files: DataFrame) -> DataFrame:
    """PARSED rows: what each file declares, imports and calls. A file that can't be read, or of a language without a reader, has empty lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, file, path, lang, text in zip(pdf["repo_id"], pdf["file_id"], pdf["path"], pdf["language"], pdf["source"], strict=True):
                p = parse(text or "", lang or "", path or "")
                marks = [{k: a[k] for k in ("name", "line", "raw")} for a in p["annotations"]] + [{"name": d["raw"].lstrip("@").split("(")[0], "line": d["line"], "raw": d["raw"]} for d in p.get("decorators", ())]
                rows.append((repo, file, path, lang, (text or "").count("\n") + 1, p.get("package"), p["imports"], p["symbols"], p["calls"], marks))
            yield pd.DataFrame(rows, columns=["repo_id", "file_id", "path", "language", "loc", "package", "imports", "symbols", "calls", "annotations"])

    return files.select("repo_id", "file_id", "path", "language", "source").mapInPandas(run, PARSED)


def symbols(rows: DataFrame) -> DataFrame:
    """code_id and a symbol's columns; code_id is made of repository, path, kind, qualified name and line."""
    s = rows.select("repo_id", "file_id", "path", F.inline("symbols"))
    return s.select(F.concat_ws(":", F.lit("code"), "repo_id", "path", "kind", "qualified_name", "start_line").alias("code_id"), "repo_id", "file_id", "kind", "name", "qualified_name", "start_line", "end_line", "signature", "summary")


def imports(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.inline("imports"))


def calls(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.inline("calls")).withColumnRenamed("args", "n_args")


def facts(files: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """C.FACT rows of all files. enabled: repo_id, reader (the names of the readers that may run there); without it all of them may."""
    columns = ["repo_id", "file_id", "path", "language", "source"]
    rows = files.select(*columns)
    if enabled is not None:
        rows = rows.join(enabled.groupBy("repo_id").agg(F.collect_set("reader").alias("readers")), "repo_id", "left")
    else:
        rows = rows.withColumn("readers", F.lit(None).cast("array<string>"))
    gated = enabled is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for *row, readers in pdf[[*columns, "readers"]].itertuples(index=False):
                if row[3]:
                    out += C.facts_of(C.File(*row[:4], row[4] or ""), set(readers if readers is not None else ()) if gated else None)
            yield pd.DataFrame(out, columns=C.NAMES)

    return rows.mapInPandas(run, C.FACT)


def resolve_sdk(found: DataFrame) -> DataFrame:
    """Facts with the calls of generated clients turned into consumers of the endpoints that their methods serve, in the same repository; mappings go."""
    sdk = found.where("kind = 'sdk'")
    mapping = sdk.where("role = 'mapping'").groupBy("repo_id", "key").agg(F.min("name").alias("endpoint"))
    used = sdk.where("role = 'call'").join(mapping, ["repo_id", "key"])
    method, path = F.regexp_extract("endpoint", "^([A-Z]+):", 1), F.regexp_replace("endpoint", "^[A-Z]+:", "")
    spec = F.to_json(F.struct(F.lit("http-endpoint").alias("kind"), F.when(method != "", method).alias("method"), path.alias("path"), path.alias("pathTemplate")))
    made = used.withColumn("kind", F.lit("api")).withColumn("key", F.col("endpoint")).withColumn("name", F.concat(F.lit("HTTP API "), path)).withColumn("role", F.lit("consumer")).withColumn("rule", F.lit("sdk-generated-client")).withColumn("spec_kind", F.lit("http-endpoint")).withColumn("spec", spec).withColumn("framework", F.lit("sdk"))
    return found.where("kind <> 'sdk'").unionByName(made.select(*C.NAMES))


def owners(found: DataFrame, repos: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Owner facts for consumed packages: the repository of that package name, else of an alias (name, normalised, without scope), the first by name.

    repos: repo_id, name, remote; overrides: alias, repo_id.
    """
    packages = found.where("rule = 'package-json-name'").select(F.lower("key").alias("package"), "repo_id", "file_id", "path", "line")
    spelled = lambda c: F.array(F.lower(c), normal_name(c), F.lower(F.regexp_replace(c, "^@[^/]+/", "")))
    given = repos.select("repo_id", F.explode(F.concat(spelled(F.col("name")), F.when(F.coalesce("remote", F.lit("")) != "", spelled(F.col("remote"))).otherwise(F.array().cast("array<string>")))).alias("alias"))
    given = given.union(found.where("rule = 'package-json-name'").select("repo_id", F.explode(spelled(F.col("key"))).alias("alias")))
    if overrides is not None:
        given = given.union(overrides.select("repo_id", F.explode(spelled(F.col("alias"))).alias("alias")))
    order = repos.select("repo_id", F.col("name").alias("order"))
    wanted = found.where("kind = 'package' and role = 'consumer' and rule = 'package-json-dependency'").select(F.col("key").alias("package_name")).distinct()
    exact = wanted.join(packages, F.lower("package_name") == F.col("package")).join(order, "repo_id").select("package_name", "repo_id", "file_id", "path", "line", "order", F.lit(True).alias("named"))
    tried = wanted.select("package_name", F.explode(F.array_distinct(F.array(F.lower("package_name"), normal_name(F.col("package_name"))))).alias("alias"))
    by_alias = tried.join(given, "alias").join(order, "repo_id").select("package_name", "repo_id", F.concat(F.lit("file:"), "repo_id", F.lit(":package.json")).alias("file_id"), F.lit("package.json").alias("path"), F.lit(1).alias("line"), "order", F.lit(False).alias("named"))
    first = F.min(F.struct("order", (~F.col("named")).alias("n"), "repo_id", "file_id", "path", "line")).alias("m")
    best = exact.unionByName(by_alias).groupBy("package_name").agg(first)
    rule = F.when(F.col("m.n"), "package-owner-alias").otherwise("package-json-name")
    null = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    return best.select(
        "m.repo_id", "m.file_id", "m.path", F.lit("package").alias("kind"), F.col("package_name").alias("key"), F.col("package_name").alias("name"), F.lit("owner").alias("role"), "m.line", F.col("package_name").alias("raw"), rule.alias("rule"),
        F.when(F.col("m.n"), 0.7).otherwise(1.0).alias("confidence"), null("spec_kind"), null("spec"), null("framework"), null("symbol"), F.array().cast("array<string>").alias("refs"),
    )


def contract_id(kind: Column, key: Column) -> Column:
    """Keys that differ in odd characters only share an id, as they always have; (kind, key) is the safe identity."""
    return F.concat(F.lit("contract:"), kind, F.lit(":"), normal_name(key))


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """contracts, evidence, edges, specs and pending references of facts, each without duplicates: the last of equal keys stays.

    Keys: a contract's id; evidence by repository, file, line, rule and text; a role by (repository, contract, role, evidence); a spec by (contract, evidence).
    """
    evidence_id = F.concat(F.lit("evidence:"), F.substring(F.sha2(F.concat_ws("\u0001", "repo_id", "path", F.col("line").cast("string"), "rule", F.substring("raw", 1, 80)), 256), 1, 24))
    rows = found.withColumn("evidence_id", evidence_id).withColumn("contract_id", F.when(F.col("kind") != "", contract_id(F.col("kind"), F.col("key")))).withColumn("__seq", F.struct("file_id", "line", "rule", "key"))
    real = rows.where("contract_id is not null")
    pick = lambda df, by, columns: last_of_each(df, by, "__seq").select(*columns)
    json_field = lambda name: F.get_json_object("spec", f"$.{name}")
    spec = real.where("spec is not null").withColumn("spec_id", F.concat(F.lit("spec:"), F.substring(F.sha2(F.concat_ws("|", "contract_id", "evidence_id"), 256), 1, 24)))
    spec = spec.withColumn("method", json_field("method")).withColumn("path_template", json_field("pathTemplate")).withColumn("topic", json_field("topic"))
    specs = last_of_each(spec, ["spec_id"], "__seq").select("spec_id", "contract_id", "spec_kind", "repo_id", "file_id", "evidence_id", "key", F.when(F.col("spec_kind") == "http-endpoint", F.col("method")).alias("method"), F.col("path_template").alias("path"), "topic", "spec", "confidence")
    refs = spec.select("spec_id", "evidence_id", "confidence", F.explode("refs").alias("ref"))
    pending = refs.select(F.col("spec_id").alias("from_spec"), F.concat(F.lit("schema-ref:"), F.substring_index("ref", ":", -1)).alias("to_spec"), F.substring_index("ref", ":", 1).alias("kind"), "evidence_id", F.least("confidence", F.lit(1.0)).alias("confidence")).distinct()
    return {
        "contracts": pick(real, ["contract_id"], ["contract_id", "kind", "key", "name"]),
        "evidence": pick(rows, ["evidence_id"], ["evidence_id", "repo_id", "file_id", "path", "line", "raw", "rule", "confidence"]),
        "edges": pick(real, ["repo_id", "contract_id", "role", "evidence_id"], ["repo_id", "contract_id", "role", "evidence_id", "line", "rule", "confidence"]).withColumn("active", F.lit(None).cast("boolean")),
        "specs": specs, "pending": pending,
    }


def normalized(public: DataFrame) -> DataFrame:
    """Facts of a plugin (repo_id, path, kind, key, role, line, raw, rule, confidence, spec as JSON with its kind) as C.FACT rows; what lacks a kind, key or
    role is left out, a confidence is held within 0 and 1."""
    null = lambda kind="string": F.lit(None).cast(kind)
    rows = public.where("kind is not null and key is not null and key <> '' and role in ('owner', 'producer', 'consumer', 'shared')")
    return rows.select(
        "repo_id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("file_id"), "path", "kind", "key", F.col("key").alias("name"), "role", F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).cast("int").alias("line"), F.coalesce("raw", F.lit("")).alias("raw"),
        F.coalesce("rule", F.lit("plugin")).alias("rule"), F.greatest(F.least(F.coalesce("confidence", F.lit(0.5)), F.lit(1.0)), F.lit(0.0)).alias("confidence"), F.get_json_object("spec", "$.kind").alias("spec_kind"), "spec", null().alias("framework"), null().alias("symbol"), F.array().cast("array<string>").alias("refs"),
    )


# How frameworks show: file name, pattern in it, framework, language, confidence.
MARKERS = (
    ("package.json", r"\{", "js:package-json", "javascript", 1.0), ("package.json", r'"axios"\s*:', "js:axios", "javascript", 1.0), ("package.json", r'"express"\s*:', "js:express", "javascript", 1.0),
    ("package.json", r'"@nestjs/[\w-]+"\s*:', "js:nestjs", "javascript", 1.0), ("package.json", r'"react"\s*:', "js:react", "javascript", 1.0), ("package.json", r'"vue"\s*:', "js:vue", "javascript", 1.0),
    ("pom.xml", r"", "java:pom", "java", 1.0), ("pom.xml", r"spring-boot-starter-web|spring-webmvc", "java:spring-mvc", "java", 1.0), ("pom.xml", r"spring-kafka", "java:spring-kafka", "java", 1.0),
    ("pom.xml", r"spring-boot-starter-amqp|spring-rabbit", "java:spring-amqp", "java", 1.0), ("pom.xml", r"dubbo", "java:dubbo", "java", 1.0),
    ("build.gradle", r"", "java:gradle", "java", 1.0), ("build.gradle", r"spring-boot-starter-web|spring-webmvc", "java:spring-mvc", "java", 1.0), ("build.gradle.kts", r"", "java:gradle", "java", 1.0),
    ("build.gradle.kts", r"spring-boot-starter-web|spring-webmvc", "java:spring-mvc", "java", 1.0),
    ("go.mod", r"", "go:mod", "go", 1.0), ("go.mod", r"gin-gonic/gin", "go:gin", "go", 1.0), ("go.mod", r"google\.golang\.org/grpc", "go:grpc", "go", 1.0),
    ("requirements.txt", r"", "python:requirements", "python", 1.0), ("requirements.txt", r"(?im)^fastapi\b", "python:fastapi", "python", 1.0), ("requirements.txt", r"(?im)^flask\b", "python:flask", "python", 1.0),
    ("requirements.txt", r"(?im)^(?:kafka-python|confluent-kafka|aiokafka)\b", "python:kafka", "python", 1.0), ("requirements.txt", r"(?im)^pika\b", "python:pika", "python", 1.0), ("requirements.txt", r"(?im)^celery\b", "python:celery", "python", 1.0),
    ("pyproject.toml", r"", "python:pyproject", "python", 1.0), ("pyproject.toml", r"(?i)\bfastapi\b", "python:fastapi", "python", 1.0), ("pyproject.toml", r"(?i)\bflask\b", "python:flask", "python", 1.0), ("pyproject.toml", r"(?i)\bcelery\b", "python:celery", "python", 1.0),
)
# What a language's files, or a sign in them, stand for where no manifest tells.
FALLBACKS = (
    ("javascript|typescript|tsx|jsx|vue", r"", "js:generic-fetch", "javascript", 0.55), ("python", r"", "python:generic", "python", 0.55), ("go", r"", "go:generic", "go", 0.55), ("java", r"", "java:generic", "java", 0.55),
    ("java", r"@(?:RestController|Controller|RequestMapping|GetMapping|PostMapping)\b", "java:spring-mvc", "java", 0.7), ("xml", r"<dubbo:(?:service|reference)\b", "java:dubbo-xml", "java", 1.0),
)


def frameworks(files: DataFrame) -> DataFrame:
    """repo_id, name, language, confidence, path: the frameworks that manifests and, failing these, sources show; of one name the most confident."""
    rows, base = None, files.select("repo_id", "path", "language", F.coalesce("source", F.lit("")).alias("source"))
    name = F.element_at(F.split("path", "/"), -1)
    hits = [F.when((name == f) & F.col("source").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(of).alias("of"), F.lit(c).alias("confidence"))) for f, p, n, of, c in MARKERS]
    hits += [F.when(F.col("language").rlike(f"^(?:{lang})$") & F.col("source").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(of).alias("of"), F.lit(c).alias("confidence"))) for lang, p, n, of, c in FALLBACKS]
    rows = base.select("repo_id", "path", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    best = F.max(F.struct("f.confidence", F.col("f.of").alias("language"), "path")).alias("m")
    return rows.groupBy("repo_id", F.col("f.name").alias("name")).agg(best).select("repo_id", "name", "m.language", "m.confidence", "m.path")


#: Readers that need one of these frameworks in the repository; the others run wherever their language does.
NEEDS = {"package_json": ("js:package-json",), "dubbo_xml": ("java:dubbo-xml", "java:dubbo"), "spring": ("java:spring-mvc",), "java_event": ("java:spring-kafka", "java:spring-amqp", "java:generic"), "py_http": ("python:generic", "python:fastapi", "python:flask")}


def enabled(found: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, reader: which readers run in which repository, by its frameworks (repo_id, name) and the configured lists."""
    names = sorted({r.__name__ for readers in C.READERS.values() for r in readers})
    names = [n for n in names if (not include or n in include) and n not in exclude]
    repos = found.select("repo_id").distinct()
    free = repos.select("repo_id", F.explode(F.array(*[F.lit(n) for n in names if n not in NEEDS] or [F.lit("")])).alias("reader"))
    spark = found.sparkSession
    pairs = spark.createDataFrame([(n, f) for n in names for f in NEEDS.get(n, ())] or [("", "")], "reader string, name string")
    return free.union(found.select("repo_id", "name").join(F.broadcast(pairs), "name").select("repo_id", "reader")).distinct()
