"""References inside source code: imports to files, calls to symbols, sections to symbols. Joins on names; nothing is compared pair by pair but sections' texts.

Tables: files (repo_id, file_id, path, language), imports (file_id, module, raw, line, bindings array<struct<local, imported, kind>>), symbols (code_id,
repo_id, file_id, name, qualified_name, kind, start_line, end_line), calls (file_id, callee, receiver, line, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.functions.keys import band
from specgraph.operators.documents import resolved
from specgraph.operators.matching import meet
from specgraph.operators.paths import cut

#: What an import may leave out of a file's path, in the order in which it is tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue")
#: A call's text is cut at so many characters, with a piece of its hash.
RAW = 512


def _blocks(start: Column, end: Column) -> Column:
    """level, block: the fewest blocks of 2^level lines, each beginning at a multiple of its length, that make up the lines from start to end."""

    def of(level: Column) -> Column:
        right = lambda x: F.call_function("shiftright", x, level)
        first, behind = -right(-start), right(end + 1)
        one = lambda odd, x: F.when((first < behind) & (odd.bitwiseAND(1) == 1), F.struct(level.alias("level"), x.alias("block")))
        return F.array_compact(F.array(one(first, first), one(behind, behind - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(end - start + 1)) - 1), of))


def caller(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with caller: the symbol of the file whose lines enclose the call's, the one of fewest lines, then the first.

    Symbols are cut into blocks of lines, at most two of each length, and a block keeps its best symbol; a line looks up the blocks that hold it, one of
    each length in its file. So no call meets a file's symbols.
    """
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    spans = symbols.where("start_line <= end_line").groupBy("file_id", start.alias("s"), end.alias("e")).agg(F.min("code_id").alias("code_id"))
    blocks = spans.select("file_id", F.inline(_blocks(F.col("s"), F.col("e"))), F.struct((F.col("e") - F.col("s")).alias("lines"), "code_id").alias("m"))
    blocks = blocks.groupBy("file_id", "level", "block").agg(F.min("m").alias("m"))
    levels = blocks.select("file_id", "level").distinct()
    lines = calls.select("file_id", F.col("line").cast("long").alias("line")).distinct().join(levels, "file_id")
    lines = lines.withColumn("block", F.call_function("shiftright", F.col("line"), F.col("level")))
    best = lines.join(blocks, ["file_id", "level", "block"]).groupBy("file_id", "line").agg(F.min("m").alias("m")).select("file_id", F.col("line").alias("__line"), F.col("m.code_id").alias("caller"))
    return calls.withColumn("__line", F.col("line").cast("long")).join(best, ["file_id", "__line"], "left").select(*calls.columns, "caller")


def import_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """from_file, to_file, module, raw of each relative import whose file is there: the path itself, or the first that one of SUFFIXES completes.

    Each file is listed under all that may be written for it, so an import looks up one key. A module of one leading ./ or ../ and plain parts is put
    behind its folder, which is worked out once a file; others are resolved part by part.
    """
    here = files.select("repo_id", "file_id", "path", *[F.when(at != "", F.concat(at, F.lit("/"))).otherwise(at).alias(n) for n, at in (("in", resolved(F.col("path"), F.lit("."))), ("up", resolved(F.col("path"), F.lit(".."))))])
    wanted = imports.where(F.col("module").startswith(".")).join(here, "file_id")
    module = F.col("module")
    rest = F.when(module.startswith("./"), F.substring(module, 3, 1 << 30)).when(module.startswith("../"), F.substring(module, 4, 1 << 30))
    odd = rest.contains("//") | rest.contains("/.") | rest.startswith(".") | rest.startswith("/") | rest.endswith("/") | (rest == "") | rest.contains("#") | rest.contains("?")
    goal = F.when(~odd, F.concat(F.when(module.startswith("./"), F.col("in")).otherwise(F.col("up")), rest)).otherwise(resolved(F.col("path"), module))
    written = F.array_compact(F.array(*[F.when(F.col("path").endswith(s), F.struct(F.lit(n).alias("nth"), F.expr(f"left(path, length(path) - {len(s)})").alias("goal"))) for n, s in enumerate(SUFFIXES)]))
    listed = files.select("repo_id", "file_id", F.inline(written)).groupBy("repo_id", "goal").agg(F.min(F.struct("nth", "file_id")).alias("m")).select("repo_id", "goal", F.col("m.file_id").alias("to_file"))
    return wanted.select("repo_id", F.col("file_id").alias("from_file"), "module", "raw", goal.alias("goal")).join(listed, ["repo_id", "goal"]).select("from_file", "to_file", "module", "raw")


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """import_targets, each (from_file, module, raw) once."""
    return import_targets(files, imports).groupBy("from_file", "module", "raw").agg(F.min("to_file").alias("to_file")).select("from_file", "to_file", "module", "raw")


def short(c) -> Column:
    """A call's text, white space as single spaces, cut at RAW characters."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) <= RAW, c).otherwise(F.concat(F.substring(c, 1, RAW), F.lit("...#"), F.substring(F.sha2(c, 256), 1, 12)))


def _named(symbols: DataFrame) -> DataFrame:
    """name, code_id, file_id: symbols by their name and by the last part of their qualified name."""
    last = F.element_at(F.split("qualified_name", r"\."), -1)
    return symbols.select(F.explode(F.array_distinct(F.array("name", last))).alias("name"), "code_id", "file_id").distinct()


def re_exports(imports: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, local, code_id: what a file passes on by `export … from`, one level deep; local '*' for all of a file's symbols."""
    out = imports.where(F.trim("raw").startswith("export ")).select(F.col("file_id").alias("from_file"), "module", F.explode("bindings").alias("b"))
    out = out.join(edges.select("from_file", "to_file").distinct(), "from_file").select("from_file", "to_file", "b.local", "b.imported")
    whole = out.where("local = '*'").join(symbols.select(F.col("file_id").alias("to_file"), "code_id"), "to_file").select(F.col("from_file").alias("file_id"), "local", "code_id")
    names = out.where("local <> '*'").select("from_file", "to_file", "local", F.explode(F.array_distinct(F.array_compact(F.array("imported", "local")))).alias("name"))
    some = names.join(_named(symbols).withColumnRenamed("file_id", "to_file"), ["name", "to_file"]).select(F.col("from_file").alias("file_id"), "local", "code_id")
    return whole.union(some).distinct()


def aliases(imports: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, local, code_id: what a local name of a file may mean by its imports, directly or through a file that passes it on."""
    bound = imports.where(~F.trim("raw").startswith("export ")).select("file_id", F.explode("bindings").alias("b")).where("b.kind <> 'namespace'")
    names = bound.select("file_id", "b.local", F.explode(F.array_distinct(F.array_compact(F.array("b.local", F.when(F.col("b.imported") != "default", F.col("b.imported")))))).alias("name"))
    names = names.where("name <> 'default'").join(edges.select(F.col("from_file").alias("file_id"), "to_file").distinct(), "file_id")
    direct = names.join(_named(symbols).withColumnRenamed("file_id", "to_file"), ["name", "to_file"]).select("file_id", "local", "code_id")
    passed = re_exports(imports, edges, symbols).withColumnRenamed("file_id", "to_file").withColumnRenamed("local", "exported")
    through = names.join(passed, "to_file").where("exported = name or exported = '*'").select("file_id", "local", "code_id")
    return direct.union(through).distinct()


def exact_targets(files: DataFrame, imports: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """file_id, line, raw, code_id of calls that a language's own rules resolve: Python functions by module or by name imported from one, Go functions by
    package, Java methods by the type of their receiver's class name."""
    py = files.where("language = 'python'").select("repo_id", "file_id", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "").alias("bare"))
    dotted = F.array_join(F.filter(F.split("bare", "/"), lambda s: s != ""), ".")
    modules = py.select("repo_id", F.explode(F.array_distinct(F.array(dotted, F.element_at(F.split(dotted, r"\."), -1)))).alias("module"), F.col("file_id").alias("to_file"))
    modules = modules.groupBy("repo_id", "module").agg(F.max("to_file").alias("to_file"))
    bound = imports.join(py.select("repo_id", "file_id"), "file_id").select("repo_id", "file_id", F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.col("module").alias("module")), F.struct(F.lit(1).alias("nth"), F.element_at(F.split("module", r"\."), -1).alias("module")))).alias("m"), F.col("module").alias("of"), "bindings")
    bound = bound.select("repo_id", "file_id", "m.nth", "m.module", "of", "bindings").join(modules, ["repo_id", "module"]).groupBy("file_id", "of", "bindings").agg(F.min_by("to_file", "nth").alias("to_file"))
    bound = bound.select("file_id", "to_file", F.explode("bindings").alias("b")).select("file_id", "to_file", "b.*")
    top = symbols.where("kind in ('function', 'class') and name = qualified_name").select(F.col("file_id").alias("to_file"), F.col("name").alias("fn"), "code_id")
    plain = calls.select("file_id", "callee", "receiver", "line", short("raw").alias("raw"))
    by_name = plain.where("receiver is null").join(bound.where("kind = 'named' and imported <> '*'"), (plain.file_id == bound.file_id) & (plain.callee == bound.local)).select(plain.file_id, "line", "raw", "to_file", F.col("imported").alias("fn"))
    by_module = plain.join(bound.where("kind = 'namespace'"), (plain.file_id == bound.file_id) & (plain.receiver == bound.local)).select(plain.file_id, "line", "raw", "to_file", F.col("callee").alias("fn"))
    python = by_name.union(by_module).join(top, ["to_file", "fn"]).select("file_id", "line", "raw", "code_id")

    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    go = files.where("language = 'go'").select("repo_id", "file_id", folder.alias("package"))
    functions = symbols.where("kind = 'function'").join(go.select("file_id", "package"), "file_id").groupBy("repo_id", "package", F.col("name").alias("callee")).agg(F.min("code_id").alias("code_id"))
    named = imports.join(go.select("file_id"), "file_id", "left_semi").select("file_id", F.element_at(F.split("module", "/"), -1).alias("package"), F.explode_outer("bindings").alias("b")).select("file_id", "package", F.coalesce("b.local", "package").alias("receiver"))
    of_go = plain.join(go, "file_id")
    inner = of_go.where("receiver is null").select("repo_id", "package", "callee", "file_id", "line", "raw")
    outer = of_go.drop("package").join(named, ["file_id", "receiver"]).select("repo_id", "package", "callee", "file_id", "line", "raw")
    golang = inner.union(outer).join(functions, ["repo_id", "package", "callee"]).select("file_id", "line", "raw", "code_id")

    java = files.where("language = 'java'").select("repo_id", "file_id")
    owner = F.try_element_at(F.split("qualified_name", r"\."), F.lit(-2))
    methods = symbols.join(java.select("file_id"), "file_id", "left_semi").where("kind = 'method'").groupBy("repo_id", owner.alias("receiver"), F.col("name").alias("callee")).agg(F.min("code_id").alias("code_id"), F.count("*").alias("n")).where("n = 1")
    jvm = plain.join(java, "file_id").join(methods, ["repo_id", "receiver", "callee"]).select("file_id", "line", "raw", "code_id")
    return python.union(golang).union(jvm).groupBy("file_id", "line", "raw").agg(F.min("code_id").alias("code_id"))


def _candidates(rest: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """call, code_id: of the symbols that a call (call, callee, file_id, repo) may mean by name all that may be its best.

    Symbols of one kind of place (the call's file, an imported one, its repository, anywhere) differ in their score only by how they have the name, so the
    first of each place and kind is enough, and the second in case the first is the caller itself.
    """
    callee = F.explode(F.array_distinct(F.array("name", F.element_at(F.split("qualified_name", r"\."), -1)))).alias("callee")
    named = symbols.select(callee, "code_id", F.col("repo_id").alias("repo"), F.col("file_id").alias("to_file"), "name", "qualified_name")
    named = named.withColumn("exact", F.coalesce((F.col("name") == F.col("callee")) | F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("callee"))), F.lit(False)))

    def first(*place: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("callee", "exact", *place).orderBy("code_id"))
        return named.select("callee", "exact", *place, "code_id").distinct().withColumn("nth", nth).where("nth <= 2").drop("nth", "exact")

    at_file = first("to_file", "repo").drop("repo")
    calls = rest.select("call", "callee", "file_id", "repo")
    anywhere = calls.join(first(), "callee")
    same_repo = calls.join(first("repo"), ["callee", "repo"])
    same_file = calls.join(at_file.withColumnRenamed("to_file", "file_id"), ["callee", "file_id"])
    linked = calls.select("callee", "file_id").distinct().join(edges.select(F.col("from_file").alias("file_id"), "to_file").distinct(), "file_id").join(at_file, ["callee", "to_file"]).select("callee", "file_id", "code_id")
    out = anywhere.select("call", "code_id").unionByName(same_repo.select("call", "code_id")).unionByName(same_file.select("call", "code_id"))
    return out.unionByName(calls.join(linked, ["callee", "file_id"]).select("call", "code_id"))


def resolve_calls(files: DataFrame, imports: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """from_code, to_code, confidence, resolution, raw of calls inside symbols.

    What exact_targets knows is exact (0.95). Else candidates by name, or by an imported alias, score 0.4 for the exact name, 0.4 in the same file, 0.3 if
    imported, 0.1 in the same repository, 1 at most; the best stays (then an imported one, then one of the same file, then the first) if it has 0.4.
    """
    edges = resolve_imports(files, imports)
    # Written once: numbers of rows that are worked out again may be others.
    inside = cut(caller(calls, symbols).where("caller is not null").withColumn("raw", short("raw")).withColumn("call", F.monotonically_increasing_id()))
    exact = inside.join(exact_targets(files, imports, symbols, calls), ["file_id", "line", "raw"]).where("code_id <> caller").select("call", F.col("caller").alias("from_code"), F.col("code_id").alias("to_code"), F.lit(0.95).alias("confidence"), F.lit("exact").alias("resolution"), "raw")
    rest = cut(inside.join(exact.select("call").distinct(), "call", "left_anti").join(files.select("file_id", F.col("repo_id").alias("repo")), "file_id"))
    via = aliases(imports, edges, symbols).withColumnRenamed("local", "callee").withColumn("alias", F.lit(True))
    by_alias = rest.select("call", "file_id", "callee").join(via, ["file_id", "callee"]).select("call", "code_id", "alias")
    by_name = _candidates(rest, edges, symbols).withColumn("alias", F.lit(False))
    found = by_alias.union(by_name).groupBy("call", "code_id").agg(F.max("alias").alias("alias"))
    target = symbols.select("code_id", F.col("repo_id").alias("to_repo"), F.col("file_id").alias("to_file"), "name", "qualified_name")
    found = found.join(rest.select("call", "caller", "callee", "file_id", "repo", "raw"), "call").where("code_id <> caller").join(target, "code_id")
    found = found.join(edges.select(F.col("from_file").alias("file_id"), "to_file", F.lit(True).alias("linked")).distinct(), ["file_id", "to_file"], "left")
    exact_name = (F.col("name") == F.col("callee")) | F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("callee"))) | F.col("alias")
    imported, same = F.coalesce("linked", F.lit(False)) | F.col("alias"), F.col("to_file") == F.col("file_id")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = F.least(points(exact_name, 4) + points(same, 4) + points(imported, 3) + points(F.col("to_repo") == F.col("repo"), 1), F.lit(10)) / 10
    best = F.min(F.struct((-score).alias("s"), (~imported).alias("i"), (~same).alias("f"), F.col("code_id").alias("to"), "caller", "raw")).alias("b")
    picked = found.groupBy("call").agg(best).select(F.col("b.caller").alias("from_code"), F.col("b.to").alias("to_code"), (-F.col("b.s")).alias("confidence"), "b.raw").where("confidence >= 0.4")
    every = exact.drop("call").unionByName(picked.withColumn("resolution", band(F.col("confidence"))))
    return every.groupBy("from_code", "to_code", "raw").agg(F.max_by(F.struct("confidence", "resolution"), "confidence").alias("m")).select("from_code", "to_code", "m.confidence", "m.resolution", "raw")


def documenting(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """section_id, code_id, confidence: sections whose text holds a symbol's name or qualified name, of three characters or more, whatever the case, in the
    same repository, even inside a longer word.

    Texts meet sets of names, not symbols: a name's first three characters are an equi-join key, the text decides, and a set's symbols follow at the end,
    in pairs that come once each. Ids belong to one repository.
    """
    name = F.explode(F.array("name", "qualified_name")).alias("name")
    owned = symbols.select("repo_id", "code_id", name).where("length(name) > 2").groupBy("repo_id", "code_id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    names = owned.select("repo_id", "names").distinct().select("repo_id", "names", F.explode("names").alias("name")).withColumn("gram", F.substring("name", 1, 3))
    low = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # texts of few files make many rows
    texts = sections.where("length(text) > 2").repartition(n, "section_id").select("repo_id", "section_id", low.alias("low"), F.explode(grams).alias("gram"))
    hit = texts.join(names, ["repo_id", "gram"]).where(F.contains("low", F.col("name"))).select(F.col("repo_id").alias("of"), "section_id", F.col("names").alias("told")).distinct()
    return meet(owned, hit, ["repo_id", "names"], ["of", "told"], F.lit(True), "section_id").select("section_id", "code_id", F.lit(0.7).alias("confidence"))


# Endings that a business entity's name is freed of, and what a role does by kind of contract.
ENTITY_SUFFIX = "(?:DTO|Dto|Schema|Event|Created|Updated|Deleted)$"
VERBS = {"api": ("producer", "serve-api", "call-api"), "event": ("producer", "publish-event", "consume-event"), "package": ("owner", "own-package", "use-package")}


def business_entity(kind: Column, name: Column, key: Column) -> Column:
    """What a contract is about: the last part of its name (or key) without template parts and technical endings, capitalised; null below three
    characters, and for packages and configuration."""
    source = F.coalesce(F.when(name != "", name), key)
    last = F.coalesce(F.try_element_at(F.filter(F.split(source, "[/.:-]+"), lambda s: s != ""), F.lit(-1)), source)
    bare = F.regexp_replace(F.regexp_replace(last, r"\{[^}]+\}", ""), ENTITY_SUFFIX, "")
    return F.when(~kind.isin("package", "config") & (F.length(bare) >= 3), F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20)))


def operation_verb(kind: Column, role: Column) -> Column:
    out = None
    for of, (first, one, other) in VERBS.items():
        hit = F.when(role == first, one).otherwise(other)
        out = F.when(kind == of, hit) if out is None else out.when(kind == of, hit)
    return out.otherwise("share-contract")


def workflows(deps: DataFrame, contracts: DataFrame, operations: DataFrame) -> DataFrame:
    """workflow_id, name, operation_id, step, evidence_id, confidence: dependencies over an api or event become a flow of the operations on its entity.

    deps: source_contract, evidence_id, confidence; operations: operation_id, entity_name, verb, description. What serves or publishes is step 1.
    """
    c = contracts.where("kind in ('api', 'event')").select(F.col("contract_id").alias("source_contract"), "kind", "key", business_entity(F.col("kind"), F.col("name"), F.col("key")).alias("entity_name")).where("entity_name is not null")
    j = deps.join(c, "source_contract").join(operations, "entity_name").where(F.contains("description", F.col("key")))
    name = F.concat_ws(":", "entity_name", "kind", "key")
    flow = F.concat(F.lit("workflow:"), F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_.-]+", "-"), r"^-+|-+$", "")))
    step = F.when(F.col("verb").contains("serve") | F.col("verb").contains("publish"), 1).otherwise(2)
    return j.select(flow.alias("workflow_id"), F.concat_ws(" ", "entity_name", "kind", F.lit("flow")).alias("name"), "operation_id", step.alias("step"), "evidence_id", "confidence").distinct()
