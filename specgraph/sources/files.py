"""Source trees as tables: repositories, files, manifests. Listing is Spark's; only the few repository roots are looked up on the driver."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.extraction.parse import EXTENSIONS

# Paths of files that a generator wrote.
GENERATED = (
    r"\.pb\.go$", r"\.pulsar\.go$", r"_grpc\.pb\.go$", r"_mock\.go$", r"_mocks\.go$", r"(?:^|/)mock_[^/]+\.go$", r"_pb2(?:_grpc)?\.py$", r"_pb2\.pyi$", r"OuterClass\.java$", r"Grpc\.java$",
    r"\.generated\.[jt]sx?$", r"\.gen\.[jt]sx?$", r"\.pb\.[jt]s$", r"_pb\.[jt]s$", r"_grpc_pb\.[jt]s$", r"\.min\.m?js$", r"\.g\.cs$", r"Grpc\.cs$", r"\.pb\.(?:cc|h)$", r"\.pb\.swift$",
    r"\.g\.dart$", r"\.freezed\.dart$", r"\.pb\.dart$", r"\.pbgrpc\.dart$", r"\.chopper\.dart$", r"\.generated\.rs$",
)
# What a scan takes and leaves out unless told otherwise.
INCLUDE = tuple(f"**/*{e}" for e in (".ts", ".tsx", ".js", ".jsx", ".java", ".py", ".go", ".md", ".mdx", ".yml", ".yaml", ".toml", ".properties", ".vue"))
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/target/**", "**/.git/**")
HEAD = 1024


def generated(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike("|".join(GENERATED))


def glob(pattern: str) -> str:
    """A glob as an anchored regular expression: ** spans folders, * and ? don't, {a,b} chooses."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = f"{out}(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = f"{out}.*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def ignore(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression over paths, and whether it takes back; comments and empty lines are None."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.lstrip("!")
    anchored = "/" in line.rstrip("/")
    body = glob(line.strip("/"))[1:-1]
    return (f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if line.endswith('/') else '(?:/.*)?'}$", back)


def wanted(path: Column, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, ignored: tuple[str, ...] = ()) -> Column:
    """Whether a scan takes a path: included, not excluded, not ignored (the last line of an ignore file that fits decides), not generated."""
    any_of = lambda globs: path.rlike("|".join(glob(g) for g in globs)) if globs else F.lit(False)
    out = F.lit(False)
    for rule in map(ignore, ignored):
        if rule:
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return any_of(include) & ~any_of(exclude) & ~out & ~generated(path)


def language(path: Column) -> Column:
    """A path's language by its longest known extension; null if there is none."""
    name, out = F.lower(F.element_at(F.split(path, "/"), -1)), None
    for ext in sorted(EXTENSIONS, key=lambda e: (-len(e), e)):
        hit = name.endswith(ext)
        out = F.when(hit, EXTENSIONS[ext]) if out is None else out.when(hit, EXTENSIONS[ext])
    return out


def discover(root: str, depth: int = 1) -> list[str]:
    """Real paths of folders at most `depth` below root that hold a .git; each once. A few roots, listed on the driver."""
    found, level = [], [root]
    for n in range(depth + 1):
        below = []
        for folder in level:
            if os.path.exists(os.path.join(folder, ".git")):
                found.append(os.path.realpath(folder))
            elif n < depth and os.path.isdir(folder):
                below += [os.path.join(folder, x) for x in sorted(os.listdir(folder)) if not x.startswith(".") and os.path.isdir(os.path.join(folder, x))]
        level = below
    return list(dict.fromkeys(found))


def git(path: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


def repositories(spark: SparkSession, roots: list[str]) -> DataFrame:
    """repo_id, name, path, remote, branch, commit; what git doesn't tell is empty."""
    rows = [(f"repo:{os.path.basename(p)}", os.path.basename(p), p, git(p, "config", "--get", "remote.origin.url"), git(p, "rev-parse", "--abbrev-ref", "HEAD"), git(p, "rev-parse", "HEAD")) for p in roots]
    return spark.createDataFrame(rows, "repo_id string, name string, path string, remote string, branch string, commit string")


def scan(spark: SparkSession, root: str, repo_id: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, ignored: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, file_id, path, language, hash, bytes, source of the text files below root that a scan takes, with a language; every one, whatever their number.

    Binary files (a NUL among the first HEAD bytes) are left out; paths are filtered before contents are decoded.
    """
    base = re.sub("^file:/*", "/", root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(F.substring_index("path", base, -1).alias("path"), "content", F.col("length").alias("bytes"))
    rows = rows.where(wanted(F.col("path"), include, exclude, ignored)).withColumn("language", language(F.col("path"))).where("language is not null")
    rows = rows.where(~F.hex(F.substring("content", 1, HEAD)).rlike("^(?:..)*00"))
    return rows.select(F.lit(repo_id).alias("repo_id"), F.concat(F.lit(f"file:{repo_id}:"), "path").alias("file_id"), "path", "language", F.sha2("content", 256).alias("hash"), "bytes", F.col("content").cast("string").alias("source"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (file_id, hash, …) that are new or of another hash than known (file_id, hash)."""
    return files.join(known.select("file_id", "hash"), ["file_id", "hash"], "left_anti")


def manifests(files: DataFrame) -> DataFrame:
    """repo_id, file_id, path, name, dependencies (a map) of a repository's root package.json and of those that its workspaces name.

    A workspace pattern may hold * and **; the root's `workspaces` may be a list or an object with `packages`.
    """
    raw = files.where((F.element_at(F.split("path", "/"), -1) == "package.json") & ~F.col("path").rlike("(?:^|/)node_modules/"))
    spaces = F.coalesce(F.from_json(F.get_json_object("source", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("source", "$.workspaces.packages"), "array<string>"), F.array().cast("array<string>"))
    part = lambda name: F.coalesce(F.from_json(F.get_json_object("source", f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = raw.select("repo_id", "file_id", "path", F.get_json_object("source", "$.name").alias("name"), F.map_from_entries(F.array_distinct(F.concat(*[F.map_entries(part(x)) for x in ("dependencies", "devDependencies", "peerDependencies")]))).alias("dependencies"), spaces.alias("spaces"))
    stem = F.regexp_replace(F.regexp_replace(F.col("s"), "/+$", ""), "/package\\.json$", "")
    star = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"([.+^$()|\[\]])", r"\\$1"), r"\*\*", "\u0001"), r"\*", "[^/]*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(star, "\u0001", ".*"), F.lit("/package\\.json$"))
    named = rows.where("path = 'package.json'").select("repo_id", F.explode("spaces").alias("s")).select("repo_id", pattern.alias("pattern"))
    inner = rows.where("path <> 'package.json'").join(named, "repo_id").where("path rlike pattern").drop("pattern").dropDuplicates(["file_id"])
    return rows.where("path = 'package.json'").unionByName(inner).drop("spaces")
