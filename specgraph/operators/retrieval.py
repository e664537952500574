"""From a question to what answers it: its kind and terms, the rows about them, semantic records, ranking, and a context that fits a budget."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.functions.keys import normal_name
from specgraph.operators import graph as G
from specgraph.operators.reading import cosine, dependency_list, keyword_score, trace_contract

# What a question is about by the first pattern that fits, and what counts as a term of it.
KINDS = (
    ("impact", r"impact|influence|who[\s_]*uses|\bref\b"), ("workflow", r"flow|workflow|chain|create"), ("dependency", r"dependency|depend|import"),
    ("debugging", r"error|bug|debug|exception"), ("symbol", r"function|class|symbol|method"),
)
TERM = r"[A-Za-z_][A-Za-z0-9_]+|[一-龥]{2,}"
# Names of domain entities and words that are none.
ENTITY = r"\b(?:[A-Z][A-Za-z0-9]*)?(?:Event|Command|Query|Service|Controller|Order|Payment|User)\b"
NO_ENTITY = ("Promise", "String", "Number", "Boolean", "Array", "Map", "Set", "Error")


def question_kind(c: Column) -> Column:
    q, out = F.lower(c), None
    for kind, pattern in KINDS:
        out = F.when(q.rlike(pattern), kind) if out is None else out.when(q.rlike(pattern), kind)
    return out.otherwise("general")


def terms(c: Column) -> Column:
    """The words of a question; the question itself if it has none."""
    got = F.regexp_extract_all(c, F.lit(TERM), F.lit(0))
    return F.when(F.size(got) > 0, got).otherwise(F.array(c))


def plan(question: str) -> tuple[str, list[str]]:
    low = question.lower()
    kind = next((k for k, p in KINDS if re.search(p, low, re.ASCII)), "general")
    return kind, re.findall(TERM, question) or [question]


def contract_targets(question: str) -> list[str]:
    """Paths that a question names, with or without api: in front; trailing punctuation cut off, each once."""
    found = [m[1] for m in re.finditer(r"(?i)\bapi:(/[^\s'\"`，。；,)）]+)", question)] + re.findall(r"/[A-Za-z0-9_{}:$.-]+(?:/[A-Za-z0-9_{}:$.-]+)*", question)
    return list(dict.fromkeys(t for t in (re.sub(r"[),.;，。；）]+$", "", x) for x in found) if t.startswith("/")))


def targets(c: Column) -> Column:
    """contract_targets of a column of questions."""
    bare = lambda x: F.regexp_replace(x, "[),.;，。；）]+$", "")
    named = F.regexp_extract_all(c, F.lit("(?i)\\bapi:(/[^\\s'\"`，。；,)）]+)"), F.lit(1))
    paths = F.regexp_extract_all(c, F.lit(r"/[A-Za-z0-9_{}:$.-]+(?:/[A-Za-z0-9_{}:$.-]+)*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(F.concat(named, paths), bare), lambda x: x.startswith("/")))


def entities(text: Column) -> Column:
    """Names of domain entities in a text, each once."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), lambda x: (F.length(x) > 2) & ~x.isin(*NO_ENTITY))


# How many terms of a question are looked up, and how many rows of each kind are kept.
TERMS, CODE, SECTIONS, ENTITIES, DEPENDENCIES, SEMANTIC, FALLBACK = 5, 20, 20, 30, 50, 10, 30


def retrieve(question: str, t: dict[str, DataFrame], semantic: DataFrame | None = None) -> dict[str, DataFrame | str]:
    """kind, and DataFrames contracts, code, sections, entities, dependencies, semantic, edges about a question.

    t: repos, files, code, sections, contracts, edges, deps, calls, and mentions, contract_mentions, operations, workflows. Sets are small by their limits.
    """
    kind, words = plan(question)
    found: dict[str, DataFrame | str] = {"kind": kind}

    def every(of: Callable[[str], DataFrame], by: list[str], limit: int, wanted: list[str]) -> DataFrame:
        out = None
        for nth, word in enumerate(wanted):
            part = of(word).withColumn("__nth", F.lit(nth))
            out = part if out is None else out.unionByName(part)
        keep = [c for c in out.columns if c != "__nth"]
        first = out.groupBy(*by).agg(F.min_by(F.struct(*keep), "__nth").alias("r"), F.min("__nth").alias("n"))
        return first.orderBy("n", *by).limit(limit).select("r.*")

    asked = contract_targets(question)
    none = trace_contract(t["contracts"], t["edges"], "api", "\u0000")
    found["contracts"] = every(lambda x: trace_contract(t["contracts"], t["edges"], "api", x.lower()), ["repo_id", "role", "evidence_id"], 1000, asked) if asked else none
    some = words[:TERMS]
    code = every(lambda w: G.search_code(t["repos"], t["files"], t["code"], w, 10), ["code_id"], CODE, some)
    found["sections"] = every(lambda w: G.search_sections(t["repos"], t["files"], t["sections"], w, 10), ["section_id"], SECTIONS, some)
    wide = kind in ("workflow", "dependency", "impact")
    trace = lambda w: G.trace_entity(w, t["mentions"], t["contract_mentions"], t["operations"], t["workflows"], 20)
    found["entities"] = every(trace, ["repo_id", "source_kind", "name", "role"], ENTITIES, some) if wide or kind == "general" else trace("\u0000")
    found["dependencies"] = dependency_list(t["deps"], DEPENDENCIES) if wide else dependency_list(t["deps"].limit(0), DEPENDENCIES)
    if kind in ("workflow", "general") and code.isEmpty():
        code = G.list_code(t["repos"], t["files"], t["code"], FALLBACK)
    found["code"] = code
    found["edges"] = G.call_edges(t["calls"], t["code"], t["files"], t["repos"], code.select("code_id"))
    if semantic is not None:
        found["semantic"] = hybrid(semantic, None, words, SEMANTIC)
    return found


def hybrid(records: DataFrame, query: Column | None, words: list[str], limit: int = 10) -> DataFrame:
    """records (node_id, title, source_text, embedding) with a score: the larger of the cosine and 0.65 times the share of words that the text or title
    holds; what has none is left out."""
    text = F.concat_ws("\n", "title", "source_text")
    word = 0.65 * keyword_score(text, words)
    score = F.greatest(F.coalesce(cosine(F.col("embedding"), query), F.lit(0.0)), word) if query is not None else word
    return records.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "node_id").limit(limit)


def nearest(records: DataFrame, query: Column, limit: int = 10) -> DataFrame:
    """records with a score of max(0, 1 - cosine distance), which is the cosine where it is positive; exact, in one scan and a top-k."""
    return records.withColumn("score", F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - cosine(F.col("embedding"), query)))).orderBy(F.desc("score"), "node_id").limit(limit)


# What each level embeds; documents' files and sections count at 'docs'.
LEVELS = {"off": (), "all": ("System", "Repo", "File", "Section", "Code", "Entity"), "repo": ("System", "Repo"), "docs": ("System", "Repo", "File", "Section", "Entity"), "file": ("System", "Repo", "File"), "code": ("Code", "Section", "Entity")}


def records(repos: DataFrame, files: DataFrame, code: DataFrame, sections: DataFrame, level: str = "all") -> DataFrame:
    """node_id, node_kind, repo_id, title, source_text, source_hash of what a level embeds.

    repos: repo_id, name, path, language, summary; files: repo_id, file_id, path, language; code: code_id, repo_id, file_id, kind, qualified_name, signature,
    summary; sections: section_id, repo_id, file_id, heading, level, summary, text.
    """
    full = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x.isNotNull() & (x != "")), "\n")
    doc = F.col("language") == "markdown"
    out = repos.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "name", "language", F.coalesce("summary", F.lit(""))))), "\n").alias("source_text")).select(F.lit("system").alias("node_id"), F.lit("System").alias("node_kind"), F.lit(None).cast("string").alias("repo_id"), F.lit("System").alias("title"), "source_text", F.lit(False).alias("doc"))
    add = lambda df, kind, node, title, text, is_doc: df.select(F.col(node).alias("node_id"), F.lit(kind).alias("node_kind"), "repo_id", title.alias("title"), text.alias("source_text"), is_doc.alias("doc"))
    out = out.unionByName(add(repos, "Repo", "repo_id", F.col("name"), full("name", "path", "language", "summary"), F.lit(False)))
    in_file = code.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code_id", full(F.concat_ws(" ", "kind", "qualified_name"), "signature", "summary").alias("t")))), lambda x: x["t"]), "\n\n").alias("of_code"))
    in_doc = sections.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", full(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "heading"), "summary", F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("of_doc"))
    f = files.join(in_file, "file_id", "left").join(in_doc, "file_id", "left")
    out = out.unionByName(add(f, "File", "file_id", F.col("path"), full("path", "language", "of_code", "of_doc"), doc))
    paths = files.select("file_id", "path")
    s = sections.join(paths, "file_id")
    out = out.unionByName(add(s, "Section", "section_id", F.concat_ws("#", "path", "heading"), full("heading", "summary", "text"), F.lit(True)))
    c = code.join(paths, "file_id")
    out = out.unionByName(add(c, "Code", "code_id", F.concat_ws(":", "path", "qualified_name"), full("kind", "qualified_name", "signature", "summary"), F.lit(False)))
    named = sections.select("repo_id", F.col("heading").alias("by"), F.explode(entities(F.concat_ws(" ", "heading", "text"))).alias("name")).union(code.select("repo_id", F.col("qualified_name").alias("by"), F.explode(entities(F.concat_ws(" ", "qualified_name", "signature"))).alias("name")))
    e = named.groupBy("name").agg(F.max("repo_id").alias("repo_id"), F.max("by").alias("by")).withColumn("node_id", F.concat(F.lit("entity:"), normal_name(F.col("name"))))
    out = out.unionByName(add(e, "Entity", "node_id", F.col("name"), F.concat(F.col("name"), F.lit("\nMentioned by "), F.col("by")), F.lit(True)))
    kept = F.col("node_kind").isin(*LEVELS[level]) & (F.lit(level != "docs") | ~F.col("node_kind").isin("File", "Section") | F.col("doc"))
    return out.where(kept).drop("doc").withColumn("source_hash", F.sha2("source_text", 256))


def embedded(now: DataFrame, before: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """now (records) with embedding and reused: those of before (node_id, source_hash, embedding) where the hash is the same and the vector isn't empty;
    the others' texts go through embed, `batch` at a time, within the tasks that hold them."""
    old = before.where("embedding is not null and size(embedding) > 0").select("node_id", "source_hash", F.col("embedding").cast("array<double>").alias("embedding"))
    j = now.join(old, ["node_id", "source_hash"], "left")
    new = j.where("embedding is null").drop("embedding")

    def run(batches):
        for pdf in batches:
            texts, out = pdf["source_text"].tolist(), []
            for i in range(0, len(texts), batch):
                out += [list(map(float, v)) for v in embed(texts[i : i + batch])]
            yield pdf.assign(embedding=out)

    schema = f"{new.schema.simpleString()[7:-1]},embedding:array<double>"
    fresh = new.mapInPandas(run, schema).withColumn("reused", F.lit(False))
    return j.where("embedding is not null").withColumn("reused", F.lit(True)).unionByName(fresh)


# How much each kind of row counts, and what a resolution adds.
BASE = {"contract": 110, "dependency": 100, "entity": 80, "code": 70, "section": 65, "call-edge": 60, "semantic": 40}
BONUS = {"exact": 12, "probable": 8, "heuristic": 2, "dynamic-unresolved": 1}
CONTEXT, ITEM, CUT = 16000, 1200, "\n[TRUNCATED]"


def scored(candidates: DataFrame) -> DataFrame:
    """candidates (kind, confidence, resolution, …) with a score: the kind's base, ten times the confidence within 0 and 1, and the resolution's bonus."""
    base = F.create_map(*[x for k, v in BASE.items() for x in (F.lit(k), F.lit(float(v)))])
    bonus = F.create_map(*[x for k, v in BONUS.items() for x in (F.lit(k), F.lit(float(v)))])
    sure = F.greatest(F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    plus = F.when(F.col("kind").isin("contract", "dependency", "call-edge"), F.coalesce(bonus[F.coalesce("resolution", F.lit(""))], F.lit(0.0))).otherwise(0.0)
    flat = F.col("kind").isin("code", "section")
    return candidates.withColumn("score", base[F.col("kind")] + F.when(flat, 0.0).otherwise(sure * 10 + plus))


def packed(rows: DataFrame, budget: int = CONTEXT, per_item: int = ITEM) -> DataFrame:
    """Of scored candidates (query_id, kind, seq, score, location, body) those that fit each query's budget, best first: query_id, citation, kind, score, content.

    Bodies are cut to per_item characters and wrapped as untrusted blocks. What doesn't fit any more is skipped, later smaller ones may still fit; a first
    one that alone exceeds the budget is cut to it. A question's candidates are few by the limits of retrieval; each question is a group of its own.
    """
    budget, per_item = max(1000, budget), max(200, per_item)

    def trim(text: str, most: int) -> str:
        return text if len(text) <= most else text[: max(0, most - 24)] + CUT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["body"].str.strip() != ""].sort_values("seq", kind="stable")
        pdf = pdf.assign(citation=[f"C{i + 1}" for i in range(len(pdf))]).sort_values("score", ascending=False, kind="stable")
        used, out = 0, []
        for r in pdf.itertuples():
            wrap = lambda body, r=r: f"UNTRUSTED_CONTEXT_BLOCK_START citation={r.citation} source={r.kind} location={r.location}\n{body}\nUNTRUSTED_CONTEXT_BLOCK_END"
            text = wrap(trim(r.body, per_item))
            if used + len(text) > budget:
                if out:
                    continue
                text = wrap(trim(r.body, max(200, budget - 180)))
            out.append((r.query_id, r.citation, r.kind, r.score, text))
            used += len(text)
        return pd.DataFrame(out, columns=["query_id", "citation", "kind", "score", "content"])

    return rows.groupBy("query_id").applyInPandas(run, "query_id string, citation string, kind string, score double, content string")


def candidates(found: dict, query_id: str = "q") -> DataFrame:
    """Retrieved rows as candidates for packed(): kinds in the order contract, dependency, entity, code, section, call-edge, semantic."""
    parts = (("contract", "contracts"), ("dependency", "dependencies"), ("entity", "entities"), ("code", "code"), ("section", "sections"), ("call-edge", "edges"), ("semantic", "semantic"))
    out = None
    for n, (kind, name) in enumerate(parts):
        df = found.get(name)
        if df is None:
            continue
        has = lambda c, df=df: F.col(c) if c in df.columns else F.lit(None)
        place = F.concat_ws(":", F.coalesce(*[has(c).cast("string") for c in ("file_path", "path", "from_file", "title", "evidence_id")]), F.coalesce(has("line").cast("string"), has("start_line").cast("string")))
        body = F.to_json(F.struct(*df.columns))
        rows = df.select(F.lit(query_id).alias("query_id"), F.lit(kind).alias("kind"), has("confidence").cast("double").alias("confidence"), F.coalesce(has("resolution").cast("string"), has("band").cast("string")).alias("resolution"), place.alias("location"), body.alias("body"))
        rows = rows.withColumn("seq", F.lit(n * 1_000_000) + F.row_number().over(W.partitionBy("kind").orderBy("location", "body")))
        out = rows if out is None else out.unionByName(rows)
    return scored(out)


def answer(question: str, context: list) -> str:
    """A local rendering of a question's context, without any model: the kinds found and each citation's text."""
    lines = [f"# {question}", ""]
    if not context:
        return "\n".join([*lines, "No matching context was found."])
    counts: dict[str, int] = {}
    for r in context:
        counts[r["kind"]] = counts.get(r["kind"], 0) + 1
    lines.append("Found " + ", ".join(f"{n} {k}" for k, n in counts.items()) + ".")
    return "\n".join([*lines, "", *(f"[{r['citation']}] ({r['kind']}, {r['score']:.2f})\n{r['content']}" for r in context)])


def summaries(repos: DataFrame, files: DataFrame, code: DataFrame, contracts_by_repo: DataFrame) -> DataFrame:
    """repo_id, summary: a repository in one line by a template: its language, how many files and symbols, what it produces and consumes (five keys each).

    contracts_by_repo: repo_id, role, key. Counts and keys are aggregated apart before they meet.
    """
    n = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    top = lambda role: F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("role").isin(*role), F.col("key")))), 1, 5), ", ")
    sides = contracts_by_repo.groupBy("repo_id").agg(top(("producer", "owner")).alias("makes"), top(("consumer",)).alias("uses"))
    j = repos.join(n(files, "n_files"), "repo_id", "left").join(n(code, "n_symbols"), "repo_id", "left").join(sides, "repo_id", "left")
    num = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {label}: "), F.col(c), F.lit(".")))
    text = F.concat(F.col("name"), F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit("): "), num("n_files"), F.lit(" files, "), num("n_symbols"), F.lit(" symbols."), F.coalesce(some("Produces", "makes"), F.lit("")), F.coalesce(some("Consumes", "uses"), F.lit("")))
    return j.select("repo_id", text.alias("summary"))


class ProviderError(Exception):
    """A provider's failure; kind: rate-limit, timeout, server (all worth another try), auth, budget, client."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(message or kind)
        self.kind = kind


def error_kind(status: int | None, message: str = "") -> str:
    if status == 429:
        return "rate-limit"
    if status in (401, 403):
        return "auth"
    if status is not None and status >= 500:
        return "server"
    return "timeout" if re.search(r"(?i)timed? ?out|etimedout|econnreset", message) else "client"


class Policy:
    """Calls a provider with retries, growing pauses with jitter, a least pause between calls, and a budget of calls and characters."""

    def __init__(self, retries: int = 2, first: float = 0.5, most: float = 8.0, jitter: float = 0.2, pause: float = 0.0, max_calls: int | None = None, max_chars: int | None = None, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> None:
        self.retries, self.first, self.most, self.jitter, self.pause, self.max_calls, self.max_chars, self.sleep = retries, first, most, jitter, pause, max_calls, max_chars, sleep
        self.calls = self.chars = self.retried = 0
        self.random = random.Random(seed)

    def call(self, work: Callable[[], object], chars: int = 0):
        if (self.max_calls is not None and self.calls >= self.max_calls) or (self.max_chars is not None and self.chars + chars > self.max_chars):
            raise ProviderError("budget")
        self.calls, self.chars = self.calls + 1, self.chars + chars
        if self.pause and self.calls > 1:
            self.sleep(self.pause)
        for attempt in range(self.retries + 1):
            try:
                return work()
            except ProviderError as e:
                if attempt == self.retries or e.kind not in ("rate-limit", "timeout", "server"):
                    raise
                self.retried += 1
                self.sleep(min(self.most, self.first * 2**attempt) * (1 + self.jitter * (2 * self.random.random() - 1)))
        return None


def rendered(question: str, context: list) -> str:
    """The context as JSON for a model, scores to two places."""
    return json.dumps({"question": question, "context": [{"citation": r["citation"], "kind": r["kind"], "score": round(r["score"], 2), "content": r["content"]} for r in context]}, ensure_ascii=False, indent=2)
