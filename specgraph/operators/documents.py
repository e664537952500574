"""Markdown documents: sections, links to files, fenced blocks. SQL functions within a row; only the join with files shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a heading, which white space and a title follow; closing marks and white space behind a title aren't part of it.
MARKS, BEHIND = r"^#{1,6}(?=\s+\S)", r"[\s#]+$"
#: A link: a label in brackets, a target in parentheses up to a fragment, a title or the end; images and escaped brackets are none.
LINK = r"(?<![!\\])\[([^\[\]]+)\]\(\s*<?([^()\s#<>]+)[^()]*\)"
#: What opens a fenced block: three marks or more and an info string without any of them, whose first word is the language.
OPENING = r"^\s*(`{3,}(?=[^`]*$)|~{3,})"


def lines_of(text) -> Column:
    return F.split(text, r"\r?\n", -1)


def sections(df: DataFrame, text: str, title: str) -> DataFrame:
    """df without its text, and heading, level, start_line, end_line, text of each section; headings in fences count.

    Without a heading the document is one section of level 0 under its title; what precedes the first heading belongs to none. A null text has none.
    """
    found = F.filter(
        F.transform("__lines", lambda line, i: F.struct((i + 1).alias("at"), F.length(F.regexp_extract(line, MARKS, 0)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), BEHIND, "")).alias("heading"))),
        lambda x: x["level"] > 0,
    )
    whole = F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("level"), F.col(title).alias("heading")))
    ends = lambda i: F.coalesce(F.get("__heads", i + 1)["at"], F.size("__lines") + 1) - 1
    part = lambda x, i: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), x["at"].alias("start_line"), ends(i).alias("end_line"))
    df = df.where(F.col(text).isNotNull()).withColumn("__lines", lines_of(text)).withColumn("__heads", found)
    df = df.withColumn("__heads", F.when(F.size("__heads") > 0, F.col("__heads")).otherwise(whole))
    df = df.drop(text).withColumn("__s", F.explode(F.transform("__heads", part)))
    body = F.array_join(F.slice("__lines", F.col("__s.start_line"), F.col("__s.end_line") - F.col("__s.start_line") + 1), "\n")
    return df.select("*", "__s.*", F.regexp_replace(body, r"^\s+|\s+$", "").alias("text")).drop("__s", "__lines", "__heads")


def links(df: DataFrame, text: str) -> DataFrame:
    """df without its text, and label, target and line of each link that isn't an image; the fragment is cut off."""
    df = df.withColumn("__lines", lines_of(text)).drop(text).select("*", F.posexplode("__lines").alias("__i", "__line")).drop("__lines")
    whole = F.explode(F.regexp_extract_all("__line", F.lit(LINK), F.lit(0)))
    df = df.select("*", whole.alias("__link"), (F.col("__i") + 1).alias("line"))
    return df.select("*", F.regexp_extract("__link", LINK, 1).alias("label"), F.regexp_extract("__link", LINK, 2).alias("target")).drop("__i", "__line", "__link")


def resolved(path, target) -> Column:
    """The file that a link in the document at `path` means; null for addresses with a scheme and for fragments."""
    bare = F.regexp_extract(target, r"^[^#?]*", 0)
    base = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), bare))

    def step(done, x):
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(x.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    parts = F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), step)
    return F.when(~target.rlike(r"^(?i)[a-z][a-z0-9+.-]*:|^#") & (bare != ""), F.array_join(parts, "/"))


def links_to_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Links (repo_id, path, target, …) with the file_id of what they mean in files (repo_id, path, file_id)."""
    goal = files.select("repo_id", F.col("path").alias("__path"), F.col("file_id").alias("target_file_id"))
    return found.withColumn("__path", resolved(F.col("path"), F.col("target"))).join(goal, ["repo_id", "__path"]).drop("__path")


def fenced(df: DataFrame, text: str) -> DataFrame:
    """df without its text, and language, start_line, end_line, body of each fenced block; one left open ends with the document.

    A block ends with a line of its opening mark alone, at least as often as it opened with.
    """
    block = "struct<language:string,start_line:int,end_line:int,size:int>"
    blank = F.struct(F.lit("").alias("mark"), F.lit("").alias("language"), F.lit(0).alias("at"), F.array().cast(f"array<{block}>").alias("found"))

    def ended(s, last, size):
        one = F.struct(s["language"].alias("language"), s["at"].alias("start_line"), last.alias("end_line"), size.alias("size")).cast(block)
        return F.array_append(s["found"], one)

    def step(s, x):
        bare, mark = F.trim(x["line"]), F.regexp_extract(x["line"], OPENING, 1)
        opened = F.struct(mark.alias("mark"), F.regexp_extract(F.regexp_replace(x["line"], OPENING, ""), r"^\s*([\w-]*)", 1).alias("language"), x["n"].alias("at"), s["found"].alias("found"))
        shut = (F.length(bare) >= F.length(s["mark"])) & (bare == F.repeat(F.substring(s["mark"], 1, 1), F.length(bare)))
        closed = F.struct(F.lit("").alias("mark"), F.lit("").alias("language"), F.lit(0).alias("at"), ended(s, x["n"], x["n"] - s["at"] - 1).alias("found"))
        return F.when((s["mark"] == "") & (mark != ""), opened).when((s["mark"] != "") & shut, closed).otherwise(s)

    numbered = F.transform("__lines", lambda line, i: F.struct(line.alias("line"), (i + 1).alias("n")))
    whole = lambda s: F.when(s["mark"] == "", s["found"]).otherwise(ended(s, F.size("__lines"), F.size("__lines") - s["at"]))
    df = df.withColumn("__lines", lines_of(text)).drop(text)
    df = df.select("*", F.explode(F.aggregate(numbered, blank, step, whole)).alias("__b")).select("*", "__b.*")
    return df.withColumn("body", F.array_join(F.slice("__lines", F.col("start_line") + 1, F.col("size")), "\n")).drop("__b", "__lines", "size")
