"""Audits of contracts, and evaluation against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.operators.reading import set_metrics

# Words that give a class or a bare method away.
CLASSES = "list map set hashmap arraylist collection iterator string integer double float long boolean byte short character date calendar uuid file path stream".split()
SUFFIXES = "util utils helper helpers service services controller controllers config configs dto dtos dao daos entity entities impl mapper mappers".split()
METHODS = "id param list add delete update query save edit remove export import upload download check status config detail info get post put".split()


def class_level(packages: DataFrame) -> DataFrame:
    """Package keys (key) whose last part names a class rather than a package."""
    last = F.lower(F.element_at(F.split("key", r"\."), -1))
    return packages.where(F.col("key").contains(".") & (last.isin(*CLASSES) | last.rlike(f"(?:{'|'.join(SUFFIXES)})$")))


def no_slash(apis: DataFrame) -> DataFrame:
    return apis.where(~F.col("key").startswith("/"))


def method_only(producers: DataFrame) -> DataFrame:
    """Producers (key, …) of a path of one part that is a common method's name; a template part counts as 'param'."""
    parts = F.filter(F.split(F.regexp_replace("key", r"\{[^}]+\}", "param"), "/"), lambda s: s != "")
    return producers.where((F.size(parts) == 1) & F.lower(F.get(parts, 0)).isin(*METHODS))


def prefixes(key: Column) -> Column:
    """What stands before each slash of a key but a leading one."""
    parts = F.split(key, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")


def missing_mapping(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """Consumers (repo_id, key) whose key nobody produces, though someone produces a key below it: with the number of such keys and repositories.

    Producers' prefixes are counted before they are equi-joined, so no pair of keys is compared or made.
    """
    open_ = consumers.select("repo_id", "key").distinct().join(producers.select("key").distinct(), "key", "left_anti")
    below = producers.select(F.col("repo_id").alias("p"), F.col("key").alias("sub")).distinct().where(F.col("sub").contains("/")).select("p", "sub", F.explode(prefixes(F.col("sub"))).alias("key"))
    return open_.join(below.groupBy("key").agg(F.count("*").alias("n"), F.min("sub").alias("example")), "key").select("repo_id", "key", "n", "example")


def case_variants(keys: DataFrame) -> DataFrame:
    g = keys.select("key").distinct().groupBy(F.lower("key").alias("folded")).agg(F.count("*").alias("n"), F.min("key").alias("least"))
    return g.where("n > 1")


def golden(found: dict[str, DataFrame], wanted: dict[str, DataFrame], absent: DataFrame | None = None) -> DataFrame:
    """subject, type, tp, fp, fn, precision, recall, f1: sets (key, type) of contracts, participants and dependencies against a golden set, and how many
    contracts of `absent` (key) were found though they must not be (subject 'absent', fp)."""
    out = None
    for subject in sorted(wanted):
        part = set_metrics(found[subject], wanted[subject], "type").select(F.lit(subject).alias("subject"), "*")
        out = part if out is None else out.unionByName(part)
    if absent is not None:
        hits = found["contracts"].select("key").distinct().join(absent.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("fp"))
        out = out.unionByName(hits.select(F.lit("absent").alias("subject"), F.lit("ALL").alias("type"), F.lit(0).cast("long").alias("tp"), "fp", F.lit(0).cast("long").alias("fn"), F.when(F.col("fp") == 0, 1.0).otherwise(0.0).alias("precision"), F.lit(1.0).alias("recall"), F.when(F.col("fp") == 0, 1.0).otherwise(0.0).alias("f1")))
    return out
