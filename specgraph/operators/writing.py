"""How a graph's tables change: upserts, cleared repositories, stale files, hidden batches, rejected evidence. DataFrames in and out, then one sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States in which a batch's rows aren't to be seen.
INCOMPLETE = ("started", "awaiting-cleanup")


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: the last by `order`."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with rows put in: a key that the rows have loses what the table had; among rows of one key the last by `order` stays.

    Without `order` the rows' keys are taken to be unique. Columns that only one side has are null on the other.
    """
    new = last_of_each(rows, keys, order).drop(order) if order else rows
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_files(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with everything of the files (repo_id, file_id) in rows replaced, so that moved symbols leave no old row."""
    return table.join(rows.select("repo_id", "file_id").distinct(), ["repo_id", "file_id"], "left_anti").unionByName(rows, allowMissingColumns=True)


def without_repos(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, repo_id) and edges (from_id, to_id) without the repositories in repos (repo_id), and without edges at either end of what went."""
    gone = nodes.join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select(F.col("id").alias("gone")).distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(gone, edges[end] == gone["gone"], "left_anti")
    return nodes.join(repos.select("repo_id").distinct(), "repo_id", "left_anti"), edges


def stale_files(files: DataFrame, seen: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id, file_id of the files of the scanned repos (repo_id) that the scan (seen: repo_id, file_id) hasn't met and that count as active."""
    mine = files.where(F.coalesce(F.col("active"), F.lit(True))).join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    return mine.join(seen, ["repo_id", "file_id"], "left_anti").select("repo_id", "file_id").distinct()


def switched_off(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The table with active = false wherever ids has the row's keys; other rows keep theirs, null (active) included."""
    off = ids.select(*keys).distinct().withColumn("__off", F.lit(True))
    held = table if "active" in table.columns else table.withColumn("active", F.lit(None).cast("boolean"))
    columns = held.columns
    return held.join(off, keys, "left").withColumn("active", F.when(F.col("__off"), F.lit(False)).otherwise(F.col("active"))).select(*columns)


def hidden_batches(table: DataFrame, journal: DataFrame) -> DataFrame:
    """The table with the rows of batches switched off whose last journal entry (batch_id, status, at) is incomplete."""
    last = last_of_each(journal, ["batch_id"], "at").where(F.col("status").isin(*INCOMPLETE))
    return switched_off(table, last, ["batch_id"])


def rejected(evidence: DataFrame, edges: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and the edges resting on it, switched off where feedback (evidence_id) rejects it; specs stay."""
    return switched_off(evidence, feedback, ["evidence_id"]), switched_off(edges, feedback, ["evidence_id"])


def aliases(table: DataFrame, alias: DataFrame) -> DataFrame:
    """alias (alias, repo_id) put into the table; an alias is known by its lower case and the newest repository wins."""
    return upsert(table, alias.withColumn("alias", F.lower("alias")).groupBy("alias").agg(F.max_by("repo_id", "at").alias("repo_id")), ["alias"])


def merge_set(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with rows merged in, column by column: what a row leaves null keeps its value, new keys are added; of rows of one key each column's last
    value by `order` counts."""
    by = F.col(order) if order else F.lit(0)
    values = [c for c in rows.columns if c not in (*keys, order)]
    new = rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"__{c}") for c in values])
    j = table.withColumn("__old", F.lit(True)).join(new, keys, "full")
    every = [c for c in table.columns if c not in keys] + [c for c in values if c not in table.columns]
    pick = lambda c: (F.coalesce(f"__{c}", c) if c in table.columns else F.col(f"__{c}")) if c in values else F.col(c)
    return j.select(*keys, *[pick(c).alias(c) for c in every])


def bulk_copy(table: DataFrame, path: str) -> None:
    """Writes a whole table by repository; refuses where there already is one with rows."""
    spark = table.sparkSession
    try:
        empty = spark.read.parquet(path).isEmpty()
    except AnalysisException:
        empty = True
    if not empty:
        raise ValueError(f"{path} isn't empty: a bulk copy is for an empty graph")
    table.hint("rebalance", "repo_id").write.mode("overwrite").partitionBy("repo_id").parquet(path)


def write_repos(table: DataFrame, path: str, repos: list[str] | None = None) -> None:
    """Replaces the partitions of the repositories in the table and leaves others alone.

    repos: repositories that the table stands for as a whole; of these, one without rows loses its partition, so that no stale row stays.
    """
    spark = table.sparkSession
    # Rebalanced rather than hashed: a large repository is split into several files, small ones share a task.
    table.hint("rebalance", "repo_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)
    if repos:
        left = {r["repo_id"] for r in table.select("repo_id").where(F.col("repo_id").isin(repos)).distinct().collect()}  # a few named ones
        jvm = spark.sparkContext._jvm
        for repo in repos:
            if repo not in left:
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)
                gone = jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={name}")
                gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def stale_marked(tables: dict[str, DataFrame], seen: DataFrame, repos: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with everything of files that a scan of repos (repo_id) hasn't met (seen: repo_id, file_id) switched off, and the stale files.

    tables: files, and any of code, sections, evidence, specs (with file_id), imports (from_file, to_file), calls (from_code, to_code), edges and entity
    mentions (evidence_id), relations (from_spec, to_spec), deps (from_repo, to_repo). A repository without any file left loses its dependencies.
    """
    stale = stale_files(tables["files"], seen, repos)
    ids, out = stale.select("file_id"), dict(tables)
    for name in ("files", "code", "sections", "evidence", "specs"):
        if name in out:
            out[name] = switched_off(out[name], ids, ["file_id"])

    def off(name: str, gone: DataFrame, ends: tuple[str, ...]) -> None:
        if name in out:
            for end in ends:
                out[name] = switched_off(out[name], gone.toDF(end), [end])

    off("imports", ids, ("from_file", "to_file"))
    for holder, key, name, ends in (("code", "code_id", "calls", ("from_code", "to_code")), ("evidence", "evidence_id", "edges", ("evidence_id",)), ("evidence", "evidence_id", "mentions", ("evidence_id",)), ("specs", "spec_id", "relations", ("from_spec", "to_spec"))):
        if holder in tables:
            off(name, tables[holder].join(ids, "file_id", "left_semi").select(key).distinct(), ends)
    bare = repos.select("repo_id").distinct().join(seen.select("repo_id").distinct(), "repo_id", "left_anti")
    off("deps", bare, ("from_repo",))
    return out, stale
