"""Changes of small graph tables."""

from specgraph.operators import writing as V


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    assert rows(V.upsert(old, new, ["id"], "seq"), "id", "v") == [("a", 1), ("b", 4), ("c", 5)]
    assert rows(V.upsert(old, new.limit(0), ["id"], "seq"), "id", "v") == [("a", 1), ("b", 2)]
    code = spark.createDataFrame([("r", "f", "x:1"), ("r", "g", "y:1"), ("q", "f", "z:1")], "repo_id string, file_id string, id string")
    assert rows(V.replaced_files(code, spark.createDataFrame([("r", "f", "x:2")], code.schema)), "id") == [("x:2",), ("y:1",), ("z:1",)]


def test_clear_repo(spark):
    nodes = spark.createDataFrame([("a", "r"), ("b", "q"), ("c", "q")], "id string, repo_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "from_id string, to_id string")
    left, kept = V.without_repos(nodes, edges, spark.createDataFrame([("r",)], "repo_id string"))
    assert rows(left, "id") == [("b",), ("c",)] and rows(kept, "from_id", "to_id") == [("b", "c")]


def test_stale_hidden_rejected(spark):
    files = spark.createDataFrame([("r", "f", None), ("r", "g", True), ("r", "h", False), ("q", "f", True)], "repo_id string, file_id string, active boolean")
    repos, seen = spark.createDataFrame([("r",)], "repo_id string"), spark.createDataFrame([("r", "f")], "repo_id string, file_id string")
    stale = V.stale_files(files, seen, repos)
    assert rows(stale, "repo_id", "file_id") == [("r", "g")]
    assert rows(V.stale_files(files, seen.limit(0), repos), "file_id") == [("f",), ("g",)]
    assert rows(V.switched_off(files, stale, ["repo_id", "file_id"]), "repo_id", "file_id", "active") == [("q", "f", True), ("r", "f", None), ("r", "g", False), ("r", "h", False)]
    spec = spark.createDataFrame([("s", "1"), ("t", "2"), ("u", None)], "id string, batch_id string")
    journal = spark.createDataFrame([("1", "started", 1), ("1", "committed", 2), ("2", "started", 1)], "batch_id string, status string, at int")
    assert rows(V.hidden_batches(spec, journal), "id", "active") == [("s", None), ("t", False), ("u", None)]
    evidence = spark.createDataFrame([("e", True), ("f", True)], "evidence_id string, active boolean")
    edges = spark.createDataFrame([("e", "r"), ("f", "r")], "evidence_id string, repo_id string")
    on, off = V.rejected(evidence, edges, evidence.where("evidence_id = 'e'"))
    assert rows(on, "evidence_id", "active") == [("e", False), ("f", True)] and rows(off, "evidence_id", "active") == [("e", False), ("f", None)]


def test_aliases_and_sink(spark, tmp_path):
    held = spark.createDataFrame([("web", "r1")], "alias string, repo_id string")
    new = spark.createDataFrame([("Web", "r2", 1), ("WEB", "r3", 2), ("Api", "r4", 1)], "alias string, repo_id string, at int")
    assert rows(V.aliases(held, new), "alias", "repo_id") == [("api", "r4"), ("web", "r3")]
    path = str(tmp_path / "t")
    V.write_repos(spark.createDataFrame([("a", "r"), ("b", "q")], "id string, repo_id string"), path)
    V.write_repos(spark.createDataFrame([("c", "r")], "id string, repo_id string"), path)
    assert rows(spark.read.parquet(path), "id", "repo_id") == [("b", "q"), ("c", "r")]
