"""Sections, links, fenced blocks and field references on small texts."""

from pyspark.sql import functions as F

from specgraph.operators import documents as M
from specgraph.operators import fields

TEXT = "intro\n# One ##\nsee [b](../b.md#top) and ![no](x.png)\r\n```py\n# in a fence\nx = 1\n```\n## Two\n[web](https://x.y/z) [abs](/c.md) [c](./d/../c.md?q=1)\n~~~\nopen\n```"


def docs(spark):
    return spark.createDataFrame([("r", "docs/a/x.md", TEXT), ("r", "plain.md", " just\ntext "), ("r", "empty.md", ""), ("r", "null.md", None)], "repo_id string, path string, text string")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_sections(spark):
    got = rows(M.sections(docs(spark), "text", "path"), "path", "heading", "level", "start_line", "end_line")
    assert got == sorted([("docs/a/x.md", "One", 1, 2, 4), ("docs/a/x.md", "in a fence", 1, 5, 7), ("docs/a/x.md", "Two", 2, 8, 12), ("plain.md", "plain.md", 0, 1, 2), ("empty.md", "empty.md", 0, 1, 1)])
    assert ("plain.md", "just\ntext") in rows(M.sections(docs(spark), "text", "path"), "path", "text")


def test_links(spark):
    found = M.links(docs(spark), "text")
    assert rows(found, "label", "target", "line") == [("abs", "/c.md", 9), ("b", "../b.md", 3), ("c", "./d/../c.md?q=1", 9), ("web", "https://x.y/z", 9)]
    assert rows(found.select("label", M.resolved(F.col("path"), F.col("target")).alias("to")).where("to is not null"), "label", "to") == [("abs", "c.md"), ("b", "docs/b.md"), ("c", "docs/a/c.md")]
    files = spark.createDataFrame([("r", "docs/b.md", "f1"), ("r", "c.md", "f2"), ("q", "docs/a/c.md", "f3")], "repo_id string, path string, file_id string")
    assert rows(M.links_to_files(found, files), "label", "target_file_id") == [("abs", "f2"), ("b", "f1")]


def test_fenced(spark):
    assert rows(M.fenced(docs(spark), "text"), "language", "start_line", "end_line", "body") == [("", 10, 12, "open\n```"), ("py", 4, 7, "# in a fence\nx = 1")]


SOURCE = """a.total = 1 // b.total
/* c.total
d.total */ e.total()
s = ".total" + 'it\\'s .total'
f["total"]; g.totals; # h.total
getTotal(); "setTotal"
`open .total
"""


def test_field_references(spark):
    files = spark.createDataFrame([("1", "a.py", SOURCE), ("2", "a.ts", SOURCE), ("3", "b.py", None), ("4", "c.py", "")], "file_id string, path string, source string")
    got = rows(fields.field_references(files, "total"), "file_id", "line")
    assert got == [("1", 1), ("1", 3), ("1", 5), ("1", 6), ("2", 1), ("2", 3), ("2", 5), ("2", 6)]
    assert fields.lines_with("  x['total'] ", "total", None) == [{"line": 1, "raw": "x['total']"}]
    assert fields.lines_with('x = "\\', "x", None) == []
