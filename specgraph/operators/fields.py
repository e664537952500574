"""Where source texts touch a field: outside comments, and outside strings but for subscripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_STRINGS = "|".join(rf"{q}(?:\\[\s\S]?|[^{q}\\])*+{q}?" for q in "\"'`")
_COMMENTS = r"//[^\n]*|/\*(?:(?!\*/)[\s\S])*+(?:\*/)?"
#: Python, shell and properties files have # comments; JavaScript and TypeScript files don't.
TOKENS = {hashes: re.compile(f"(?P<string>{_STRINGS})|(?:{_COMMENTS}{'|#[^\n]*' * hashes})") for hashes in (False, True)}
BLANK = re.compile(r"[^\n]")
FOUND = ArrayType(StructType([StructField("line", IntegerType()), StructField("raw", StringType())]))


def lines_with(text: str, field: str, path: str | None) -> list[dict]:
    """The lines that read or write the field: x.field, x["field"], getField, setField; each line once."""
    name = re.escape(field)
    quoted = re.compile(rf"""\[["']{name}["']\]""")
    plain = re.compile(rf"\.{name}\b|\b[gs]et{re.escape(field[:1].upper() + field[1:])}\b", re.ASCII)
    tokens = TOKENS[not re.search(r"\.[jt]sx?$", path or "", re.IGNORECASE)]
    blank = lambda s: BLANK.sub(" ", s)
    code = tokens.sub(lambda m: m[0] if m["string"] else blank(m[0]), text).split("\n")
    bare = tokens.sub(lambda m: m[0][0] + blank(m[0][1:-1]) + m[0][1:][-1:] if m["string"] else blank(m[0]), text).split("\n")
    return [{"line": i, "raw": line.strip()} for i, (line, c, b) in enumerate(zip(text.split("\n"), code, bare, strict=True), 1) if quoted.search(c) or plain.search(b)]


def field_references(files: DataFrame, field: str) -> DataFrame:
    """file_id, path, line, raw for every line of files (file_id, path, source) that touches the field. A null source has none."""

    @F.pandas_udf(FOUND)
    def search(source: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([lines_with(s or "", field, p) for s, p in zip(source, path, strict=True)])

    # Files without the name anywhere never reach Python.
    files = files.where(F.contains(F.lower("source"), F.lit(field.lower())))
    return files.select("file_id", "path", F.explode(search("source", "path")).alias("r")).select("file_id", "path", "r.line", "r.raw")
