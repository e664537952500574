"""Identities and canonical keys as column functions; everything joins on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(c) -> Column:
    """Trimmed, back slashes turned, other runs of odd characters a dash, no dash at either end, lower case."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"[^a-zA-Z0-9_.-]+", "-")
    return F.lower(F.regexp_replace(c, r"^-+|-+$", ""))


def api_path(c) -> Column:
    """A path without scheme, host and query; parameters as {name}; one slash in front, none doubled, none at the end."""
    c = F.trim(c)
    for pattern, by in ((r"^(?i)https?://[^/]+", ""), (r"\?.*$", ""), (r"/:([A-Za-z_]\w*)", "/{$1}"), (r"\$\{([A-Za-z_]\w*)\}", "{$1}"), (r"\$\{[^}]+\}", "{param}"), (r"^/?", "/"), (r"/{2,}", "/"), (r"(.)/$", "$1")):
        c = F.regexp_replace(c, pattern, by)
    return c


def http_key(method, path) -> Column:
    """METHOD:/path, or the path alone; addresses of other schemes keep theirs; the path in lower case."""
    bare = F.trim(path)
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/+", "/"), "/$", "")
    p = F.lower(F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~bare.rlike("^(?i)https?://"), other).otherwise(api_path(path)))
    return F.when(method.isNull() | (method == ""), p).otherwise(F.concat(F.upper(F.trim(method)), F.lit(":"), p))


def template(c) -> Column:
    """Every segment of digits (and what follows in it up to a dot) as {id}."""
    return F.regexp_replace(c, r"/[0-9]+(?=$|[/.#])", "/{id}")


def first_segment(c) -> Column:
    """The bucket of a path: its first segment, '' for the root, '*' for a template."""
    s = F.split(F.regexp_replace(c, "^/", ""), "/")[0]
    return F.when(s.startswith("{"), F.lit("*")).otherwise(s)


def band(c) -> Column:
    return F.when(c >= 0.9, "exact").when(c >= 0.8, "probable").otherwise("heuristic")


def is_active(c) -> Column:
    """An unset flag counts as set."""
    return F.coalesce(c, F.lit(True))


def content_hash(c) -> Column:
    return F.sha2(c, 256)


def event_key(c) -> Column:
    return F.lower(F.trim(c))


def grpc_key(package, service, method) -> Column:
    head = F.when(package.isNull() | (package == ""), F.lit("")).otherwise(F.concat(F.lower(package), F.lit(".")))
    return F.regexp_replace(F.concat(head, service, F.lit("/"), method), r"\s", "")


def dubbo_key(interface, method) -> Column:
    return F.concat(F.lower(F.regexp_replace(interface, r"\s", "")), F.lit("#"), method)
