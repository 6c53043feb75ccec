"""API paths as columns: templates and what looks like an endpoint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of static files, which are no endpoints.
STATIC = (
    ".js", ".mjs", ".cjs", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp",
    ".avif", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp4", ".mp3", ".wav", ".pdf", ".html", ".htm",
)
#: Fixed value: a quoted text of 2 to 200 characters in a script.
QUOTED = "[\"'`]([^\"'`\\n]{2,200})[\"'`]"
MAX_ENDPOINTS = 200
ID_SEGMENT = r"(?U)\A(?:\d+|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|(?i:[0-9a-f]{24,}))\z"


def looks_like_id(segment: Column) -> Column:
    """All digits, a UUID, or 24 or more hex digits."""
    return segment.rlike(ID_SEGMENT)


def template_path(path: Column) -> Column:
    """A path with its identifiers as ``{id}``."""
    return F.array_join(F.transform(F.split(path, "/", -1), lambda s: F.when(looks_like_id(s), "{id}").otherwise(s)), "/")


def bare_path(candidate: Column) -> Column:
    return F.regexp_extract(candidate, r"^([^?#]*)", 1)


def looks_like_endpoint(candidate: Column) -> Column:
    """An absolute path with a segment, no blanks or angle brackets, that is no static file."""
    path = bare_path(candidate)
    static = "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in STATIC) + r")\z"
    return (
        candidate.startswith("/")
        & ~candidate.startswith("//")
        & path.rlike("[^/]")
        & ~path.rlike(r"(?U)[\s<>]")
        & ~path.rlike(static)
    )


def script_endpoints(script: Column) -> Column:
    """Templated endpoint candidates among a script's quoted texts, sorted and distinct."""
    quoted = F.regexp_extract_all(script, F.lit(QUOTED))
    return F.array_sort(F.array_distinct(F.transform(F.filter(quoted, looks_like_endpoint), lambda c: template_path(bare_path(c)))))
