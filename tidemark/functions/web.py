"""URLs, globs and crawl scope as columns."""

from __future__ import annotations

import ipaddress
import re
from fnmatch import translate
from functools import reduce
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings of host names that exist on a local network only.
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home.arpa")


def authority(url: Column) -> Column:
    """Host with user info and port, as in ``//authority/``; "" where there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host name without user info, port and brackets; "" where there is none."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(
        F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))
    )


def path(url: Column) -> Column:
    """Path without query and fragment; "" where there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path, or "/" where it is empty."""
    return F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))


def site_of(url_or_domain: Column) -> Column:
    """The authority of a URL, or the value itself where it has none."""
    return F.coalesce(F.nullif(authority(url_or_domain), F.lit("")), url_or_domain)


def path_depth(p: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(p, "/"), lambda s: s != ""))


def destination_rank(destination: Column) -> Column:
    """Sort key that puts shallow destinations first and unknown ones last."""
    return F.coalesce(path_depth(destination), F.lit(1 << 30))


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell glob as an anchored Java regular expression."""
    body = translate(pattern)
    inner = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
    inner = inner.replace("(?>", "(?:")
    return f"(?s)\\A(?:{inner})\\z"


def matches_any(value: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether some glob matches; false for no patterns."""
    return reduce(lambda a, b: a | b, (value.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def in_scope(url: Column, target: Column, include=(), exclude=(), same_origin: bool = True) -> Column:
    """Crawl scope: same authority, then no exclude glob, then some include glob, on the path."""
    ok = F.lit(True)
    if same_origin:
        ok = ok & (authority(url) == authority(target))
    if exclude:
        ok = ok & ~matches_any(path(url), exclude)
    if include:
        ok = ok & matches_any(path(url), include)
    return ok


def element_rule(name: Column, include=None, exclude=None) -> Column:
    """struct(allowed, reason) of an element by its accessible name; exclude wins."""
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("allowed"), F.lit(why).alias("reason"))
    out = verdict(True, "element rules permit this action")
    if include:
        out = F.when(matches_any(name, include), out).otherwise(verdict(False, "skipped: did not match an --include-element pattern"))
    if exclude:
        out = F.when(matches_any(name, exclude), verdict(False, "skipped: matched an --exclude-element pattern")).otherwise(out)
    return out


def _resolve(base: str | None, ref: str | None) -> str | None:
    if base is None or ref is None:
        return None
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null for null or unparsable input."""
    return pd.Series([_resolve(b, r) for b, r in zip(base, ref)], dtype=object)


def destination_path(href: Column, base: Column) -> Column:
    """Path a link leads to; null for fragments and script, mail and telephone links."""
    bare = F.trim(href)
    none = bare.isNull() | (bare == "") | bare.startswith("#") | F.lower(bare).rlike(r"^(javascript|mailto|tel):")
    return F.when(~none, url_path(resolve(base, bare)))


def _address(host_name: str):
    try:
        return ipaddress.ip_address(host_name)
    except ValueError:
        return None


def is_local_host(host_name: str) -> bool:
    """Localhost, a local suffix, a word without dots, or a loopback, private or link-local address."""
    if host_name == "localhost" or host_name.endswith(LOCAL_SUFFIXES):
        return True
    address = _address(host_name)
    if address is None:
        return "." not in host_name
    return address.is_loopback or address.is_private or address.is_link_local


def sandbox_of(target: str, declared: bool) -> bool:
    name = (urlsplit(target).hostname or "").lower()
    address = _address(name)
    if name == "localhost" or (address is not None and address.is_loopback):
        return True
    return bool(declared and address is not None and address.is_private)


@F.pandas_udf(T.BooleanType())
def is_sandbox(target: pd.Series, declared: pd.Series) -> pd.Series:
    """Loopback targets, and declared ones whose host is a private address literal."""
    seen: dict = {}

    def one(t, d):
        key = (t, bool(d))
        if key not in seen:
            try:
                seen[key] = sandbox_of(t, bool(d))
            except ValueError:
                seen[key] = False
        return seen[key]

    return pd.Series([None if t is None else one(t, d) for t, d in zip(target, declared)], dtype=object)


@F.pandas_udf(T.StringType())
def complete_address(address: pd.Series) -> pd.Series:
    """An address with a scheme: http for local hosts, https for others; "" stays."""

    def one(a):
        if a is None:
            return None
        a = a.strip()
        if not a or "://" in a:
            return a
        try:
            name = (urlsplit("//" + a).hostname or "").lower()
        except ValueError:
            name = a
        return f"{'http' if is_local_host(name) else 'https'}://{a}"

    return address.map(one, na_action="ignore")


#: Request categories in display order, and the extensions that name them.
CATEGORIES = ("Documents", "Scripts", "Styles", "Images", "Fonts", "Media", "Data", "Other")
EXTENSIONS = {
    "Documents": ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp"),
    "Scripts": ("js", "mjs", "cjs"),
    "Styles": ("css",),
    "Images": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "avif", "apng"),
    "Fonts": ("woff", "woff2", "ttf", "otf", "eot"),
    "Media": ("mp4", "webm", "ogg", "mp3", "wav", "mov", "m4a", "avi"),
    "Data": ("json", "xml"),
}


def request_category(url: Column) -> Column:
    """Kind of a request by its URL alone: extension, then an API path, else a document."""
    segment = F.element_at(F.split(path(url), "/"), -1)
    extension = F.lower(F.element_at(F.split(segment, r"\."), -1))
    by_extension = F.lit("Other")
    for kind, extensions in EXTENSIONS.items():
        by_extension = F.when(extension.isin(*extensions), kind).otherwise(by_extension)
    return F.when(segment.contains("."), by_extension).when(F.lower(path(url)).contains("/api/"), "Data").otherwise("Documents")


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), category)
