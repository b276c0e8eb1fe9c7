"""URL keys and resolution as column expressions. Crawled references may hold raw spaces and letters beyond ASCII, on
which the URL functions of SQL give null, so the parts come from patterns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host and port, in lower case, without a dot at the end."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HEAD + r"([^/?#]*)", 1)), r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"(\?[^#]*)", 1)


def norm_path(raw: Column) -> Column:
    """A path without slashes at its end; the root is "/"."""
    return F.coalesce(F.nullif(F.regexp_replace(raw, "/+$", ""), F.lit("")), F.lit("/"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Host without www. and path without a slash or index page at its end; scheme, query and fragment don't count."""
    trimmed = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", ""), "/+$", "")
    return F.concat(bare_host(url), trimmed)


def redirect_key(url: Column) -> Column:
    """Scheme and host in lower case; path, slash and query as they are."""
    return F.concat(scheme(url), F.lit("://"), authority(url), path(url), query_string(url))


def passage_key(url: Column) -> Column:
    raw = path(url)
    return F.concat(bare_host(url), F.when(raw == "", "/").otherwise(raw))


def template_key(raw: Column) -> Column:
    """The first two segments of a path with runs of digits replaced: pages of one template share it."""
    parts = F.slice(F.filter(F.split(raw, "/"), lambda s: s != ""), 1, 2)
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "{d}")), "/"))


def _without_dots(url: Column) -> Column:
    """A URL whose path has no dot segments: `.` goes, `..` goes with the segment before it, as far as there is one."""
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    segments = F.split(F.regexp_extract(url, parts, 2), "/")

    def step(kept, s):
        above = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))  # the first is what stands before the first slash
        return F.when(s == "..", above).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    # A path that ends in a dot segment is a folder.
    last = F.element_at(segments, -1)
    path = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(F.regexp_extract(url, parts, 1), path, F.regexp_extract(url, parts, 3))).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL, without dot segments; what has a host of its own stays as it is."""
    root = F.regexp_extract(base, _HEAD.replace("^", "^(", 1) + r"[^/?#]*)", 1)
    folder = F.regexp_extract(base, _HEAD.replace("^", "^(", 1) + r"[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), _without_dots(F.concat(root, href)))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href))
        .otherwise(_without_dots(F.concat(folder, href)))
    )


@F.pandas_udf(StringType())
def resolve_any(base: pd.Series, href: pd.Series) -> pd.Series:
    """href as an absolute URL by the rules of RFC 3986, dot segments included."""

    def one(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([None if b is None or h is None else one(b, h) for b, h in zip(base, href)], dtype="object")


_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=")


def percent_encoded(url: str | None) -> str | None:
    """A URL whose bytes outside the safe set are escaped; escapes that it has stay, in upper case."""
    if url is None:
        return None
    raw = url.encode("utf-8", "surrogatepass")
    hexa = b"0123456789abcdefABCDEF"
    out, i = [], 0
    while i < len(raw):
        if raw[i] == 37 and i + 2 < len(raw) and raw[i + 1] in hexa and raw[i + 2] in hexa:
            out.append(raw[i : i + 3].decode().upper())
            i += 3
            continue
        out.append(chr(raw[i]) if raw[i] in _SAFE else f"%{raw[i]:02X}")
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def encode_url(url: pd.Series) -> pd.Series:
    return pd.Series([percent_encoded(u) for u in url], dtype="object")
