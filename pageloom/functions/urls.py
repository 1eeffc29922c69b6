"""URL columns. Regular expressions only: `parse_url` raises on bad input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.lambdas import let
from pageloom.functions.text import URL_IN_TEXT, collapse, name_safe

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_TAIL = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"
# Schemes whose references are resolved against a base.
_RELATIVE = ("ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
             "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss", "")
SEARCH_PREFIX = "https://www.google.com/search?q="
SEARCH_SUFFIX = "&ie=utf-8&oe=utf-8"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_tidy(url), _TAIL + r"//([^/?#]*)", 1)


def _raw_path(url: Column) -> Column:
    return F.regexp_extract(_tidy(url), _TAIL + r"(?://[^/?#]*)?([^?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the `;parameters` of its last segment."""
    return F.regexp_replace(_raw_path(url), r";[^/]*\z", "")


def _broken(url: Column) -> Column:
    n = netloc(url)
    return n.contains("[") != n.contains("]")


def domain_url(url: Column) -> Column:
    """`scheme://netloc`, for any scheme."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def domain_of(url: Column) -> Column:
    """`scheme://netloc` for http and https, NULL for anything else."""
    return F.when(scheme(url).isin("http", "https") & ~_broken(url), domain_url(url))


def canonical_url(url: Column) -> Column:
    """Scheme, host and path; query, fragment and parameters dropped."""
    return F.concat(domain_url(url), path(url))


def host(url: Column) -> Column:
    """Host name without user, port and trailing dots."""
    h = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(h, r":.*$", ""), r"\.+$", "")


def unique_page_name(website: Column, url: Column) -> Column:
    return name_safe(F.concat(website, path(url)))


def first_url_in_text(text: Column) -> Column:
    """First thing that looks like a URL, up to its host; a scheme is added when it has none."""
    hit = F.regexp_extract(text, f"({URL_IN_TEXT})", 1)
    return (
        F.when(hit == "", F.lit(None))
        .when(hit.rlike("^https?://"), hit)
        .when(hit.startswith("www."), F.concat(F.lit("http://"), hit))
        .otherwise(F.concat(F.lit("http://www."), hit))
    )


def search_url(query: Column) -> Column:
    return F.concat(F.lit(SEARCH_PREFIX), F.replace(collapse(query), F.lit(" "), F.lit("+")), F.lit(SEARCH_SUFFIX))


def resolve_url(base: Column, ref: Column) -> Column:
    """`ref` as seen from a page at `base` (RFC 3986). NULL or empty `ref` gives `base`.

    Plain addresses and absolute paths come first: `when` evaluates later branches only for rows reaching them.
    """
    return _resolved(base, _origin(base), lambda: base_parts(base), ref)


def base_parts(base: Column) -> Column:
    """What `resolve_from` needs of a page's URL."""
    return F.struct(
        base.alias("base"), scheme(base).alias("base_scheme"), _origin(base).alias("origin"), _raw_path(base).alias("base_path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1).alias("base_query"))


def resolve_from(parts: Column, ref: Column) -> Column:
    """`resolve_url` where the base is taken apart already: once for all links of a page."""
    return _resolved(parts["base"], parts["origin"], lambda: parts, ref)


_PLAIN_URL = r"^https?://[^?#\x00-\x20]*\z"
_PLAIN_PATH = r"(?s)^(?!//)(?!.*/\.\.?(?:/|\z))/[^?#\x00-\x20]*\z"


def _resolved(base: Column, origin: Column, parts: Callable[[], Column], ref: Column) -> Column:
    ref = F.coalesce(ref, F.lit(""))
    return (
        F.when(ref == "", base)
        .when(ref.rlike(_PLAIN_PATH), F.concat(origin, ref))
        .when(base.isNotNull() & ref.rlike(_PLAIN_URL), ref)
        .otherwise(let(F.struct(
            ref.alias("ref"), _tidy(ref).alias("clean"), scheme(ref).alias("own"), parts().alias("of")), _resolve_parts))
    )


def _prefix(name: Column) -> Column:
    return F.when(name == "", F.lit("")).otherwise(F.concat(name, F.lit(":")))


def _origin(base: Column) -> Column:
    host_part = F.when(netloc(base) == "", F.lit("")).otherwise(F.concat(F.lit("//"), netloc(base)))
    return F.concat(_prefix(scheme(base)), host_part)


def _resolve_parts(p: Column) -> Column:
    of = p["of"]
    foreign = (p["own"] != "") & ((p["own"] != of["base_scheme"]) | ~p["own"].isin(*_RELATIVE))

    def with_rest(r: Column) -> Column:
        same_page = F.concat(
            of["base_path"],
            F.when(r["after"].rlike(r"^\?[^#]"), r["after"]).otherwise(
                F.concat(of["base_query"], F.regexp_replace(r["after"], r"^\?", ""))
            ),
        )
        joined = F.concat(of["origin"], F.when(r["path"] == "", same_page).otherwise(
            F.concat(let(_merge(of["base_path"], r["path"]), _without_dots), r["after"])))
        absolute = F.concat(_prefix(F.when(p["own"] == "", of["base_scheme"]).otherwise(p["own"])), r["rest"])
        whole = F.when(r["rest"].startswith("//"), absolute).otherwise(joined)
        # An empty query or fragment leaves no mark.
        whole = F.regexp_replace(whole, r"^([^?#]*)\?(?=#|\z)", "$1")
        return F.regexp_replace(whole, r"^([^#]*)#\z", "$1")

    rest = F.regexp_replace(p["clean"], _SCHEME, "")
    return F.when(foreign, p["ref"]).otherwise(let(F.struct(
        rest.alias("rest"), F.regexp_extract(rest, r"^[^?#]*", 0).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*(.*)\z", 1).alias("after")), with_rest))


def _merge(base_path: Column, ref_path: Column) -> Column:
    folder = F.regexp_extract(base_path, r"^(.*/)?[^/]*\z", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.regexp_replace(F.concat(folder, ref_path), r"/{2,}", "/"))


def _without_dots(merged: Column) -> Column:
    """Apply `.` and `..` segments; a trailing one leaves a trailing slash."""
    kept = F.aggregate(
        F.split(merged, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    tail = F.when(merged.rlike(r"(^|/)\.\.?\z"), F.lit("")).cast("string")
    resolved = F.when(merged.rlike(r"(^|/)\.\.?(/|\z)"), F.concat_ws("/", kept, tail)).otherwise(merged)
    return let(resolved, lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r)))
