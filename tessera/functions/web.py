"""Columns over HTTP facts: content types, headers, key sets, URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_type(header: Column) -> Column:
    """The media type without parameters, in lower case."""
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def content_type_allowed(header: Column, allowed: list[str]) -> Column:
    return F.coalesce(content_type(header).isin(*allowed), F.lit(False))


def selected_headers(headers: Column, allowed: list[str]) -> Column:
    """Allowed headers of an array of (name, value), by lower-cased name; values of one name are joined by ', ' in order."""
    own = F.filter(headers, lambda h: F.lower(h["name"]).isin(*allowed))
    names = F.array_sort(F.array_distinct(F.transform(own, lambda h: F.lower(h["name"]))))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_join(F.transform(F.filter(own, lambda h: F.lower(h["name"]) == n), lambda h: h["value"]), ", "))))


def exact_keys(document: Column, keys: list[str]) -> Column:
    """Whether a JSON object (text) has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(document)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def quoted(part: Column) -> Column:
    """Percent-encoded but for letters, digits and -._~; a space as %20."""
    out = F.url_encode(part)
    for given, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(given), F.lit(wanted))
    return out


def valid_web_url(url: Column, secure: bool = False) -> Column:
    """Absolute http(s) URL, or https only, without credentials."""
    protocol = F.try_parse_url(url, F.lit("PROTOCOL"))
    return F.coalesce(protocol.isin("https") if secure else protocol.isin("http", "https"), F.lit(False)) & F.try_parse_url(url, F.lit("HOST")).isNotNull() & F.try_parse_url(url, F.lit("USERINFO")).isNull()


def response_violations(observed: Column, expected: Column) -> Column:
    """Which of status, content_type, cache_control and sha256 of two structs differ; a null expectation holds for all."""
    return F.array_compact(F.array(*[F.when(expected[c].isNotNull() & ~observed[c].eqNullSafe(expected[c]), F.lit(c)) for c in ("status", "content_type", "cache_control", "sha256")]))


def log_line(fields: dict[str, Column]) -> Column:
    """A request as one compact JSON object with sorted keys; nulls stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def contained(path: Column) -> Column:
    """Whether a path is relative and stays below its root: no drive, no leading slash, no backslash, no empty, dot or dot-dot part."""
    parts = F.split(path, "/", -1)
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00]|^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))
