"""URL texts against path templates: portions, segments, matching, rewriting and the public-host guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions.text import col

#: Stands for an interpolated expression; it cannot occur in source text.
HOLE = "\u0000"
#: Hosts that are the machine itself or a private network.
PRIVATE_HOSTS = (
    r"(?i)^localhost$", r"(?i)\.localhost$", r"(?i)\.local$", r"(?i)\.internal$", r"^\[?::1\]?$", r"^0\.0\.0\.0$", r"^127\.", r"^10\.",
    r"^192\.168\.", r"^172\.(1[6-9]|2\d|3[01])\.", r"^169\.254\.", r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.", r"(?i)^\[?f[cd][0-9a-f]{2}:", r"(?i)^\[?fe80:",
)


def path_portion(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*", 0)


def strip_origin(path: Column | str) -> Column:
    """Without scheme and host, then without leading interpolations (a base URL held in a variable)."""
    return F.regexp_replace(F.regexp_replace(col(path), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), f"^{HOLE}+", "")


def segments(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def is_template(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def literal_prefix(template: Column | str) -> Column:
    """`/` and the literal segments before the first parameter."""
    parts = segments(template)
    # One past the last literal: the place of the first parameter.
    at = F.array_position(F.transform(parts, is_template), True)
    return F.concat(F.lit("/"), F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts), "/"))


def matches_template(url: Column | str, template: Column | str, base_url: str | None = None) -> Column:
    """Whether the URL's path ends in the template: literals equal, parameters any one segment, prefix in the text."""
    path = path_portion(url)
    if base_url:
        path = F.when(path.startswith(base_url), F.substr(path, F.lit(len(base_url) + 1))).otherwise(path)
    path = strip_origin(path)
    have, want = segments(path), segments(template)
    n = F.size(want)
    tail = F.slice(have, F.greatest(F.size(have) - n + 1, F.lit(1)), n)
    fits = F.forall(F.zip_with(tail, want, lambda h, w: is_template(w) | (h == w)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (n > 0) & (F.size(have) >= n) & fits & F.contains(path, literal_prefix(template))


def rewrite_path(text: Column | str, old: Column | str, new: Column | str) -> Column:
    """`text` with the first occurrence of the old literal prefix replaced; null where only the tails or nothing differs."""
    text, a, b = col(text), literal_prefix(old), literal_prefix(new)
    rest = lambda t, p: F.substr(col(t), F.length(p) + 1)
    at = F.call_function("instr", text, a)
    spliced = F.concat(F.substr(text, F.lit(1), at - 1), b, F.substr(text, at + F.length(a)))
    return F.when((rest(old, a) == rest(new, b)) & (a != b) & (at > 0), spliced)


def host_name(url: Column | str) -> Column:
    return F.call_function("try_parse_url", col(url), F.lit("HOST"))


def public_url_problem(url: Column | str) -> Column:
    """Null for a public http or https URL, else why it is refused: `not absolute`, `protocol` or `private host`."""
    u = col(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    private = F.lit(False)
    for p in PRIVATE_HOSTS:
        private = private | host.rlike(p)
    return F.when(scheme == "", "not absolute").when(~scheme.isin("http", "https"), "protocol").when(host == "", "not absolute").when(private, "private host")


def host_of(url: Column | str) -> Column:
    """Lower-case host with a port that is not the scheme's default; the text itself where it is no URL; '' for null."""
    u = col(url)
    found = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#{}]+)(?:[/?#]|$)", 1)
    host = F.regexp_replace(found, ":$", "")
    plain = F.when(u.rlike("(?i)^http://"), F.regexp_replace(host, ":80$", "")).when(u.rlike("(?i)^https://"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.lower(F.when(u.isNull(), F.lit("")).when(found == "", u).otherwise(plain))
