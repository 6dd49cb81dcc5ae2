"""String and similarity functions over Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added length up to which a prefix or suffix still relates two names, and the similarity floor.
MAX_ADDED, NAME_FLOOR = 8, 0.7
SNIPPET_CHARS = 120


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty strings are the same."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def normalize_name(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "[^a-zA-Z0-9]", ""))


def names_related(a: Column | str, b: Column | str) -> Column:
    """Equal after normalising, one a short extension of the other, or similar enough; empty names never are."""
    x, y = normalize_name(a), normalize_name(b)
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    extends = (F.length(longer) - F.length(shorter) <= MAX_ADDED) & (longer.startswith(shorter) | longer.endswith(shorter))
    return (F.length(shorter) > 0) & ((x == y) | extends | (similarity(x, y) >= NAME_FLOOR))


def path_shape(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\{[^}]*\}", "{}")


def path_similarity(a: Column | str, b: Column | str) -> Column:
    return similarity(path_shape(a), path_shape(b))


def leaf_of(pointer: Column | str) -> Column:
    """Last dotted segment without array marks; null where nothing is left."""
    return F.nullif(F.replace(F.element_at(F.split(col(pointer), r"\."), -1), F.lit("[]"), F.lit("")), F.lit(""))


def endpoint_label(method: Column | str, path: Column | str) -> Column:
    return F.concat_ws(" ", F.upper(col(method)), col(path))


def snippet(text: Column | str) -> Column:
    """White space squeezed, trimmed, cut at SNIPPET_CHARS."""
    s = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(s) > SNIPPET_CHARS, F.concat(F.substring(s, 1, SNIPPET_CHARS), F.lit("..."))).otherwise(s)


def snake_case(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "([A-Z])", "_$1"))


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def change_id(kind, method, path, location, from_name, to_name, from_type, to_type) -> Column:
    """Ten hex characters of the change's identity; wording and direction have no part in it."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (kind, method, path, location, from_name, to_name, from_type, to_type)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def branch_digest(ids: Column | str) -> Column:
    """Seven hex characters over the sorted ids of an array column."""
    return F.substring(F.sha1(F.array_join(F.array_sort(col(ids)), "|")), 1, 7)
