"""Type names of API schemas as data: splitting, breaking rules, set comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions.text import col

#: Formats that only narrow or widen a number.
NUMERIC_FORMATS = ("int32", "int64", "float", "double")


def _splits(name: Column) -> Column:
    colon, bracket = F.instr(name, ":"), F.instr(name, "<")
    return (colon > 0) & ~((bracket > 0) & (bracket < colon))


def base_type(name: Column | str) -> Column:
    n = col(name)
    return F.when(_splits(n), F.substring_index(n, ":", 1)).otherwise(n)


def type_format(name: Column | str) -> Column:
    n = col(name)
    return F.when(_splits(n), F.substr(n, F.instr(n, ":") + 1))


def is_type_change_breaking(old: Column | str, new: Column | str) -> Column:
    """Another base breaks; a numeric format may appear or vanish but not change; any other format change breaks."""
    f, g = type_format(old), type_format(new)
    loose = (f.isNull() | f.isin(*NUMERIC_FORMATS)) & (g.isNull() | g.isin(*NUMERIC_FORMATS))
    return (base_type(old) != base_type(new)) | F.when(loose, F.coalesce(f != g, F.lit(False))).otherwise(F.lit(True))


def same_string_set(a: Column | str, b: Column | str) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.coalesce(col(a), empty)) == F.array_sort(F.coalesce(col(b), empty))
