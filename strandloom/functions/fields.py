"""Fields of a node as a map from code to list, the form that node lines are parsed into.

All functions take and give a column ``map<string, array<string>>``; a null map is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "map<string, array<string>>"


def _map(fields: Column | str) -> Column:
    c = F.col(fields) if isinstance(fields, str) else fields
    return F.coalesce(c, F.create_map().cast(EMPTY))


def has(fields: Column | str, code: str) -> Column:
    return F.map_contains_key(_map(fields), code)


def get(fields: Column | str, code: str) -> Column:
    """The list of a field, null if it is not there."""
    return F.try_element_at(_map(fields), F.lit(code))


def first(fields: Column | str, code: str) -> Column:
    """The first value of a field, null if there is none."""
    return F.get(get(fields, code), F.lit(0))


def clear(fields: Column | str, code: str) -> Column:
    return F.map_filter(_map(fields), lambda k, _: k != code)


def put(fields: Column | str, code: str, values: Column) -> Column:
    """The field replaced by a list; a null or empty list takes it away."""
    return F.when(F.size(values) > 0, F.map_concat(clear(fields, code), F.create_map(F.lit(code), values))).otherwise(clear(fields, code))


def put_one(fields: Column | str, code: str, value: Column) -> Column:
    """The field replaced by one value; null takes it away."""
    return put(fields, code, F.array_compact(F.array(value.cast("string"))))


def append(fields: Column | str, code: str, value: Column) -> Column:
    """A value at the end of a field; null adds nothing."""
    held = F.coalesce(get(fields, code), F.array().cast("array<string>"))
    return put(fields, code, F.concat(held, F.array_compact(F.array(value.cast("string")))))


def append_once(fields: Column | str, code: str, value: Column) -> Column:
    """As ``append``, unless the field has the value."""
    there = F.coalesce(F.array_contains(get(fields, code), value.cast("string")), F.lit(False))
    return F.when(there, _map(fields)).otherwise(append(fields, code, value))


def flag(fields: Column | str, code: str) -> Column:
    """Whether the first value of a field is 1."""
    return F.coalesce(first(fields, code) == "1", F.lit(False))


def set_flag(fields: Column | str, code: str, on: Column) -> Column:
    """The field set to 1, or taken away."""
    return put_one(fields, code, F.when(on, F.lit("1")))


def note(*parts: Column | str) -> Column:
    """Parts joined by ``|``, as bubbles, edges to adjust or remove, tips, gray and black edges are
    written; null if a part is. Coverages should be floats, which are written with their point."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    joined = texts[0]
    for t in texts[1:]:
        joined = F.concat(joined, F.lit("|"), t)
    return joined


def note_parts(text: Column | str, *names: str) -> Column:
    """The struct of a note's parts by name; missing ones are null."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, r"\|")
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))
