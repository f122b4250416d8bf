"""Nested filters: a mapping from field to value or values becomes one predicate.

A path into an array of structs asks whether some element fits; `task` fields match on any shared token; a list of
values matches any of them; arrays match if they hold any. All clauses must hold.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens

#: Fields that are matched as text and not as a whole.
TEXT_FIELDS = ("task", "description_plain")


def _leaf(value: Column, kind: T.DataType, name: str, wanted: list) -> Column:
    if name in TEXT_FIELDS:
        return F.arrays_overlap(tokens(value), F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*[tokens(F.lit(w)) for w in wanted]))))
    if isinstance(kind, T.ArrayType):
        return F.arrays_overlap(value, F.array(*map(F.lit, wanted)))
    return value.isin(*wanted)


def _walk(value: Column, kind: T.DataType, path: list[str], wanted: list, name: str) -> Column:
    if not path:
        return _leaf(value, kind, name, wanted)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.exists(value, lambda e: _walk(e, kind.elementType, path, wanted, name))
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise ValueError(f"no field {path[0]!r}")
    return _walk(value[path[0]], kind[path[0]].dataType, path[1:], wanted, path[0])


def compile(df: DataFrame, wanted: dict) -> Column:
    """The predicate for a table; null counts as false."""
    clauses = []
    for field, value in wanted.items():
        name, *path = field.split(".")
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        clauses.append(F.coalesce(_walk(F.col(name), df.schema[name].dataType, path, values, name), F.lit(False)))
    return reduce(and_, clauses, F.lit(True))
