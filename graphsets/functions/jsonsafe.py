"""Values of any nested type in a form that JSON can hold.

The walk follows the declared schema while the plan is built: what needs no change is left
alone, so flat columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsets.functions.text import json_safe, sorted_set, text_keys

ELEMENT, VALUE = "[]", "{}"  # steps of a path below arrays and maps


def _changes(kind: T.DataType, sets: Collection[str], path: str) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return path in sets or _changes(kind.elementType, sets, path + ELEMENT)
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, T.StringType) or _changes(kind.valueType, sets, path + VALUE)
    if isinstance(kind, T.StructType):
        return any(_changes(f.dataType, sets, f"{path}.{f.name}") for f in kind)
    return False


def safe_value(value: Column, kind: T.DataType, sets: Collection[str] = (), path: str = "") -> Column:
    """``value`` with NaN and infinities null, map keys as strings and sets sorted, at every depth.

    ``sets`` are the paths of arrays that stand for sets: ``a.b`` is a field, ``[]`` the elements
    of an array and ``{}`` the values of a map. Nulls stay nulls.
    """
    if not _changes(kind, sets, path):
        return value
    if isinstance(kind, T.ArrayType):
        if _changes(kind.elementType, sets, path + ELEMENT):
            value = F.transform(value, lambda x: safe_value(x, kind.elementType, sets, path + ELEMENT))
        return sorted_set(value) if path in sets else value
    if isinstance(kind, T.MapType):
        if _changes(kind.valueType, sets, path + VALUE):
            value = F.transform_values(value, lambda _, v: safe_value(v, kind.valueType, sets, path + VALUE))
        return value if isinstance(kind.keyType, T.StringType) else text_keys(value)
    if isinstance(kind, T.StructType):
        fields = [safe_value(value.getField(f.name), f.dataType, sets, f"{path}.{f.name}").alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return json_safe(value)


def json_ready(df: DataFrame, sets: Collection[str] = ()) -> DataFrame:
    """All columns of ``df`` as ``safe_value`` makes them; paths begin with the column's name."""
    return df.select(*[safe_value(F.col(f"`{f.name}`"), f.dataType, sets, f.name).alias(f.name) for f in df.schema])
