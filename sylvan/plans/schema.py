"""Spark types of results."""

from __future__ import annotations

from pyspark.sql import types as T

from sylvan.lang.analysis import Query

NODE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("span", T.ArrayType(T.IntegerType()))])


class Recursive(ValueError):
    """A result type that contains itself; Spark has no such struct, so those results are kept as variants."""


def spark_type(t: tuple, query: Query, inside: frozenset = frozenset()) -> T.DataType:
    if t[0] == "node":
        return NODE
    if t[0] == "text":
        return T.StringType()
    if t[0] == "bool":
        return T.BooleanType()
    if t[0] == "option":
        return spark_type(t[1], query, inside)
    if t[0] == "list":
        return T.ArrayType(spark_type(t[1], query, inside))
    if t[0] == "ref":
        if t[1] in inside:
            raise Recursive(t[1])
        own = query.types[t[1]]
        return spark_type(own, query, inside | {t[1]}) if own else T.NullType()
    if t[0] == "record":
        return T.StructType([T.StructField(k, spark_type(v, query, inside)) for k, v in t[1].items()])
    # a variant: the tag, and all payload fields side by side
    data: dict[str, T.DataType] = {}
    for case in t[1].values():
        for k, v in (case[1] if case else {}).items():
            s = spark_type(v, query, inside)
            data[k] = s if data.get(k, s) == s else T.VariantType()
    fields = [T.StructField("$tag", T.StringType())]
    return T.StructType(fields + ([T.StructField("$data", T.StructType([T.StructField(k, s) for k, s in data.items()]))] if data else []))


def result_type(query: Query, entry: str | None = None) -> T.DataType | None:
    """The type of an entry's result; None if it is match only, VariantType if it contains itself."""
    name = query.entry(entry).name
    t = query.types[name]
    if t is None:
        return None
    try:
        return spark_type(("ref", name), query)
    except Recursive:
        return T.VariantType()
