"""Dynamically typed values as a struct of lanes, so that equality, order and text are plain column expressions.

rank: null = the property is missing, 0 null, 1 boolean, 2 number, 3 string, 4 array, 5 object. A whole number is in i,
any other in d, which keeps 12 apart from 12.0. arr has the text of all elements of an array, strings those that are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

LANES = "struct<rank:int,b:boolean,i:bigint,d:double,s:string,arr:array<string>,strings:array<string>,json:string>"


def lanes(**given: Column) -> Column:
    kinds = {"rank": "int", "b": "boolean", "i": "bigint", "d": "double", "s": "string", "arr": "array<string>", "strings": "array<string>", "json": "string"}
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def missing() -> Column:
    return lanes()


def of_column(value: Column, kind: T.DataType) -> Column:
    """A typed column as lanes; SQL null is the value null."""
    null = F.when(value.isNull(), F.lit(0))
    if isinstance(kind, T.BooleanType):
        return lanes(rank=null.otherwise(1), b=value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return lanes(rank=null.otherwise(2), i=value)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return lanes(rank=null.otherwise(2), d=value)
    if isinstance(kind, T.ArrayType):
        texts = value.cast("array<string>")
        return lanes(rank=null.otherwise(4), arr=texts, strings=texts if isinstance(kind.elementType, T.StringType) else F.lit(None), json=F.to_json(value))
    if isinstance(kind, (T.StructType, T.MapType)):
        return lanes(rank=null.otherwise(5), json=F.to_json(value))
    return lanes(rank=null.otherwise(3), s=value.cast("string"))


def of_json(document: Column, key: str) -> Column:
    """A top-level key of a JSON object column as lanes; the key is taken literally, dots and all."""
    value = F.try_variant_get(F.try_parse_json(document), "$['" + key.replace("'", "\\'") + "']", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    rank = (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(kind == "VOID", 0)
        .when(kind == "BOOLEAN", 1)
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), 2)
        .when(kind == "STRING", 3)
        .when(kind.startswith("ARRAY"), 4)
        .otherwise(5)
    )
    whole = kind == "BIGINT"
    return lanes(
        rank=rank,
        b=F.when(rank == 1, F.try_variant_get(value, "$", "boolean")),
        i=F.when(whole, F.try_variant_get(value, "$", "bigint")),
        d=F.when((rank == 2) & ~whole, F.try_variant_get(value, "$", "double")),
        s=F.when(rank == 3, text),
        arr=F.when(rank == 4, F.try_variant_get(value, "$", "array<string>")),
        strings=F.when(rank == 4, F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))),
        json=F.when(rank >= 4, F.to_json(value)),
    )


def equals(value: Column, literal: object) -> Column:
    """Two-valued typed equality: missing equals null, 12 doesn't equal 12.0 or "12"."""
    if literal is None:
        return F.coalesce(value["rank"], F.lit(0)) == 0
    if isinstance(literal, bool):
        return value["b"].eqNullSafe(F.lit(literal))
    if isinstance(literal, int):
        return value["i"].eqNullSafe(F.lit(literal).cast("bigint"))
    if isinstance(literal, float):
        return value["d"].eqNullSafe(F.lit(literal))
    return value["s"].eqNullSafe(F.lit(literal))


def contains(value: Column, text: str) -> Column:
    """Substring of a string, an element of an array that is this string, else false."""
    inside = F.when(value["rank"] == 3, F.contains(value["s"], F.lit(text))).when(value["rank"] == 4, F.array_contains(value["strings"], text))
    return F.coalesce(inside, F.lit(False))


def order_keys(value: Column, descending: bool = False) -> list[Column]:
    """missing < null < booleans < numbers < strings < arrays < objects; descending is the exact reverse."""
    keys = [value["rank"], value["b"], F.coalesce(value["i"].cast("double"), value["d"]), value["s"]]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def scalar_text(value: Column) -> Column:
    """Null and missing are empty, arrays are joined with a comma, objects are JSON."""
    return (
        F.when(F.coalesce(value["rank"], F.lit(0)) == 0, "")
        .when(value["rank"] == 1, value["b"].cast("string"))
        .when(value["rank"] == 2, F.coalesce(value["i"].cast("string"), value["d"].cast("string")))
        .when(value["rank"] == 3, value["s"])
        .when(value["rank"] == 4, F.array_join(value["arr"], ", ", ""))
        .otherwise(value["json"])
    )
