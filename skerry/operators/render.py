"""Text forms of query results. Cells are rendered by column expressions; only the finished lines are gathered."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str) -> Column:
    """A value as text: null is empty, arrays are joined with a comma, structs are JSON, links show their display text."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StructType) and kind.fieldNames() == ["type", "target", "display"]:
        return F.concat(F.lit("[["), value["target"], F.lit("|"), value["display"], F.lit("]]"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(value.cast("array<string>"), ", ", ""), F.lit(""))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """A column `line` of each row as CSV: a field is quoted only if it holds a quote, a comma or a newline."""

    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return df.select(F.concat_ws(",", *(quoted(cell(df, c)) for c in df.columns)).alias("line"))


def table_lines(df: DataFrame) -> DataFrame:
    """A column `line` of each row as a row of a Markdown table."""

    def escaped(c: Column) -> Column:
        for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(escaped(cell(df, c)) for c in df.columns)), F.lit(" |")).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """A column `line` of each row as a JSON object."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def to_text(df: DataFrame, form: str = "table") -> str:
    """The whole result as one text for a user; results of a view are as small as its limit."""
    if form == "csv":
        return "\n".join([",".join(df.columns), *(r.line for r in csv_lines(df).collect())]) + "\n"
    if form == "json":
        return json.dumps([json.loads(r.line) for r in json_lines(df).collect()], indent=2, ensure_ascii=False)
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*head, *(r.line for r in table_lines(df).collect())]) + "\n"
