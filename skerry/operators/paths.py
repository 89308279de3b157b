"""Given paths resolved to the root that holds them, by the longest prefix of whole segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"^[A-Za-z][A-Za-z0-9+.-]*$"


def normal(path: Column) -> Column:
    """Without empty and . segments, and without a slash at the end."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(segments, "/"))


def _fault(raw: Column) -> Column:
    """The code of a path that no root can hold as it is written; null for others."""
    windows = raw.rlike(r"^\\\\") | raw.contains(":")
    return (
        F.when(raw.isNull() | (raw == "") | raw.contains("\0"), "path/invalid")
        .when(F.exists(F.split(raw, r"[/\\]"), lambda s: s == ".."), "path/outside-root")
        .when(windows, "path/invalid-windows-path")
    )


def resolve(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """rows with root (its name), relative (the path below it) and code, of which either the first two or the last are set.

    roots(name, path) are absolute. A path is absolute, name://path, or relative where there is but one root. The roots are
    looked up by every prefix of a path, an equality join that Spark may broadcast, and the longest that is found counts."""
    raw = F.col(column)
    given = rows.select(raw.alias("_raw")).distinct()
    name = F.split_part("_raw", F.lit("://"), F.lit(1))
    named = F.col("_raw").contains("://") & name.rlike(NAME)
    rest = F.when(named, F.substr("_raw", F.length(name) + 4)).otherwise(F.col("_raw"))
    known = roots.select(F.col("name").alias("_name"), normal(F.col("path")).alias("_root"))
    only = known.agg(F.count("*").alias("_n"), F.min("_name").alias("_only"), F.min("_root").alias("_only_root"))  # one row
    asked = given.select("_raw", F.when(named, name).alias("_asked"), rest.alias("_rest")).crossJoin(F.broadcast(only))
    asked = asked.join(known.select(F.col("_name").alias("_asked"), F.col("_root").alias("_asked_root")), "_asked", "left")
    fault = _fault(F.col("_rest"))
    relative = ~F.col("_rest").startswith("/")
    early = (
        F.when(F.col("_asked").isNotNull() & F.col("_asked_root").isNull(), "path/unknown-vault-name")
        .when(F.col("_asked").isNotNull() & (F.col("_rest") == ""), "path/empty-named-prefix")
        .when(fault.isNotNull(), fault)
        .when(F.col("_n") == 0, "path/invalid-root")
        .when(relative & F.col("_asked").isNull() & (F.col("_n") > 1), "path/ambiguous-root")
    )
    base = F.coalesce("_asked_root", F.when(F.col("_n") == 1, F.col("_only_root")))
    whole = normal(F.when(relative, F.concat(base, F.lit("/"), F.col("_rest"))).otherwise(F.col("_rest")))
    told = asked.select("_raw", "_asked", early.alias("_early"), F.when(early.isNull(), whole).alias("_whole"))
    steps = F.split("_whole", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(steps, F.lit(1), n), "/")))
    above = told.where("_whole IS NOT NULL").select("_raw", "_asked", F.explode(F.array_distinct(prefixes)).alias("_root"))
    held = above.join(known, "_root").where("_asked IS NULL OR _asked = _name")
    longest = held.groupBy("_raw").agg(F.max_by(F.struct("_name", "_root"), F.struct(F.length("_root"), F.col("_name"))).alias("_best"))
    out = told.join(longest, "_raw", "left")
    below = F.regexp_replace(F.substr("_whole", F.length("_best._root") + 1), "^/", "")
    code = F.coalesce("_early", F.when(F.col("_best").isNull(), "path/outside-root"))
    found = out.select("_raw", F.col("_best._name").alias("root"), below.alias("relative"), code.alias("code"))
    return rows.join(found, raw.eqNullSafe(F.col("_raw")), "left").drop("_raw")
