"""Keeping derived tables fresh: which documents are new, changed or gone, what to embed again, and replay of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.operators import files


def freshness(stored: DataFrame, files: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    """(key, state): new, changed, unchanged or removed, by comparing stamps."""
    both = stored.select(key, F.col(stamp).alias("_old"), F.lit(True).alias("_stored")).join(files.select(key, F.col(stamp).alias("_new"), F.lit(True).alias("_there")), key, "full_outer")
    state = F.when(F.col("_stored").isNull(), "new").when(F.col("_there").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def freshness_report(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count_if(F.col("state") != "removed").alias("scanned"), F.count_if(F.col("state").isin("new", "changed")).alias("reindexed"), F.count_if(F.col("state") == "removed").alias("removed")
    )


def stale(states: DataFrame) -> DataFrame:
    """One row: how many entries a refresh would touch."""
    return states.agg(F.count_if(F.col("state") != "unchanged").alias("stale"))


def to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose (path, ordinal) has no stored vector of the same content hash."""
    old = stored.select("path", "ordinal", F.col("content_hash").alias("_old"))
    return chunks.join(old, ["path", "ordinal"], "left").where(~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old")


def to_prune(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored vectors whose (path, ordinal) no longer exists."""
    return stored.join(chunks, ["path", "ordinal"], "left_anti")


def replay(log: DataFrame, since: int, current: int, retention: int = 10_000) -> DataFrame | None:
    """The last change of each (kind, key) after a generation; None if only a full reload will do: too old, or a reset since."""
    newer = log.where(F.col("generation") > since)
    if since < current - retention or not newer.where(F.col("kind") == "reset").isEmpty():
        return None
    return latest(newer, ["kind", "key"], "seq")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest order for each key, by one aggregation with map-side combining rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def removed_since(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of a snapshot that a later one lacks."""
    return before.join(after, key, "left_anti")


#: Fixed value: what a restore never touches.
PROTECTED = [".git", ".skerry"]


def as_of(versions: DataFrame, at: Column | None = None) -> DataFrame:
    """(path, content) as it was: of versions(path, at, seq, content), where a null content is a deletion, each path's last at or before a time."""
    rows = versions if at is None else versions.where(F.col("at") <= at)
    last = rows.groupBy("path").agg(F.max_by(F.struct("content"), F.struct("at", "seq")).alias("v"))
    return last.select("path", "v.content").where("content IS NOT NULL")


def restore_plan(versions: DataFrame, at: Column, scope: str | None = None, protected: list[str] | None = None) -> DataFrame:
    """(path, action, content) that bring the paths of a scope back to a time: write those that differ, delete those that weren't there yet."""
    def within(path: Column) -> Column:
        out = F.lit(True) if scope is None else (path == scope) | path.startswith(scope.rstrip("/") + "/")
        for p in PROTECTED if protected is None else protected:
            out = out & ~((path == p) | path.startswith(p + "/"))
        return out

    own = versions.where(within(F.col("path")))
    both = as_of(own).withColumnRenamed("content", "_now").join(as_of(own, at), "path", "full_outer").where(~F.col("_now").eqNullSafe(F.col("content")))
    return both.select("path", F.when(F.col("content").isNull(), "delete").otherwise("write").alias("action"), "content", F.col("_now").alias("current"))


def restore(versions: DataFrame, at: Column, stamp: Column, scope: str | None = None, protected: list[str] | None = None, destructive: bool = False) -> DataFrame:
    """The versions after a restore, its own ones stamped and behind all others; deletions only where they are allowed."""
    plan = restore_plan(versions, at, scope, protected)
    if not destructive and not plan.where("action = 'delete'").isEmpty():
        raise EngineError("git/restore", "the restore deletes files, which is not allowed")
    last = versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))  # one row
    return versions.unionByName(plan.crossJoin(F.broadcast(last)).select("path", stamp.alias("at"), (F.col("_last") + 1).alias("seq"), "content"))


def restore_diff(versions: DataFrame, at: Column, scope: str | None = None, protected: list[str] | None = None) -> DataFrame:
    """A dry run: (path, status, patch, truncated) of what a restore would change."""
    plan = restore_plan(versions, at, scope, protected)
    return files.diff(plan.where("current IS NOT NULL").select("path", F.col("current").alias("text")), plan.where("content IS NOT NULL").select("path", F.col("content").alias("text")))


def commit_log(log: DataFrame, prefix: str | None, limit: int = 20) -> DataFrame:
    """Newest commits first; with a prefix only those that touch files under it. files_changed is sorted, without repetition."""
    rows = log.withColumn("files_changed", F.array_sort(F.array_distinct("files_changed")))
    if prefix:
        rows = rows.where(F.exists("files_changed", lambda f: (f == prefix) | f.startswith(prefix.rstrip("/") + "/")))
    return rows.orderBy(F.desc("time"), "id").limit(max(limit, 1))


def ordinals(rows: DataFrame, parent: str, order: str, name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1)
