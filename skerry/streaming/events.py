"""Change events: routing, de-duplication, debounced commits, the operation log and replay.

Each function takes a batch or a streaming DataFrame of events(kind, path, origin, summary, at, ...); run_fanout() wires
them to a stream with foreachBatch, so a micro-batch and a batch give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Which consumers see events of tools, and which those of the engine itself.
ROUTES = {"tool": ["index", "log", "version", "search"], "internal": ["version", "search"]}


def route(events: DataFrame, origin: str = "origin") -> DataFrame:
    """A row for each event and consumer, in column `consumer`."""
    consumers = F.when(F.col(origin) == "tool", F.array(*map(F.lit, ROUTES["tool"]))).otherwise(F.array(*map(F.lit, ROUTES["internal"])))
    return events.withColumn("consumer", F.explode(consumers))


def applied(events: DataFrame) -> DataFrame:
    """(path, action, at) that an event means for derived tables: a move is a removal and a sync, a delete a removal, all else a sync."""
    moved = F.array(F.struct(F.col("from_path").alias("path"), F.lit("remove").alias("action")), F.struct("path", F.lit("sync").alias("action")))
    one = F.array(F.struct("path", F.when(F.col("kind") == "delete", "remove").otherwise("sync").alias("action")))
    rows = events.select(F.explode(F.when(F.col("kind") == "move", moved).otherwise(one)).alias("x"), "at")
    return rows.select("x.path", "x.action", "at")


def queue(events: DataFrame, key: str, watermark: str | None = None, at: str = "at") -> DataFrame:
    """Paths to work on, each once; a stream forgets a path after the watermark."""
    if watermark and events.isStreaming:
        return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def commits(events: DataFrame, key: str, at: str = "at", quiet: str = "30 seconds", watermark: str = "5 minutes") -> DataFrame:
    """A commit for each burst of events of a key that a quiet time ends: key, began, last event, number of events."""
    if events.isStreaming:
        events = events.withWatermark(at, watermark)
    rows = events.groupBy(F.session_window(at, quiet).alias("w"), key).agg(F.count("*").alias("n_events"), F.max(at).alias("last_at"))
    return rows.select(key, F.col("w.start").alias("began"), "last_at", "n_events")


def single_line(text: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def log_line(at: Column, origin: Column, kind: Column, summary: Column, files: Column) -> Column:
    """HH:MM:SS | origin | operation | summary | files: a, b"""
    return F.concat_ws(" | ", F.date_format(at, "HH:mm:ss"), origin, kind, single_line(summary), F.concat(F.lit("files: "), F.array_join(files, ", ")))


def write_log(lines: DataFrame, folder: str) -> None:
    """Append lines(day, line) as text, a folder for each day."""
    lines.select("day", "line").write.mode("append").partitionBy("day").text(folder)


def run_fanout(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], errors: list, checkpoint: str) -> StreamingQuery:
    """Start a stream that hands each micro-batch to every consumer; a consumer that fails is noted and doesn't stop the others."""

    def batch(df: DataFrame, epoch: int) -> None:
        routed = route(df).persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(routed.where(F.col("consumer") == name).drop("consumer"))
                except Exception as e:  # noqa: BLE001  a consumer's own failure, reported
                    errors.append((epoch, name, str(e)))
        finally:
            routed.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
