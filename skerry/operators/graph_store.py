"""The link graph as a log of generations: writers append what they change, readers replay what they have missed or load anew.

    changes/G     (seq, kind, key, value): what generation G has changed; kinds are upsert_node, remove_node, upsert_edge,
                  remove_edge and, alone in its generation, reset
    snapshot/G    nodes and edges as they are after G, written by rebuild() and trim()

A generation is written whole under its number or not at all, as its folder is never overwritten: of two writers of one
number one fails and may try again on the new state. Changes are keyed by a node's path or an edge's id and have the whole
new value, so that replaying one twice changes nothing.

A reader keeps the number of the generation that it has seen. catch_up() replays the newer ones, the last change of each key by one
aggregation; a reset among them, or a generation that trim() has dropped, makes it load the newest snapshot and what follows.
A state reads the log's files whenever it is used; after trim() has dropped them, catch_up() gives one that reads those left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import store
from skerry.operators import graph, sync

NODES, EDGES = "path string, title string, phantom boolean", "edge_id string, `from` string, `to` string, kind string"
CHANGES = "seq long, kind string, key string, value string, generation int"
RETENTION = 10_000


@dataclass
class State:
    """A graph as of a generation."""

    nodes: DataFrame
    edges: DataFrame
    generation: int


class GraphStore:
    """The log in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, part: str) -> list[int]:
        names = store.children(self.spark, f"{self.folder}/{part}")
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n and "_SUCCESS" in store.children(self.spark, f"{self.folder}/{part}/{n}"))

    def generation(self) -> int:
        """The newest generation, 0 before the first."""
        return max([*self._numbers("changes"), *self._numbers("snapshot")], default=0)

    def changes(self, since: int = 0) -> DataFrame:
        """All changes after a generation that the log still has."""
        paths = [f"{self.folder}/changes/generation={n}" for n in self._numbers("changes") if n > since]
        reader = self.spark.read.schema(CHANGES).option("basePath", f"{self.folder}/changes")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)

    # --- writers

    def rebuild(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Replace the whole graph; readers have to load it."""
        n = self.generation() + 1
        self._snapshot(nodes, edges, n)
        self._append(self.spark.createDataFrame([(0, "reset", "", None)], "seq long, kind string, key string, value string"), n)
        return n

    def upsert(self, notes: DataFrame, links: DataFrame) -> int:
        """Notes that are new or changed, with all their links, as graph.upsert() takes them."""
        now = self.load()
        return self._changed(now, *graph.upsert(now.nodes, now.edges, notes, links))

    def remove(self, gone: DataFrame) -> int:
        """Notes that are deleted, as graph.remove() takes them."""
        now = self.load()
        return self._changed(now, *graph.remove(now.nodes, now.edges, gone))

    def trim(self, retention: int = RETENTION) -> None:
        """Drop changes older than the retention, after storing a snapshot that stands for them."""
        newest = self.generation()
        old = [n for n in self._numbers("changes") if n <= newest - retention]
        if not old:
            return
        if max(self._numbers("snapshot"), default=0) < max(old):
            now = self.load()
            self._snapshot(now.nodes, now.edges, newest)
        kept = max(self._numbers("snapshot"))
        for n in old:
            store.remove(self.spark, f"{self.folder}/changes/generation={n}")
        for n in self._numbers("snapshot"):
            if n < kept:
                store.remove(self.spark, f"{self.folder}/snapshot/generation={n}")

    def _snapshot(self, nodes: DataFrame, edges: DataFrame, n: int) -> None:
        both = nodes.select(F.struct("path", "title", "phantom").alias("node"), F.lit(None).cast(f"struct<{_fields(EDGES)}>").alias("edge"))
        rows = both.unionByName(edges.select(F.lit(None).cast(f"struct<{_fields(NODES)}>").alias("node"), F.struct("edge_id", "from", "to", "kind").alias("edge")))
        rows.write.mode("error").parquet(f"{self.folder}/snapshot/generation={n}")

    def _append(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("error").parquet(f"{self.folder}/changes/generation={n}")

    def _changed(self, before: State, nodes: DataFrame, edges: DataFrame) -> int:
        """Append the difference between two states; without one there is no new generation."""
        changes = _difference(before.nodes, nodes, "path", "node").unionByName(_difference(before.edges, edges, "edge_id", "edge"))
        path = store.new_path(self.spark, "changes")
        stored = store.added(changes, path)
        if stored.isEmpty():
            n = before.generation
        else:
            n = before.generation + 1
            self._append(stored.withColumn("seq", F.monotonically_increasing_id()).select("seq", "kind", "key", "value"), n)
        store.remove(self.spark, path)
        return n

    # --- readers

    def load(self) -> State:
        """The graph as it is now: the newest snapshot and the changes after it."""
        snapshots = self._numbers("snapshot")
        base = max(snapshots, default=0)
        if base:
            rows = self.spark.read.schema(f"node struct<{_fields(NODES)}>, edge struct<{_fields(EDGES)}>").parquet(f"{self.folder}/snapshot/generation={base}")
            nodes, edges = rows.where("node IS NOT NULL").select("node.*"), rows.where("edge IS NOT NULL").select("edge.*")
        else:
            nodes, edges = self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)
        state = State(nodes, edges, base)
        return _applied(state, self.changes(base), self.generation())

    def catch_up(self, state: State, retention: int = RETENTION) -> tuple[State, str]:
        """The state brought up to date, and how: none, partial (changes replayed) or full_reload."""
        newest, have = self.generation(), self._numbers("changes")
        if newest <= state.generation:
            return state, "none"
        missing = set(range(state.generation + 1, newest + 1)) - set(have)
        newer = self.changes(state.generation)
        if missing or sync.replay(newer, state.generation, newest, retention) is None:
            return self.load(), "full_reload"
        return _applied(state, newer, newest), "partial"


def _fields(schema: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in schema.split(", "))


def _difference(before: DataFrame, after: DataFrame, key: str, what: str) -> DataFrame:
    """(kind, key, value) of the changes that lead from one set of rows to another."""
    value = F.to_json(F.struct(*after.columns))
    old = before.select(F.col(key).alias("key"), F.to_json(F.struct(*after.columns)).alias("old"))
    new = after.select(F.col(key).alias("key"), value.alias("value"))
    both = old.join(new, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("value")))
    return both.select(F.when(F.col("value").isNull(), f"remove_{what}").otherwise(f"upsert_{what}").alias("kind"), "key", "value")


def _applied(state: State, changes: DataFrame, generation: int) -> State:
    """A state after changes, of which the last of each node and edge counts."""
    target = F.regexp_replace("kind", "^(upsert|remove)_", "")
    last = sync.latest(changes.where("kind <> 'reset'").select(target.alias("what"), "key", "value", F.struct("generation", "seq").alias("at")), ["what", "key"], "at")

    def part(rows: DataFrame, what: str, key: str, schema: str) -> DataFrame:
        own = last.where(F.col("what") == what)
        kept = rows.join(own.select(F.col("key").alias(key)), key, "left_anti").select(*rows.columns)
        return kept.unionByName(own.where("value IS NOT NULL").select(F.from_json("value", schema).alias("v")).select("v.*"))

    return State(part(state.nodes, "node", "path", NODES), part(state.edges, "edge", "edge_id", EDGES), generation)
