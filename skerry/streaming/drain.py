"""A queue of paths to work on, drained within a budget, as a stateful operator of a stream.

Every lane (a key that deals out the work) has its own queue in state: paths in the order in which they came, each once
while it waits. Whenever rows or a timer wake a lane it works on the paths at the head until the budget of its clock is
spent, on one at least; what is left stays in state, through restarts, and a timer wakes the lane again. A path that fails
is reported and doesn't stop the others. Work is done at least once: a batch that Spark repeats does its work again.

The state is touched a path at a time: numbered places from head to tail, and the place of every waiting path.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["lane", "place", "path", "outcome", "detail", "waiting"]


class Drain(StatefulProcessor):
    """work(path) gives a text for the outcome or raises; clock() gives numbers in the unit of the budget."""

    def __init__(self, work: Callable[[str], str], budget: float, clock: Callable[[], float], pause_ms: int) -> None:
        self.work, self.budget, self.clock, self.pause_ms = work, budget, clock, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "head long, tail long")
        self.places = handle.getMapState("places", "place long", "path string")
        self.waiting = handle.getMapState("waiting", "path string", "place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, int] = {}
        for batch in rows:
            for path, seq in zip(batch["path"].tolist(), batch["seq"].tolist(), strict=True):
                if path is not None and seq < new.get(path, seq + 1):
                    new[path] = seq
        head, tail = self._ends()
        for path in sorted(new, key=lambda p: (new[p], p)):
            if not self.waiting.containsKey((path,)):
                self.places.updateValue((tail,), (path,))
                self.waiting.updateValue((path,), (tail,))
                tail += 1
        yield self._drained(key, head, tail, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._drained(key, *self._ends(), timerValues)

    def _ends(self) -> tuple[int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0)

    def _drained(self, key, head: int, tail: int, timers) -> pd.DataFrame:
        out, deadline = [], self.clock() + self.budget
        while head < tail:
            (path,) = self.places.getValue((head,))
            try:
                outcome, detail = "done", self.work(path)
            except Exception as e:  # noqa: BLE001  one path's own failure, reported
                outcome, detail = "failed", str(e)
            self.places.removeKey((head,))
            self.waiting.removeKey((path,))
            head += 1
            out.append((key[0], head - 1, path, outcome, detail))
            if self.clock() >= deadline:
                break
        self.ends.update((head, tail))
        if head < tail:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.pause_ms)
        return pd.DataFrame([(*x, tail - head) for x in out], columns=COLUMNS)

    def close(self) -> None:
        pass


def drain(events: DataFrame, lane: str, path: str, order: str, work: Callable[[str], str], budget: float, clock: Callable[[], float] = time.monotonic, pause_ms: int = 1000) -> DataFrame:
    """(lane, place, path, outcome, detail, waiting) of every path that is worked on; waiting is what its lane has left after the batch.

    A stream of events becomes a stream; start it inside rocks(), with run_once() or a trigger of its own."""
    rows = events.select(F.col(lane).alias("lane"), F.col(path).cast("string").alias("path"), F.col(order).cast("long").alias("seq"))
    kind = events.schema[lane].dataType.simpleString()
    return rows.groupBy("lane").transformWithStateInPandas(Drain(work, budget, clock, pause_ms), f"lane {kind}, place long, path string, outcome string, detail string, waiting long", "append", "processingTime")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that such operators need, for queries that are started inside."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def run_available(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream gives for all that has come so far to a folder; a later run goes on from the checkpoint."""
    return _run(df, folder, checkpoint, {"availableNow": True})


def run_once(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The same in one batch; for drain(), whose timers would always have another one."""
    return _run(df, folder, checkpoint, {"once": True})


def _run(df: DataFrame, folder: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    query = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    query.awaitTermination()
    return query
