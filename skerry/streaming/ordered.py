"""Rows applied in order by partition, stopping at the first failure of a partition and resuming from a stored position.

A flush reads the positions that earlier flushes have stored, takes the rows after them, sorts each partition's and hands them
one by one to a sink. A partition whose sink fails keeps its position and its rows wait for the next flush; the others go on.
Tasks stream through their sorted rows, so no partition is held in memory. Positions are stored once a flush is over: if a
task or the driver fails before, its rows are applied again, so that a sink should bear a row twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import store

RESULT = "partition string, position long, applied long, waiting long, error string"


class RetryBuffer:
    """Positions in a shared folder, a version for each flush."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        names = store.children(self.spark, self.folder)
        return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in store.children(self.spark, f"{self.folder}/{n}"))

    def positions(self) -> DataFrame:
        """(partition, position): the last row that each partition's sink has taken."""
        versions = self._versions()
        rows = self.spark.read.schema(RESULT).parquet(f"{self.folder}/{versions[-1]:08d}") if versions else self.spark.createDataFrame([], RESULT)
        return rows.where("position IS NOT NULL").select("partition", "position")

    def flush(self, rows: DataFrame, partition: str, order: str, sink: Callable[[dict], None]) -> DataFrame:
        """Apply the rows after the stored positions; a row a partition: its position, rows applied and waiting, and the error at which it stopped.

        Rows without an order or a partition are never applied; those of one order in a partition count as one, any of them first."""
        known = self.positions().select(F.col("partition").alias("_partition"), F.col("position").alias("_position"))
        own = rows.where(F.col(order).isNotNull() & F.col(partition).isNotNull()).withColumns({"_key": F.col(partition).cast("string"), "_order": F.col(order).cast("long")})
        after = own.join(known, F.col("_key") == F.col("_partition"), "left").where(F.col("_position").isNull() | (F.col("_order") > F.col("_position"))).drop("_partition")
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, position, applied, waiting, error = None, None, 0, 0, None

            def result() -> pa.RecordBatch:
                values = (now, position, applied, waiting, error)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

            for batch in batches:
                for row in batch.to_pylist():
                    if row["_key"] != now:
                        if now is not None:
                            yield result()
                        now, position, applied, waiting, error = row["_key"], row["_position"], 0, 0, None
                    if error is None:
                        try:
                            sink({c: row[c] for c in names})
                            position, applied = row["_order"], applied + 1
                            continue
                        except Exception as e:  # noqa: BLE001  the sink's failure, reported
                            error = str(e)
                    waiting += 1
            if now is not None:
                yield result()

        done = after.repartition("_key").sortWithinPartitions("_key", "_order").mapInArrow(run, RESULT)
        path = store.new_path(self.spark, "flushed")
        stored = store.added(done, path)
        old = self.positions().join(stored.select("partition"), "partition", "left_anti").select("partition", "position", F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("waiting"), F.lit(None).cast("string").alias("error"))
        version = f"{self.folder}/{max(self._versions(), default=0) + 1:08d}"
        stored.unionByName(old).write.mode("error").parquet(version)
        store.remove(self.spark, path)
        return self.spark.read.schema(RESULT).parquet(version)
