"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a lookup table is broadcast; beyond it the lookup is a shuffle join.
BROADCAST_ROWS = 20_000
#: The same for rows of two numbers, which take 16 bytes each.
BROADCAST_KEYS = 200_000
#: Scratch tables by scope.
_scratch: dict[str, list[str]] = {}
_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")
#: Temporary folders of sessions in local mode, by application.
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="skerry-shared-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_id() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered under the present scope."""
    path = f"{shared_dir(spark)}/skerry-{name}-{new_id()}"
    _scratch.setdefault(_scope.get(), []).append(path)
    return path


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables made inside belong to this scope, which release() can delete; those of other scopes, which other lazy results may read, stay."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope; only once all results built on them are stored."""
    for gone in _scratch.pop(name, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to a value that is computed once per row, inside one native expression."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """An id of a row that tells different texts under one doc_id apart; repeated rows share it."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col(text)).alias("t"))


def small_lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually tiny: broadcast while it has at most `bound` rows, else a shuffle join that AQE can split."""
    if small.limit(bound + 1).count() <= bound:
        small = F.broadcast(small)
    return big.join(small, on, how)
