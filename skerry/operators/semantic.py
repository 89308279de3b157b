"""Queries by meaning over stored vectors of chunks: embed the text asked for, find the nearest vectors, read their chunks again.

An embedder is a function from a text column to a column of vectors, so a model of one's own is a pandas UDF under a name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.operators import vectors

Embedder = Callable[[Column], Column]
EMBEDDERS: dict[str, Embedder] = {"hash": vectors.hash_embedding}
#: A function that makes, in a task, a model: from a list of texts to their vectors.
Model = Callable[[list[str]], np.ndarray]
MODELS: dict[str, Callable[[], Model]] = {}


def register(name: str, embedder: Embedder) -> None:
    EMBEDDERS[name] = embedder


def register_model(name: str, make: Callable[[], Model]) -> None:
    """A model of one's own, which is made once a task and asked for whole batches of texts."""
    MODELS[name] = make


def _hash_model(dimensions: int = 16) -> Model:
    """The vectors of vectors.hash_embedding()."""

    def vector(text: str) -> list[float]:
        digests = [hashlib.sha256(text.encode() + i.to_bytes(8, "little")).digest() for i in range(dimensions)]
        return [int.from_bytes(d[:2], "little") / 65535.0 * 2 - 1 for d in digests]

    return lambda texts: np.array([vector(t) for t in texts], np.float32)


register_model("hash", _hash_model)


def embed_batches(chunks: DataFrame, name: str, batch: int = 64) -> DataFrame:
    """chunks with a vector column, made by a registered model in Arrow batches; the vectors of a batch that fails are null, its error is told."""
    if name not in MODELS:
        raise EngineError("embedding/local-unavailable", f"no model {name}")
    make, at = MODELS[name], chunks.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts, error = [t or "" for t in part.column(at).to_pylist()], None
                try:
                    made = model(texts)
                    if len(made) != len(texts):
                        raise EngineError("embedding/shape-mismatch", f"{len(made)} vectors for {len(texts)} chunks")
                    found = [np.asarray(v, np.float32) for v in made]
                except Exception as e:  # noqa: BLE001  one batch's own failure, reported
                    found, error = [None] * len(texts), str(e)
                columns = [*part.columns, pa.array(found, pa.list_(pa.float32())), pa.array([error] * len(texts), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "vector", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{kinds}, vector array<float>, error string")


def embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise EngineError("embedding/local-unavailable", f"no embedder {name}")
    return EMBEDDERS[name]


def embed(chunks: DataFrame, name: str = "hash") -> DataFrame:
    """chunks(path, ordinal, text, content_hash) with their vectors; the stored form has no texts."""
    return chunks.select("path", "ordinal", "heading_context", "content_hash", embedder(name)(F.col("text")).alias("vector"))


def query(stored: DataFrame, chunks: DataFrame, text: str, k: int = 10, name: str = "hash", where: Column | None = None) -> DataFrame:
    """(path, text, score, heading_context) of at most k hits; hits whose chunk has vanished since are left out."""
    if k < 1:
        return stored.limit(0).join(chunks, ["path", "ordinal"]).select("path", "text", F.lit(0.0).alias("score"), stored["heading_context"])
    asked = stored.sparkSession.range(1).select(embedder(name)(F.lit(text)).alias("v")).first()["v"]  # one vector
    hits = vectors.nearest(stored, "path", "vector", [float(x) for x in asked], k, where).select("path", "ordinal", "score", "heading_context")
    return hits.join(chunks.select("path", "ordinal", "text"), ["path", "ordinal"]).select("path", "text", "score", "heading_context").orderBy(F.desc("score"), "path")


def refresh(stored: DataFrame, chunks: DataFrame, name: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(vectors as they should be, report): equal chunks keep their vectors, others are embedded, vanished ones go.

    A chunk whose vector is null has failed and remains to be done."""
    now = chunks.select("path", "ordinal", "heading_context", "text", "content_hash")
    both = now.join(stored.select("path", "ordinal", "content_hash", F.col("vector").alias("_old")), ["path", "ordinal", "content_hash"], "left")
    done = both.withColumn("_skipped", F.col("_old").isNotNull()).withColumn("vector", F.coalesce("_old", embedder(name)(F.col("text"))))
    report = done.agg(
        F.count_distinct("path").alias("paths_scanned"), F.count_if(~F.col("_skipped") & F.col("vector").isNotNull()).alias("embedded"), F.count_if("_skipped").alias("skipped"), F.count_if(F.col("vector").isNull()).alias("failed")
    )
    return done.select("path", "ordinal", "heading_context", "content_hash", "vector"), report


def rebuild(stored: DataFrame, chunks: DataFrame, budget: int | None = None, name: str = "hash", priority: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One budgeted step of a rebuild: (vectors as they are after it, report). Repeat it with its vectors until `remaining` is 0.

    A path waits while a chunk of it has no vector of its present hash, or the store has one that the path no longer has. The
    step takes `budget` waiting paths, one at least, all if None, in the order of `priority` (of a path's chunks, largest first), then by
    path. Chunks whose hash is unchanged keep their vectors; paths that aren't taken keep all that is stored. Chunks
    that fail are not stored, so their path waits again. Vectors are given lazily: store them before the next step."""
    now = chunks.select("path", "ordinal", "heading_context", "text", "content_hash", (F.lit(0) if priority is None else priority).alias("_priority"))
    old = stored.select("path", "ordinal", F.col("heading_context").alias("_context"), F.col("content_hash").alias("_hash"), F.col("vector").alias("_vector"))
    both = now.join(old, ["path", "ordinal"], "full_outer")
    fresh = F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_vector").isNotNull()
    waiting = both.groupBy("path").agg(F.max("_priority").alias("_first"), F.count_if(~fresh).alias("_stale")).where("_stale > 0")
    taken = waiting.select("path", "_first")
    if budget is not None:
        taken = taken.orderBy(F.desc_nulls_last("_first"), "path").limit(max(budget, 1))
    marked = both.join(taken.select("path", F.lit(True).alias("_taken")), "path", "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    kept = marked.where(~F.col("_taken") & F.col("_hash").isNotNull()).select("path", "ordinal", F.col("_context").alias("heading_context"), F.col("_hash").alias("content_hash"), F.col("_vector").alias("vector"))
    same = marked.where(F.col("_taken") & fresh).select("path", "ordinal", "heading_context", "content_hash", F.col("_vector").alias("vector"))
    wanted = marked.where(F.col("_taken") & ~fresh & F.col("content_hash").isNotNull()).select("path", "ordinal", "heading_context", "text", "content_hash")
    made = embed_batches(wanted, name)
    after = kept.unionByName(same).unionByName(made.where("vector IS NOT NULL").select("path", "ordinal", "heading_context", "content_hash", "vector"))
    report = made.agg(F.count_if(F.col("vector").isNotNull()).alias("embedded"), F.count_if(F.col("vector").isNull()).alias("failed"))
    report = report.crossJoin(same.agg(F.count("*").alias("skipped"))).crossJoin(taken.agg(F.count("*").alias("paths_scanned"))).crossJoin(waiting.agg(F.count("*").alias("_all")))  # one row each
    return after, report.select("paths_scanned", "embedded", "skipped", "failed", (F.col("_all") - F.col("paths_scanned")).alias("remaining"))


def status(indexed: DataFrame, files: DataFrame, stamp: str = "mtime", built: str = "indexed_at") -> DataFrame:
    """One row: documents in the index, how many of all are new, changed or gone, and when it was last built."""
    both = indexed.select("path", F.col(stamp).alias("_a"), F.lit(True).alias("_in")).join(files.select("path", F.col(stamp).alias("_b"), F.lit(True).alias("_on")), "path", "full_outer")
    stale = F.col("_in").isNull() | F.col("_on").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    last = indexed.agg(F.max(built).alias("last_build"))
    return both.agg(F.count_if("_in").alias("documents"), F.count_if(stale).alias("stale_estimate")).crossJoin(last)  # one row each
