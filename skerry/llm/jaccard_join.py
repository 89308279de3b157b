"""Operator 7: an exact n-gram Jaccard self-join through a token-group matrix.

A document's set is its distinct word shingles. Documents with equal sets are one class, decided by their set's hash, so
copies never meet in pairs. The classes are partitioned into groups of similar ones: by a minimum hash, which two sets
share with a probability equal to their similarity; of a few such hashes a class takes the one that most classes have. The token-group matrix holds, for each token and each group, that the
union of the group's sets has the token, with the range of sizes of the sets that have it. It is kept for each set's
first tokens in one global order, the frequent tokens last: of two sets that link, the first n - ceil(t * n) + k tokens
must share k, so a query that overlaps a group's union in fewer of them is bounded below the threshold and the group
stays closed to it (k is about n / 12, and for a pair what the smaller set can have). A set that shares fewer with all
others together takes no part at all. The other groups are opened, a pair of groups from the smaller one: their classes and the queries meet in blocks of bounded size, where full
sets are compared exactly, except for pairs that links found before already connect (of a group that is larger than a
block, see blocks.group_links). The links are a forest over the classes, and their components are the result.

Frequent tokens are those that many documents share; they come last in the order, so passages found everywhere don't
bring unlike documents together. They are counted over all documents; the order affects only the work, not the result.

Defined results: a null, empty or wordless text has an empty set: n_shingles 0, linked with nothing, its component is its
own id; equal rows are one class; a null doc_id takes part like others, and a component of null ids only is null; an
empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import group_links, meeting
from skerry.llm.common import BROADCAST_KEYS, materialize, new_id, release, scope, small_lookup, table
from skerry.llm.components import connected_components
from skerry.llm.hashing import Members, mix, shingles, words
from skerry.llm.workers import tidy


#: One in so many tokens of a set is among the first ones for a sharper bound.
SPARE = 12
#: Blocks in one row that asks for a set, and rows of such lists below which they are broadcast: some 10 MB.
LIST, BROADCAST_LISTS = 16, 50_000


@dataclass(frozen=True)
class Settings:
    """Two sets link when 100 * |A and B| >= percent * |A or B|."""

    n: int = 3
    percent: int = 90
    #: Tokens counted as frequent: at least this many documents and this share of all, raised until `frequent_limit` is enough.
    frequent_rows: int = 64
    frequent_share: float = 0.001
    frequent_limit: int = 200_000
    #: Minimum hashes of which the most popular is a class's group.
    hashes: int = 3
    #: Sets that meet in one block.
    block: int = 1000
    #: Tokens that a task counts at a time.
    chunk: int = 2_000_000


def token_set(text: bytes | None, n: int) -> np.ndarray:
    return np.unique(shingles(words(text or b"")[0], n))


def frequent_tokens(docs: DataFrame, s: Settings) -> np.ndarray:
    """Hashes of the tokens that many documents have, at most s.frequent_limit of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            kept = counts >= 3  # rarer ones in a chunk this large can't add up to a frequent token's share
            return pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(counts[kept])], ["token", "n"])

        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                held.append(token_set(text, s.n))
                size += len(held[-1])
                if size >= s.chunk:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("n") >= s.frequent_rows), "frequent")
    least = max(s.frequent_rows, int(s.frequent_share * docs.count()))
    while counts.where(F.col("n") >= least).count() > s.frequent_limit:
        least *= 2
    rows = counts.where(F.col("n") >= least).select("token").toPandas()  # at most frequent_limit numbers
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def first_tokens(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The set's first n - ceil(percent * n / 100) + 1 + n // SPARE tokens: by hash, frequent ones last."""
    size = len(tokens) - -(-percent * len(tokens) // 100) + 1 + len(tokens) // SPARE
    return np.concatenate([tokens[~frequent], tokens[frequent]])[:size]


def sets_of(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, txt (hash of the text), n_shingles, sig (hash of the set), grps (minimum hashes) and first (its first tokens) of every row; 0 shingles: sig is null."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(frequent.value)
        for b in batches:
            size, sig, grp, first = [], [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                tokens = token_set(text, s.n)
                size.append(len(tokens))
                if not len(tokens):
                    sig.append(None)
                    grp.append(None)
                    first.append(np.empty(0, np.int64))
                    continue
                often = known(tokens)
                rare = tokens[~often]
                own = rare if 2 * len(rare) >= len(tokens) else tokens
                sig.append(set_hash(tokens))
                grp.append([int(mix(own ^ np.uint64(0x5BF03635 * k)).min().view(np.int64)) for k in range(1, s.hashes + 1)])
                first.append(first_tokens(tokens, often, s.percent).view(np.int64))
            counts = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.array(grp, pa.list_(pa.int64())), lists], ["doc_id", "txt", "n_shingles", "sig", "grps", "first"])

    return docs.select("doc_id", F.xxhash64("text").alias("txt"), "text").mapInArrow(tidy(run), "doc_id long, txt long, n_shingles long, sig long, grps array<long>, first array<long>")


def set_hash(tokens: np.ndarray) -> int:
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    return int((mix(mix(tokens) + place).sum() ^ mix(place[-1:])[0]).view(np.int64))


def _grouped(classes: DataFrame) -> DataFrame:
    """(sig, grp, size): the group of each class and the number of classes in it."""
    rows = classes.select("sig", F.explode("grps").alias("grp"))
    popular = materialize(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "popular")
    chosen = rows.join(popular, "grp").groupBy("sig").agg(F.max(F.struct("n", "grp")).alias("top")).select("sig", F.col("top.grp").alias("grp"))
    grouped = classes.select("sig", F.col("grps")[0].alias("own")).join(materialize(chosen, "chosen"), "sig", "left")
    grouped = materialize(grouped.select("sig", F.coalesce("grp", "own").alias("grp")), "grouped")
    return grouped.join(materialize(grouped.groupBy("grp").agg(F.count("*").alias("size")), "sizes"), "grp")


def _needed(percent: int):
    """Tokens that a set of n_shingles shares, among the first ones, with any set it links with, as that has ceil(percent * n / 100) tokens at least."""
    return F.expr(f"1 + int(int((n_shingles * {percent} + 99) / 100) / {SPARE})")


def _opened(classes: DataFrame, percent: int) -> DataFrame:
    """(grp, sig): which classes meet in which groups: each in its own, and as a query in those whose union it overlaps.

    Of two groups the larger is opened, by the classes of the smaller."""
    rows = classes.select("sig", "n_shingles", F.explode("first").alias("token"))
    shared = rows.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("token")
    rows = materialize(rows.join(materialize(shared, "shared"), "token"), "shared_rows")
    alive = rows.groupBy("sig", "n_shingles").agg(F.count("*").alias("n")).where(F.col("n") >= _needed(percent)).select("sig")
    alive = materialize(alive, "alive")
    grouped = materialize(_grouped(classes.select("sig", "grps").join(alive, "sig")), "groups")
    rows = rows.join(grouped, "sig").select("token", "sig", "n_shingles", F.struct("size", "grp").alias("grp"))
    rows = materialize(rows, "cells")
    # the matrix: one row for a token and a group
    matrix = rows.groupBy("token", "grp").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    matrix = materialize(matrix.select("token", F.col("grp").alias("to"), "least", "most"), "matrix")
    met = rows.join(matrix, "token").where((F.col("grp") < F.col("to")) & (F.col("least") * percent <= F.col("n_shingles") * 100) & (F.col("most") * 100 >= F.col("n_shingles") * percent))
    queries = met.groupBy(F.col("to.grp").alias("grp"), "sig", "n_shingles").agg(F.count("*").alias("n")).where(F.col("n") >= _needed(percent))
    return grouped.select("grp", "sig").union(queries.select("grp", "sig"))


def link_classes(docs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a forest of links between classes, by sig."""
    row = F.struct("doc_id", "txt")
    one = sets.where(F.col("sig").isNotNull()).groupBy("sig")
    classes = materialize(one.agg(F.first("grps").alias("grps"), F.first("n_shingles").alias("n_shingles"), F.first("first").alias("first"), F.min(row).alias("row")), "classes")
    own = new_id()
    with scope(own):
        opened = _opened(classes, s.percent)
    meet = materialize(opened, "opened")
    release(docs.sparkSession, own)

    def recomputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sig, blocks, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                tokens = token_set(text, s.n)
                # texts whose hashes are equal by chance don't give this class's set
                if len(tokens) and set_hash(tokens) == sig:
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([sig] * n, pa.int64()), pa.array([tokens.tobytes()] * n, pa.binary())], ["block", "sig", "tokens"])

    null = F.lit(-(2**63))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """One row of each class gives the class's set, to LIST blocks at a time."""
        lists = wanted.groupBy("sig").agg(F.collect_list("block").alias("blocks"))
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size("blocks") - 1) / LIST).cast("int")), lambda k: F.slice("blocks", k * LIST + 1, F.lit(LIST)))
        givers = lists.select("sig", F.explode(some).alias("blocks")).join(classes.select("sig", "row.*"), "sig")
        givers = materialize(givers.select("sig", "blocks", F.coalesce("doc_id", null).alias("_key"), F.col("txt").alias("_txt")), "givers")
        rows = docs.select(F.coalesce("doc_id", null).alias("_key"), F.xxhash64("text").alias("_txt"), "text")
        texts = small_lookup(rows, givers, ["_key", "_txt"], "inner", BROADCAST_LISTS)
        return texts.select("sig", "blocks", "text").mapInArrow(tidy(recomputed), "block long, sig long, tokens binary")

    return group_links(meeting(meet), sets_of, s.percent, s.block)


def _labelled(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and sig and _label (a sig) of the classes that links join."""
    sets = materialize(sets_of(docs, s), "sets")
    links = link_classes(docs, sets, s)
    labels = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("_label"))
    return sets, materialize(labels, "labels")


def join(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and sig, which rows of one class share."""
    sets, labels = _labelled(docs, settings or Settings())
    # the smallest id of each class, then of each component
    ids = materialize(sets.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("_least")), "ids")
    least = materialize(labels.join(ids, "sig").groupBy("_label").agg(F.min("_least").alias("_joint")), "joint")
    found = ids.join(labels.join(least, "_label").select("sig", "_joint"), "sig", "left")
    found = materialize(found.select("sig", F.coalesce("_joint", "_least").alias("component_id")), "components")
    empty = sets.where(F.col("sig").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sig")
    return sets.select("doc_id", "n_shingles", "sig").where(F.col("sig").isNotNull()).join(found, "sig").select("doc_id", "n_shingles", "component_id", "sig").union(empty)


def keep_one(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs, all their columns, with one row of each component: that of the smallest id, without ids that of the smallest hash of the text.

    Rows are told apart by id and text, so other texts under the id of a removed row stay; of rows equal in both one stays.
    Rows without shingles are in no component and stay."""
    sets, labels = _labelled(docs, settings or Settings())
    own = f"_row_{new_id()}"  # no column of docs
    keys = [f"{own}_{k}" for k in ("id", "txt")]
    named = sets.where(F.col("sig").isNotNull()).select("sig", F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(-(2**63))).alias(keys[0]), F.col("txt").alias(keys[1]))
    row = F.struct("_null", *keys)
    # the first row of each class, then of each component
    first = named.groupBy("sig").agg(F.min(row).alias("_own")).join(labels, "sig", "left")
    first = materialize(first.withColumn("_label", F.coalesce("_label", "sig")), "first")
    stays = materialize(first.groupBy("_label").agg(F.min("_own").alias("_stays")), "stays")
    rows = named.join(first.join(stays, "_label").select("sig", "_stays"), "sig")
    gone = materialize(rows.where(row != F.col("_stays")).select(*keys).distinct(), "gone")
    again = materialize(rows.where(row == F.col("_stays")).groupBy(*keys).count().where("count > 1").select(*keys), "again")
    left = docs.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias(keys[0]), F.xxhash64("text").alias(keys[1]))
    left = small_lookup(left, gone, keys, "left_anti", BROADCAST_KEYS)
    if again.limit(1).count():
        once = small_lookup(left, again, keys, "left_semi", BROADCAST_KEYS).dropDuplicates(keys)
        left = small_lookup(left, again, keys, "left_anti", BROADCAST_KEYS).union(once)
    return left.drop(*keys)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("sig")
