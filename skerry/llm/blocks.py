"""Exact comparison of sets that meet in groups, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import materialize
from skerry.llm.components import connected_components
from skerry.llm.workers import tidy

#: (block, sig, tokens as sorted 64-bit hashes in bytes) for rows (sig, block).
Sets = Callable[[DataFrame], DataFrame]
#: Blocks of so few sets are compared pair by pair.
SMALL = 6


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * |A and B| >= percent * |A or B|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    together = np.sort(np.concatenate([a, b]))
    both = int((together[1:] == together[:-1]).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links_of_few(sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    label, made = list(range(len(sets))), []
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j], percent):
                made.append((int(sigs[i]), int(sigs[j])))
                label = [label[i] if x == label[j] else x for x in label]
    return made


def links_in_block(sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest that connects all that links connect. Sets that share none of their locally rarest tokens aren't compared."""
    if len(sets) <= SMALL:
        return _links_of_few(sigs, sets, percent)
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    label, made = np.arange(len(order)), []
    need = -(-percent * sizes // 100)
    # first tokens of each set, rarest in the block first
    rank = np.lexsort((token, count[token], owner))
    begins = np.concatenate([[0], sizes.cumsum()])
    within = np.arange(len(rank)) - begins[owner]
    index = rank[within < (sizes - need + 1)[owner]]
    index = index[count[token[index]] > 1]
    by_token = index[np.lexsort((owner[index], token[index]))]
    keys, lists = token[by_token], owner[by_token]
    edges = np.concatenate([[0], (np.diff(keys) != 0).nonzero()[0] + 1, [len(keys)]]) if len(keys) else np.array([0])
    postings = {int(keys[a]): lists[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}
    mine: dict[int, list[int]] = {}
    for i in index:
        mine.setdefault(int(owner[i]), []).append(int(token[i]))
    for i, own in mine.items():
        near = np.unique(np.concatenate([postings[t] for t in own]))
        near = near[(near < i) & (sizes[near] >= need[i])]
        for j in near[np.argsort(-sizes[near], kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            a, b = sets[order[i]], sets[order[j]]
            if similar(a, b, percent):
                made.append((int(sigs[order[i]]), int(sigs[order[j]])))
                label[label == label[j]] = label[i]
    return made


def meeting(meet: DataFrame) -> DataFrame:
    """(grp, sig, n), stored, for groups given as (grp, sig): those of n >= 2 members."""
    busy = materialize(meet.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "busy")
    return materialize(meet.join(busy, "grp"), "meet")


def _parts(n: str, block: int) -> Column:
    return F.ceil(F.col(n) / block).cast("int")


def _own(parts: str) -> Column:
    return F.pmod(F.xxhash64("sig"), F.col(parts)).cast("int")


def _across(rows: DataFrame, block: int) -> DataFrame:
    """(sig, block) for members (grp, sig, rest) of groups: each of the rest meets all, in parts of bounded size."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("rest").alias("few")).where("n > 1 and few > 0")
    rows = rows.join(materialize(sizes.select("grp", _parts("n", block).alias("parts"), _parts("few", block).alias("lanes")), "parts"), "grp")
    parts, lanes = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("lanes") - 1)
    every = rows.select("grp", "sig", _own("parts").alias("part"), F.explode(lanes).alias("lane"))
    rest = rows.where("rest").select("grp", "sig", F.explode(parts).alias("part"), _own("lanes").alias("lane"))
    return every.union(rest).select("sig", F.xxhash64("grp", "part", "lane").alias("block")).distinct()


def _rarest_first(rows: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(grp, sig, rest) for members of groups, dealt out by the first tokens of each set, the rarest of its group first.

    Of two sets that link, the first n - ceil(percent * n / 100) + 1 tokens share one."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sig, tokens in zip(b.column("sig").to_pylist(), b.column("tokens"), strict=True):
                own = np.frombuffer(tokens.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), sig)), pa.array(own)], ["sig", "token"])

    members = rows.select("sig").distinct().withColumn("block", F.col("sig"))
    tokens = rows.join(materialize(sets(members).select("sig", "tokens").mapInArrow(tidy(exploded), "sig long, token long"), "tokens"), "sig")
    often = materialize(tokens.groupBy("grp", "token").agg(F.count("*").alias("n")).where("n > 1"), "often")
    counted = tokens.join(often, ["grp", "token"], "left").groupBy("grp", "sig", "rest")
    # one row's list is as long as its set
    ordered = counted.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("x"))
    size = F.size("x") - F.expr(f"int((size(x) * {percent} + 99) / 100)") + 1
    first = ordered.select("grp", "sig", "rest", F.explode(F.slice("x", F.lit(1), size)).alias("x")).where("x.n > 1")
    return materialize(first.select(F.xxhash64("grp", "x.token").alias("grp"), "sig", "rest"), "dealt")


def group_links(rows: DataFrame, sets: Sets, percent: int, block: int) -> DataFrame:
    """(a, b): a forest for each block of the links between the members of each group; rows are those of meeting().

    A group of up to `block` members is one block. Of a larger one, parts of that size each meet its first part. Where that
    joins all its members, as with many near copies of one text, it is done. Else the members outside the largest joint
    class, the rest, must still meet all others: they are dealt out by the rarest tokens of their sets, and only those that
    share one meet, again in parts of bounded size. sets gives (block, sig, tokens) for rows (sig, block)."""
    rows = rows.withColumn("parts", _parts("n", block))
    rows = rows.withColumn("own", _own("parts"))
    small = rows.where("parts = 1").select("sig", F.xxhash64("grp", F.lit(0)).alias("block"))
    large = materialize(rows.where("parts > 1"), "large")
    star = large.select("sig", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))).alias("part"), "grp")
    links = block_links(sets(materialize(small.union(star.select("sig", F.xxhash64("grp", "part").alias("block"))), "blocks")), percent)
    if large.isEmpty():
        return links
    labels = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("label"))
    large = materialize(large.select("grp", "sig").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "labelled")
    sizes = large.groupBy("grp", "label").agg(F.count("*").alias("n"))
    top = materialize(sizes.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("grp", "top.label"), "top")
    if top.isEmpty():
        return links
    open_ = materialize(large.join(top.withColumnRenamed("label", "top"), "grp").select("grp", "sig", (F.col("label") != F.col("top")).alias("rest")), "open")
    blocks = materialize(_across(_rarest_first(open_, sets, percent), block), "blocks")
    return links.union(block_links(sets(blocks), percent))


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of links between the sets of each block; rows has (block, sig, tokens), tokens as sorted 64-bit hashes in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def compared(out: list) -> None:
            if len(held) > 1:
                own = sorted(held)
                out += links_in_block(np.array(own), [np.frombuffer(held[x], np.uint64) for x in own], percent)

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            out: list[tuple[int, int]] = []
            for block, sig, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if block != now:
                    compared(out)
                    now, held = block, {}
                held[sig] = tokens.as_buffer()
            if out:
                yield batch(out)
        out = []
        compared(out)
        if out:
            yield batch(out)

    # blocks are small and many: a task takes them one after the other from its sorted rows
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("block", "sig", "tokens").repartition(parts, "block").sortWithinPartitions("block")
    return materialize(rows.mapInArrow(tidy(run), "a long, b long").distinct(), "links")
