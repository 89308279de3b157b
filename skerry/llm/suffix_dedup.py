"""Operator 10: repeated passages by a sparse suffix array.

Words are runs without ASCII white space, the case of A-Z apart. Every place that min_words words follow has an anchor: of
the `window` k-grams from it, the last of those with the least hash. Only suffixes at anchors are retained. As the choice
depends on the place's own min_words words alone, equal passages of min_words words have their anchors at the same word, and
at least min_words - window + 1 words of the passage follow it: the anchor's key is a hash of so many words. Suffixes are
brought into the order of their hashes, in which equal ones are neighbours, by a distributed sort rather than in one array.

Among the suffixes of a key, those with equal surroundings (all passages of min_words words that have this anchor) are a
class, and all but its earliest one repeat whole. The earliest suffixes of a key's classes are compared passage by passage:
each passage of min_words words is put in order with the others of the key, and repeats where any earlier place has it, not
only the key's first; of a key with very many classes by an aggregation in place of an order. So a word is in a repeat if and only if it is in a passage of min_words words that stands unbroken in
one earlier place. Overlapping passages of a document are joined to one repeat, whose source is the earliest place of its
first min_words words; what follows them may have another source.

A source is always the earlier one, so cutting all repeats leaves the first copy of every passage.

Defined results: null and short texts have no repeats; a passage that repeats within one document counts, its first place
is the original; a document is a doc_id (null is one, ordered first) and a text, so equal rows with one id are one document and
others with one id, or without, are told apart, ordered by a hash of the text; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import BROADCAST_KEYS, BROADCAST_ROWS, materialize, new_id, small_lookup, table
from skerry.llm.hashing import mix, powers, shingles, words
from skerry.llm.workers import tidy

NULL_KEY = -(2**63)


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    k: int = 8
    window: int = 25
    #: Classes of one key that meet in one place, the passages of more going by an aggregation; and places of a class in one list.
    classes: int = 1000

    @property
    def depth(self) -> int:
        """Words of a suffix that its key covers."""
        return self.min_words - self.window + 1


class Stretches:
    """Hashes of stretches of words, from sums over all words before each."""

    def __init__(self, ids: np.ndarray) -> None:
        forward, self.back = powers(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids) * forward[: len(ids)], out=self.total[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[first]) * self.back[first])


def anchors(ids: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The retained positions, and the first and the number of places whose anchor each is."""
    if len(ids) < s.min_words:
        return (np.empty(0, np.int64),) * 3
    windows = np.lib.stride_tricks.sliding_window_view(shingles(ids, s.k), s.window)[: len(ids) - s.min_words + 1]
    last = np.arange(len(windows)) + s.window - 1 - windows[:, ::-1].argmin(axis=1)
    return np.unique(last, return_index=True, return_counts=True)


def _doc() -> list[Column]:
    """What tells documents apart, in their order."""
    return [F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"), F.xxhash64("text").alias("txt")]


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values).astype(kind) if values else np.empty(0, kind)))


def suffixes(docs: DataFrame, s: Settings) -> DataFrame:
    """doc, txt and, of every retained suffix, at, key, whole (hash of its surroundings), before (words from their start), places and more, stored one row a document.

    Neighbours with equal surroundings, as a periodic text has them, are two rows: the first, and the second with the words that all others add to it (more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                ids = words(text or b"")[0]
                at, first, count = anchors(ids, s)
                stretch = Stretches(ids)
                whole = mix(stretch(first, first + count - 1 + s.min_words) + (at - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
                begins = np.append(True, whole[1:] != whole[:-1]).nonzero()[0] if len(at) else at
                length = np.diff(np.append(begins, len(at)))
                within, length = np.arange(len(at)) - np.repeat(begins, length), np.repeat(length, length)
                rows = (at, stretch(at, at + s.depth).view(np.int64), whole.view(np.int64), at - first, count, np.where(within == 1, (length - 2) * count, 0))
                found.append([x[within < 2] for x in rows])
            lists = [_lists([f[i] for f in found], t) for i, t in enumerate((np.int32, np.int64, np.int64, np.int8, np.int8, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc", "txt", "at", "key", "whole", "before", "places", "more"])

    schema = "doc long, txt long, at array<int>, key array<long>, whole array<long>, before array<byte>, places array<byte>, more array<int>"
    stored = materialize(docs.select(*_doc(), "text").mapInArrow(tidy(run), schema), "suffixes")
    return stored.select("doc", "txt", F.explode(F.arrays_zip("at", "key", "whole", "before", "places", "more")).alias("x")).select("doc", "txt", "x.*")


def _passages(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """slot (the key), doc, txt, at (lists of places), gram (hashes of their min_words words) and large, for wanted rows (doc, txt, at, key, before, places, large)."""
    lists = wanted.groupBy("doc", "txt").agg(F.collect_list(F.struct("at", "key", "before", "places", "large")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, txt, text, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids = words(text or b"")[0]
                stretch, slots, places, grams, large = Stretches(ids), [], [], [], []
                for r in rows:
                    at = np.arange(r["at"] - r["before"], r["at"] - r["before"] + r["places"])
                    slots.append(r["key"])
                    places.append(at)
                    grams.append(stretch(at, at + s.min_words).view(np.int64))
                    large.append(r["large"])
                n = len(slots)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([txt] * n, pa.int64()), _lists(places, np.int32), _lists(grams, np.int64), pa.array(large, pa.bool_())], ["slot", "doc", "txt", "at", "gram", "large"])

    # the lists grow with the input, so they are never broadcast
    texts = docs.select(*_doc(), "text").join(lists.hint("merge"), ["doc", "txt"]).select("doc", "txt", "text", "ends")
    return texts.mapInArrow(tidy(run), "slot long, doc long, txt long, at array<int>, gram array<long>, large boolean")


def _repeated(passages: DataFrame, s: Settings) -> DataFrame:
    """SPAN rows of passages that have an earlier place, for keys with any number of classes.

    A passage's earliest place is a minimum, which is taken before rows are shuffled, so one that very many classes share
    is no task's burden. Minima of such passages, of which there are few, are broadcast up to a checked number."""
    zipped = passages.select("slot", "doc", "txt", F.explode(F.arrays_zip("at", "gram")).alias("x"))
    rows = materialize(zipped.select("slot", "x.gram", F.struct("doc", "txt", "x.at").alias("place")), "places")
    # repeated rows of one document are the same place
    first = materialize(rows.groupBy("slot", "gram").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")).where("low < high"), "first")
    often = small_lookup(rows, first.where(F.col("n") > s.classes).select("slot", "gram", "low"), ["slot", "gram"], "inner", BROADCAST_ROWS)
    rest = rows.join(first.where(F.col("n") <= s.classes).select("slot", "gram", "low"), ["slot", "gram"])
    later = often.unionByName(rest).where("place <> low")
    return later.select("place.doc", "place.txt", F.col("place.at").alias("first"), (F.col("place.at") + s.min_words).cast("int").alias("end"), F.col("low.doc").alias("source"), F.col("low.txt").alias("source_txt"), F.col("low.at").alias("source_at"))


SPAN = "doc long, txt long, first int, end int, source long, source_txt long, source_at int"


def _compared(passages: DataFrame, s: Settings) -> DataFrame:
    """SPAN rows of passages that an earlier place of their slot has; neighbouring ones are one row."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        doc, txt = (t.column(x).to_numpy() for x in ("doc", "txt"))
        lists = t.column("at").combine_chunks()
        row = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy())
        at, gram = lists.flatten().to_numpy(), t.column("gram").combine_chunks().flatten().to_numpy()
        order = np.argsort(gram, kind="stable")
        begins = np.append(True, np.diff(gram[order]) != 0) if len(order) else np.empty(0, bool)
        origin = np.empty(len(order), np.int64)
        origin[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        # repeated rows of one document are the same place
        later = ((doc[row] != doc[row[origin]]) | (txt[row] != txt[row[origin]]) | (at != at[origin])).nonzero()[0]
        new = np.append(True, (np.diff(later) != 1) | (np.diff(at[later]) != 1) | (np.diff(row[later]) != 0)) if len(later) else np.empty(0, bool)
        low, high = later[new], later[np.append(new[1:], True)] if len(later) else later
        out = [doc[row[low]], txt[row[low]], at[low], (at[high] + s.min_words).astype(np.int32), doc[row[origin[low]]], txt[row[origin[low]]], at[origin[low]]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "txt", "first", "end", "source", "source_txt", "source_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column(0).to_numpy()
            cut = int(np.searchsorted(slot, slot[-1]))  # the last slot may go on
            if cut or (held and held[-1].column(0)[-1].as_py() != slot[-1]):
                yield spans(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield spans(pa.Table.from_batches(held))

    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return passages.repartition(parts, "slot").sortWithinPartitions("slot", "doc", "txt", F.col("at")[0]).mapInArrow(tidy(run), SPAN)


def _stretches(spans: DataFrame, by: list[str], start: list[str]) -> DataFrame:
    """by, start and end of spans (first, end) that overlap, as one row with the `start` of the first of them; a window holds the spans of one `by`."""
    within = Window.partitionBy(*by).orderBy("first", "end")
    ended = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    steps = spans.withColumn("_new", F.coalesce((F.col("first") >= ended).cast("int"), F.lit(1)))
    steps = steps.withColumn("_stretch", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = steps.groupBy(*by, "_stretch").agg(F.min(F.struct(*start)).alias("low"), F.max("end").alias("end"))
    return joined.select(*by, "low.*", "end")


def _copied(lists: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """SPAN rows of all places of a class but its earliest one.

    Overlapping classes with the same documents at the same distances from their earliest places, as the suffixes of one
    longer passage have them, are joined first, so that a copy of the passage is one row and not one for each suffix."""
    whole = lists.where("lanes = 1 AND size(list) > 1").withColumn("original", F.col("low")).withColumn("n", F.size("list").cast("long"))
    parts = lists.where("lanes > 1").join(classes.where("lanes > 1 AND n > 1").select("key", "whole", "original", "n"), ["key", "whole"])
    held = whole.unionByName(parts)
    # distinct places, so no two cancel each other out
    distances = F.aggregate("list", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(F.xxhash64(y["doc"], y["txt"], y["at"] - F.col("original.at"), y["more"])))
    first = F.col("original.at") - F.col("before")
    own = held.select("key", "whole", "n", F.col("original.doc").alias("source"), F.col("original.txt").alias("source_txt"), first.alias("first"), (first + F.col("places") + F.lit(s.min_words - 1)).alias("end"), distances.alias("part"))
    own = own.groupBy("key", "whole", "n", "source", "source_txt", "first", "end").agg(F.bit_xor("part").alias("distances"))
    joined = _stretches(own, ["source", "source_txt", "n", "distances"], ["first", "key", "whole"])
    joined = materialize(joined.select("key", "whole", "source", "source_txt", "first", "end"), "joined")
    copies = held.join(joined, ["key", "whole"]).select("original", "source", "source_txt", "first", "end", F.explode("list").alias("x")).where(F.col("x") != F.col("original"))
    distance = F.col("x.at") - F.col("original.at")
    return copies.select("x.doc", "x.txt", (F.col("first") + distance).alias("first"), (F.col("end") + distance + F.col("x.more")).alias("end"), "source", "source_txt", F.col("first").alias("source_at"))


def find_spans(docs: DataFrame, s: Settings) -> DataFrame:
    """doc, txt, first, end and source, source_txt, source_at of every repeat."""
    rows = suffixes(docs, s)
    runs = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    runs = materialize(runs.select("key", (F.col("low") < F.col("high")).alias("mixed"), F.ceil(F.col("n") / s.classes).cast("int").alias("lanes")), "runs")
    # places of a class stand in lists, of a frequent one in several, so that joins are of classes and not of places; repeated rows of one document are the same place
    place, none = F.struct("doc", "txt", "at", "more"), F.lit(0)
    lane = F.when(F.col("lanes") > 1, F.pmod(F.xxhash64("doc", "txt", "at"), F.col("lanes"))).otherwise(none)
    lists = rows.join(runs, "key").groupBy("key", "whole", "before", "places", "mixed", "lanes", lane.alias("lane")).agg(F.collect_set(place).alias("list"), F.min(place).alias("low"))
    lists = materialize(lists, "equal")
    classes = lists.groupBy("key", "whole").agg(F.min("low").alias("original"), F.sum(F.size("list")).alias("n"), *(F.first(c).alias(c) for c in ("before", "places", "mixed", "lanes")))
    classes = materialize(classes, "classes")
    # of keys with several classes, the first of each class may share passages with an earlier one
    mixed = classes.where("mixed")
    large = materialize(mixed.groupBy("key").count().where(F.col("count") > s.classes).select("key", F.lit(True).alias("large")), "large")
    wanted = small_lookup(mixed.select("original.*", "key", "before", "places"), large, ["key"]).withColumn("large", F.coalesce("large", F.lit(False)))
    # texts are shuffled once, for small and for large keys
    passages = _passages(docs, materialize(wanted, "wanted"), s)
    if large.isEmpty():
        found = [_compared(passages, s)]
    else:
        passages = materialize(passages, "passages")
        found = [_compared(passages.where("NOT large"), s), _repeated(passages.where("large"), s)]
    spans = _copied(lists, classes, s)
    for more in found:
        spans = spans.union(more)
    return _stretches(materialize(spans, "spans"), ["doc", "txt"], ["first", "source", "source_txt", "source_at"])


def find_repeats(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, first_word, n_words, source_id and source_word of every repeat; the source is the earliest place of its first min_words words."""
    found, null = find_spans(docs, settings or Settings()), F.lit(NULL_KEY)
    return found.select(
        F.nullif("doc", null).alias("doc_id"), F.col("first").cast("long").alias("first_word"), (F.col("end") - F.col("first")).cast("long").alias("n_words"), F.nullif("source", null).alias("source_id"), F.col("source_at").cast("long").alias("source_word")
    )


def cut_repeats(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs with every repeat cut from text and n_chars set anew where it is a column; rows that lose all their words go."""
    own = f"_doc_{new_id()}"  # no column of docs
    keys = [f"{own}_{k}" for k in ("id", "txt")]
    found = find_spans(docs, settings or Settings()).select(F.col("doc").alias(keys[0]), F.col("txt").alias(keys[1]), F.col("first").alias("first_word"), (F.col("end") - F.col("first")).alias("n_words"))
    found = materialize(found, "found")
    spans = found.groupBy(*keys).agg(F.collect_list(F.struct("first_word", "n_words")).alias(f"{own}_spans"))
    few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    keyed = docs.select("*", *(c.alias(k) for c, k in zip(_doc(), keys, strict=True)))
    joined = keyed.join(F.broadcast(spans) if few else spans, keys, "left").drop(*keys)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept = b.column(at).to_pylist(), []
            for i, spans in enumerate(b.column(len(names)).to_pylist()):
                if spans:
                    texts[i] = without(texts[i] or "", [(x["first_word"], x["n_words"]) for x in spans])
                kept.append(not spans or bool(texts[i].strip()))
            columns = [b.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                changed = [None if t is None else len(t) for t in texts]
                columns[k] = pa.array([c if spans else old for c, spans, old in zip(changed, b.column(len(names)).to_pylist(), columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(tidy(run), docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans (first word, number of words); white space before a span stays."""
    raw = text.encode()
    ids, starts, ends = words(raw)
    gone = np.zeros(len(ids) + 1, np.int64)
    for first, count in spans:
        if first + count <= len(ids):
            gone[first] += 1
            gone[first + count] -= 1
    inside = np.diff((gone[:-1].cumsum() > 0).astype(np.int8), prepend=0, append=0)
    out, at = [], 0
    for a, b in zip((inside == 1).nonzero()[0], (inside == -1).nonzero()[0], strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
