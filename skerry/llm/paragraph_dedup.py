"""Operator 9: near-duplicate paragraphs across documents, by MinHash banding.

A paragraph is a line of `min_words` words or more, or a block of shorter lines in a row without an empty one between that
has so many. For passages inside lines, lines of several sentences are also cut into fragments:
a fragment ends with the line, with a sentence of at least `sentence` words, with one in eight shorter sentences and with
one in `anywhere` other words, chosen by a hash of the last two words. So where it ends depends only on the words near by,
and a passage is cut alike wherever it stands. Paragraphs and fragments of equal words are one class. Each class has bands
of minimum hashes of its 5-word shingles: one that is a single fragment `bands` of one row, of which at a similarity of 0.8
one agrees with a probability of 99.2 %; another paragraph `line_bands` of `line_rows` rows, 99.4 %, as unlike lines may
share a passage. Classes that collide in a band meet in blocks of bounded size, where exact Jaccard similarity of the whole
paragraph or fragment decides, and the components of the links are clusters. In each cluster the first paragraph, by
document and place, stays and the others are to be removed.

A cluster counts if it has paragraphs of two documents or more. Its paragraphs are all reported; its fragments are where
they make up a passage: `run`, the words from the first to the last of clustered paragraphs and fragments in a row of
their document (short ones may stand between), is `passage` or more. A shorter sentence that is common to texts is neither
a paragraph nor a passage. Lower settings of min_words (from n on) and passage report such ones too.

Defined results: null and empty texts have no paragraphs; a document is a doc_id (null is one, ordered first) and a text, so
equal rows with one id are one document and others with one id, or without, are told apart; an empty table has no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.blocks import group_links, meeting
from skerry.llm.common import materialize, new_id, release, scope, table
from skerry.llm.components import connected_components
from skerry.llm.hashing import mix, shingles, words
from skerry.llm.workers import tidy

NULL_KEY = -(2**63)
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
#: A place: the first word in the upper bits, the number of words in so many lower ones, and whether it is a paragraph in the last.
COUNT_BITS = 20
FEWER = (1 << COUNT_BITS) - 1


@dataclass(frozen=True)
class Settings:
    n: int = 5
    percent: int = 80
    min_words: int = 15
    passage: int = 25
    bands: int = 3
    sentence: int = 8
    #: One in so many words ends a paragraph where no sentence does.
    anywhere: int = 32
    line_bands: int = 5
    line_rows: int = 2
    block: int = 1000


def fragments(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each fragment of a text with these words."""
    raw = np.frombuffer(text, np.uint8)
    number = np.cumsum(raw == 10)
    closes = np.append(number[starts[1:]] != number[ends[:-1] - 1], True)
    stop = (_ENDS[raw[ends - 1]] | closes).nonzero()[0]
    near = mix(ids ^ mix(np.append(ids[:1], ids[:-1])))  # of a word and the one before it
    cut = closes | (near % np.uint64(s.anywhere) == 0)
    cut[stop] |= (np.diff(stop, prepend=-1) >= s.sentence) | (near[stop] % np.uint64(8) == 0)
    return _ranges(cut.nonzero()[0], len(ids))


def _ranges(last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each range, from their last words; one beyond any real paragraph is cut, so that a place fits its bits."""
    if n > FEWER:
        last = np.union1d(last, np.arange(FEWER - 1, n, FEWER))
    first = np.concatenate([[0], last[:-1] + 1])
    return first, last - first + 1


def lines(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each line of `least` words or more, and of each block of shorter lines in a row without an empty one between."""
    number = np.cumsum(np.frombuffer(text, np.uint8) == 10)
    steps = np.append(number[starts[1:]] - number[ends[:-1] - 1], 2)
    last = (steps > 0).nonzero()[0]
    short = np.diff(last, prepend=-1) < least
    # a line's end ends a paragraph, but between two short lines of a block
    inside = short & np.append(short[1:], False) & (steps[last] == 1)
    return _ranges(last[~inside], len(ids))


# Odd numbers: a shingle's hash times one of them is another hash of it.
_TURNS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def signatures(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Place and class of the fragments of s.n words or more and then of other paragraphs, their bands (flat), all shingles of the text, and the number of fragments."""
    ids, starts, ends = words(text)
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), 0
    first, count = fragments(ids, starts, ends, text, s)
    line, size = lines(ids, starts, ends, text, s.min_words)
    long = size >= max(s.min_words, s.n)
    line, size = line[long], size[long]
    # a paragraph that is one fragment is marked; every line begins with a fragment
    at = np.searchsorted(first, line)
    single = count[at] == size if len(line) else np.empty(0, bool)
    marked = np.zeros(len(first), np.int64)
    marked[at[single]] = 1
    keep = count >= s.n
    few = int(keep.sum())
    first, count, marked = np.concatenate([first[keep], line[~single]]), np.concatenate([count[keep], size[~single]]), np.concatenate([marked[keep], np.ones(int((~single).sum()), np.int64)])
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), 0
    grams = shingles(ids, s.n)

    def edges(a: int, b: int) -> np.ndarray:
        """For reduceat over [first, first + count - n + 1) of each of a range of places, which may overlap."""
        return np.column_stack([first[a:b], first[a:b] + count[a:b] - s.n + 1]).ravel()

    turn = np.append(mix(grams), np.uint64(0))

    def least(rows: int, edges: np.ndarray) -> np.ndarray:
        """Minimum hashes of each place, a row for each of so many; a bounded number of hashes at a time."""
        step = max(1, 1_000_000 // len(turn))
        return np.concatenate([np.minimum.reduceat(turn * _TURNS[k : min(rows, k + step), None], edges, axis=1)[:, ::2] for k in range(0, rows, step)])

    bands = [mix(least(s.bands, edges(0, few)) + np.arange(s.bands, dtype=np.uint64)[:, None]).T.ravel()] if few else []
    if len(first) > few:
        wide = least(s.line_bands * s.line_rows, edges(few, len(first))).reshape(s.line_bands, s.line_rows, -1)
        band = np.arange(1000, 1000 + s.line_bands, dtype=np.uint64)[:, None]
        for r in range(s.line_rows):
            band = mix(band ^ wide[:, r]) + np.uint64(r)
        bands.append(band.T.ravel())
    # two sums over the paragraph's shingles, the second weighted by their place from its own start
    within = np.arange(len(turn), dtype=np.uint64)
    a, b = (np.add.reduceat(x, edges(0, len(first)))[::2] for x in (turn, turn * within))
    sig = mix(a ^ mix(b - a * first.astype(np.uint64) + count.astype(np.uint64)))
    return (first << (COUNT_BITS + 1)) | (count << 1) | marked, sig.view(np.int64), np.concatenate(bands).view(np.int64), grams, few


def _doc() -> list[Column]:
    """What tells documents apart, in their order."""
    return [F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.xxhash64("text").alias("txt")]


def units(docs: DataFrame, s: Settings) -> DataFrame:
    """key (doc_id, nulls as the smallest number), txt, places, sigs and bands (flat) of every document, as arrays, and its number of fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(*f[:3], f[4]) for f in (signatures(t or b"", s) for t in b.column(2).cast(pa.binary()).to_pylist())]

            def lists(k: int, found=found) -> pa.Array:
                flat = np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[k]) for f in found)]), pa.int32()), pa.array(flat))

            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(0), lists(1), lists(2), pa.array([f[3] for f in found], pa.int32())], ["key", "txt", "places", "sigs", "bands", "fragments"])

    return docs.select(*_doc(), "text").mapInArrow(tidy(run), "key long, txt long, places array<long>, sigs array<long>, bands array<long>, fragments int")


def _band_rows(stored: DataFrame, s: Settings) -> DataFrame:
    """(band, sig) for each paragraph and band."""
    rows = stored.select("sigs", "fragments", F.posexplode("bands").alias("_at", "band"))
    beyond = F.col("_at") - F.col("fragments") * s.bands
    at = F.when(beyond < 0, (F.col("_at") / s.bands).cast("int")).otherwise(F.col("fragments") + (beyond / s.line_bands).cast("int"))
    return rows.select("band", F.get("sigs", at).alias("sig"))


def clusters(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """key, txt, place, sig and cluster (a sig) of every paragraph or fragment whose cluster has another one."""
    s = settings or Settings()
    stored = materialize(units(docs, s), "units")
    # classes that occur twice, and bands that two classes share
    rows = stored.select("key", "txt", F.explode(F.arrays_zip("places", "sigs")).alias("u")).select("key", "txt", F.col("u.places").alias("place"), F.col("u.sigs").alias("sig"))
    at = F.struct("key", "txt", "place")
    twice = materialize(rows.groupBy("sig").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low < high").select("sig"), "twice")
    bands = _band_rows(stored, s)
    own = new_id()
    with scope(own):
        shared = materialize(bands.groupBy("band").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("band"), "bands")
        banded = materialize(bands.join(shared, "band").distinct().select(F.col("band").alias("grp"), "sig"), "banded")
    meet = meeting(banded)
    release(docs.sparkSession, own)
    needed = materialize(meet.select("sig").distinct(), "needed")
    givers = materialize(rows.join(needed, "sig").groupBy("sig").agg(F.min(at).alias("at")).groupBy("at.key", "at.txt").agg(F.collect_list("sig").alias("wanted")), "givers")

    def recomputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for wanted, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                wanted, text = set(wanted), text or b""
                places, sigs, _, grams, _ = signatures(text, s)
                for place, sig in zip(places.tolist(), sigs.tolist(), strict=True):
                    if sig in wanted:
                        wanted.discard(sig)
                        first, count = place >> (COUNT_BITS + 1), place >> 1 & FEWER
                        out.append((sig, np.unique(grams[first : first + count - s.n + 1]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["sig", "tokens"])

    texts = docs.select(*_doc(), "text").join(givers, ["key", "txt"])
    tokens = materialize(texts.select("wanted", "text").mapInArrow(tidy(recomputed), "sig long, tokens binary").dropDuplicates(["sig"]), "tokens")
    links = group_links(meet, lambda wanted: wanted.join(tokens, "sig").select("block", "sig", "tokens"), s.percent, s.block)
    labels = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    known = materialize(twice.join(labels, "sig", "full_outer").select("sig", F.coalesce("cluster", "sig").alias("cluster")), "labels")
    return materialize(rows.join(known, "sig").distinct(), "members")


def find_repeats(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, first_word, n_words, paragraph (else a fragment), cluster_doc, cluster_word (where its cluster begins), removed and run, for each repeated paragraph and fragment of a passage."""
    s = settings or Settings()
    members = clusters(docs, s)
    doc, at = F.struct("key", "txt"), F.struct("key", "txt", "place")
    first = members.groupBy("cluster").agg(F.min(at).alias("kept"), (F.min(doc) < F.max(doc)).alias("across"))
    first = materialize(first.where("across").drop("across"), "kept")
    rows = members.join(first, "cluster").select(
        "key", "txt", F.expr(f"shiftright(place, {COUNT_BITS + 1})").alias("first_word"), F.expr(f"shiftright(place, 1) & {FEWER}").alias("n_words"), F.expr("place & 1 = 1").alias("paragraph"), "kept", (at != F.col("kept")).alias("removed")
    )
    # runs of paragraphs that follow each other in their document, but for fewer than 2 * n words between
    by_doc = Window.partitionBy("key", "txt").orderBy("first_word", "n_words")
    end = F.col("first_word") + F.col("n_words")
    ended = F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_gap", F.coalesce((F.col("first_word") - ended >= 2 * s.n).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_gap").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("key", "txt", "_run")
    runs = runs.withColumn("run", F.max(end).over(whole) - F.min("first_word").over(whole)).where(F.col("paragraph") | (F.col("run") >= s.passage))
    null = F.lit(NULL_KEY)
    return runs.select(
        F.nullif("key", null).alias("doc_id"), "first_word", "n_words", "paragraph", F.nullif(F.col("kept.key"), null).alias("cluster_doc"), F.expr(f"shiftright(kept.place, {COUNT_BITS + 1})").alias("cluster_word"), "removed", "run"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
