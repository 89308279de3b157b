"""Operator 4: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are what stands between ASCII white space, without punctuation around it and in lower case. A first pass counts
every n-gram of the test items over all documents. In each run of `window` neighbouring n-grams of an item the rarest one
is a seed, so a common phrase seeds only where nothing rarer stands near, and every copied stretch of n + window - 1 words
has a seed however often it occurs. A second pass looks for the seeds in whole texts, and the passage around each hit is
aligned with the item; (score / best possible score) >= min_similarity is a leak, which edits, gaps and inserted words
lower step by step. The alignment holds two rows of scores, so its memory is that of the passage alone.

Items are taken in blocks of at most `block_words` words, each one sent to the tasks with its seeds, of which it has no more
than words; both passes are made for every block. The documents are never shuffled or collected.

Defined results: null and empty texts leak nothing; items without n words have no seed and match nothing; repeated
documents are reported each; repeated items each give their row, equal rows of them once; null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import table
from skerry.llm.workers import tidy

CACHE_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BITS = np.uint64((1 << 20) - 1)


@dataclass(frozen=True)
class Settings:
    n: int = 3
    window: int = 4
    min_similarity: float = 0.5
    block_words: int = 1_000_000


class WordIds(dict):
    """word -> 64-bit hash of its bare lower-case form; 0 for bare punctuation."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare = word.strip(_EDGES).decode(errors="replace").lower()
        self[word] = value = xxhash.xxh64_intdigest(bare) if bare else 0
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        ids = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return ids[ids != 0]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n neighbouring words."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : len(ids) - n + 1 + k]) * _M[k % 3]
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """Which of many hashes are among a set: a bit table first, then a search."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = np.unique(members)
        self.bits = np.zeros(int(_BITS) + 1, bool)
        self.bits[(self.members & _BITS).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = self.bits[(hashes & _BITS).astype(np.int64)].nonzero()[0]
        if len(at):
            found = hashes[at]
            k = np.minimum(np.searchsorted(self.members, found), len(self.members) - 1)
            at = at[self.members[k] == found]
        return at


def _rows(item: np.ndarray, passage: np.ndarray, least: int | None) -> Iterator[np.ndarray]:
    """Row by row, the scores of alignments that end with this word of the item and each of the passage.

    With least 0 they begin anywhere; with None at the beginning of both. Only two rows are held."""
    ramp = np.arange(len(passage) + 1, dtype=np.int64) * -GAP
    above = np.zeros(len(passage) + 1, np.int64) if least == 0 else -ramp
    for w in item:
        row = above + GAP
        np.maximum(row[1:], above[:-1] + np.where(passage == w, MATCH, MISMATCH), out=row[1:])
        if least is not None:
            np.maximum(row, least, out=row)
        above = np.maximum.accumulate(row + ramp) - ramp
        yield above


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: its score and the passage's words from first to after the last; the first end and the shortest passage of equal ones."""
    best, rows, end = 0, 0, 0
    for i, row in enumerate(_rows(item, passage, 0), 1):
        j = int(row.argmax())
        if row[j] > best:
            best, rows, end = int(row[j]), i, j
    # the same backwards from that end gives the beginning
    size = end
    for row in _rows(item[:rows][::-1], passage[:end][::-1], None):
        hit = (row[: size + 1] == best).nonzero()[0]
        if len(hit):
            size = int(hit[0])
    return best, end - size, end


class Searcher:
    """Finds the leaks of one block of items in a text."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seeds: list[tuple[int, int, int]], s: Settings) -> None:
        self.items, self.s = items, s
        self.at = defaultdict(list)
        for gram, item, offset in seeds:
            self.at[gram].append((item, offset))
        self.seeds = Filter(np.array(list(self.at), np.uint64))
        self.words = WordIds()

    def find(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(index of the item, similarity, first word, word after the last) of each item that leaks, at its best place."""
        ids = self.words.of(text or b"")
        hashes = grams(ids, self.s.n)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in self.seeds.hits(hashes).tolist():
            for item, offset in self.at[int(hashes[at])]:
                size = len(self.items[item][1])
                slack = size // 4 + 5
                low, high = max(0, at - offset - slack), min(len(ids), at - offset + size + slack)
                spans = near[item]
                if spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        found = []
        for item, spans in near.items():
            own = self.items[item][1]
            need = self.s.min_similarity * MATCH * len(own)
            best = (0, 0, 0)
            for low, high in spans:
                passage = ids[low:high]
                # no alignment scores more than its matching words, on either side
                if MATCH * min(int(np.isin(passage, own).sum()), int(np.isin(own, passage).sum())) < need:
                    continue
                score, first, end = align(own, passage)
                if score > best[0]:
                    best = (score, low + first, low + end)
            if best[0] and best[0] >= need:
                found.append((item, best[0] / (MATCH * len(own)), best[1], best[2]))
        return found


def rare_seeds(items: list[tuple[int, np.ndarray]], counts: dict[int, int], s: Settings) -> list[tuple[int, int, int]]:
    """(gram, item, offset) of the rarest n-gram in each run of s.window, the first of equals."""
    out = set()
    for k, (_, ids) in enumerate(items):
        own = [(counts.get(int(g), 0), i, int(g)) for i, g in enumerate(grams(ids, s.n))]
        for i in range(max(1, len(own) - s.window + 1) if own else 0):
            _, at, g = min(own[i : i + s.window])
            out.add((g, k, at))
    return sorted(out)


def _blocks(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The test items, a bounded number of words at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = int(words // s.block_words) + 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        known = WordIds()
        if block := [(r[0], ids) for r in rows if len(ids := known.of(r[1].encode())) >= s.n]:
            yield block


def searchers(docs: DataFrame, benchmark: DataFrame, s: Settings) -> Iterator[Searcher]:
    """One searcher for each block of items, with seeds by the n-grams' counts over all of docs."""
    for items in _blocks(benchmark, s):
        every = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([grams(ids, s.n) for _, ids in items])))

        def count(batches: Iterator[pa.RecordBatch], every=every) -> Iterator[pa.RecordBatch]:
            known, test = WordIds(), Filter(every.value)
            total = np.zeros(len(test.members), np.int64)
            for b in batches:
                for text in b.column(0).cast(pa.binary()).to_pylist():
                    hashes = grams(known.of(text or b""), s.n)
                    at = test.hits(hashes)
                    if len(at):
                        np.add.at(total, np.searchsorted(test.members, hashes[at]), 1)
            seen = total.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(test.members[seen].view(np.int64)), pa.array(total[seen])], ["gram", "n"])

        # as many rows as the block has n-grams
        counts = docs.select("text").mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n")).collect()
        yield Searcher(items, rare_seeds(items, {g % 2**64: n for g, n in counts}, s), s)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, item_id, similarity, first_word and last_word for every document and item that it leaks."""
    s = settings or Settings()
    schema = "doc_id long, item_id long, similarity double, first_word long, last_word long"
    out = None
    for searcher in searchers(docs, benchmark, s):
        sent = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    rows += [(doc, own.items[k][0], similarity, low, high - 1) for k, similarity, low, high in own.find(text)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "last_word"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs, all their columns, that leak no item."""
    kept = docs
    for searcher in searchers(docs, benchmark, settings or Settings()):
        sent, at = docs.sparkSession.sparkContext.broadcast(searcher), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not sent.value.find(text) for text in b.column(at).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(tidy(run), docs.schema)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
