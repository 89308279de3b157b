"""Operator 12: document fingerprints by a randomised edit embedding.

Shared random walks take every text to a string of characters at places 0, 1, ...: at each place the walk writes the
character it stands at, and a bit drawn for that place and character, the same for all texts, tells whether it moves on to the
next. Two texts a few edits apart soon walk in step again after an edit, so that their edit distance becomes a Hamming
distance. A fingerprint samples bits of that string: of every block of 2**level places one place is kept, with four bits
drawn for the place and the character there. The level depends on the length of the text, so that a fingerprint has some
`samples` places a walk whatever the length. The place kept of a block is one of those kept of its two halves, so
fingerprints of different levels are compared at the coarser one.

Likeness is the share of equal samples, less what unlike characters agree on by chance; the better of the walks counts.
Banding hashes a few sampled places into each band. near_documents() compares only texts that share a band, and verifies
them by all their samples; groups of any size are compared in blocks of bounded size.

Texts are walked once, in the task that reads them in the order of their ids, many side by side; the walk over an edited
text goes on from where that over its beginning stood. The first and last row of every part of the order are finished in a
second, small step.

Defined results: a null text is an empty one, whose fingerprint has no samples; two texts without samples are alike (1),
one without is unlike any other (0). Rows are documents of their own, those of one id in the order of their text's hash
(a null id is the first); the next of the last is the first, and of a lone row the row itself. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm import blocks
from skerry.llm.common import materialize, scratch_path, table
from skerry.llm.components import connected_components
from skerry.llm.hashing import mix
from skerry.llm.workers import tidy

#: Places after which the drawn bits repeat; kinds of characters that walks tell apart; values of a sample.
PERIOD, KINDS, VALUES = 1 << 10, 16, 16
#: Characters that a walk takes in one step, and the longest stay at one.
STRIDE, STAY = 3, 80
#: Documents whose walks go side by side have so many characters in all; where at most FEW are left, each goes on alone.
TOGETHER, FEW = 4_000_000, 48
#: What stands for places after the end.
NONE = 255
_DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_bands int, next_bands int"
#: How a row leaves the ordered pass: finished; the last of its part, without a next; a copy of the first of its part.
DONE, LAST, FIRST = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """samples and walks size a fingerprint; bands of `width` samples make candidates; percent is the likeness of near documents."""

    samples: int = 128
    walks: int = 2
    bands: int = 24
    width: int = 6
    percent: int = 80
    block: int = 1000
    seed: int = 12


def _drawn(n: int, seed: int) -> np.ndarray:
    return mix(mix(np.arange(n, dtype=np.uint64) + np.uint64(1)) ^ mix(np.array([seed], np.uint64)))


@functools.cache
def _kept_places(level: int, n: int) -> np.ndarray:
    """The places kept of the first n blocks of 2**level places."""
    at = np.arange(n, dtype=np.int64)
    for x in range(level, 0, -1):
        at = 2 * at + _chosen_half(x, at)
    return at


def _chosen_half(level: int, block: np.ndarray) -> np.ndarray:
    """0 or 1 for each block: the half whose place it keeps."""
    return (mix(mix(block.astype(np.uint64) + np.uint64(1)) ^ np.uint64(level)) & np.uint64(1)).astype(np.int64)


@functools.cache
def _chosen_of_two(level: int, n: int) -> np.ndarray:
    """For the first n blocks of a level, the number of the half whose place it keeps."""
    block = np.arange(n)
    return 2 * block + _chosen_half(level, block)


def codes(text: str) -> np.ndarray:
    """The kind of each character, by a hash of its number."""
    point = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _KIND[point] if text.isascii() else np.where(point < len(_KIND), _KIND[np.minimum(point, len(_KIND) - 1)], (mix(point.astype(np.uint64)) % np.uint64(KINDS)).astype(np.uint8))


_KIND = (mix(np.arange(256, dtype=np.uint64)) % np.uint64(KINDS)).astype(np.uint8)


@dataclass
class Trail:
    """Where walk w was before every stride of a text, and after the last whole one."""

    walker: Walker
    w: int
    kinds: np.ndarray
    at: np.ndarray

    def place(self, n: int) -> int:
        """Where it is after n characters."""
        stay, now = self.walker.stay[self.w], int(self.at[n // STRIDE])
        for kind in self.kinds[n - n % STRIDE : n].tolist():
            now += int(stay[kind, now & (PERIOD - 1)])
        return now

    def samples(self, level: int, n: int | None = None) -> np.ndarray:
        """The samples of its first n characters, all if None is given."""
        n = len(self.kinds) if n is None else n
        start, end, stay = int(self.at[0]), self.place(n), self.walker.stay[self.w]
        first, last = start >> level, (end >> level) + 1
        kept = _kept_places(level, 1 << last.bit_length())[first:last]
        kept = kept[(kept >= start) & (kept < end)]
        # the stride that holds each place, and within it the character
        stride = np.searchsorted(self.at, kept, "right") - 1
        here, index = self.at[stride], stride * STRIDE
        kind = self.kinds[index]
        for _ in range(STRIDE - 1):
            further = here + stay[kind, here & (PERIOD - 1)]
            on = kept >= further
            here, index = np.where(on, further, here), index + on
            kind = self.kinds[index]
        return self.walker.value[self.w, kind, kept & (PERIOD - 1)]


@dataclass(frozen=True)
class Fingerprint:
    level: int
    samples: tuple[np.ndarray, ...]

    def text(self) -> str:
        """Level and length of a walk's samples, then the samples, each a hexadecimal digit."""
        return ".".join([f"{self.level:x}", *(_DIGIT[x].tobytes().decode() for x in self.samples)])

    def at_level(self, level: int) -> list[np.ndarray]:
        out = list(self.samples)
        for x in range(self.level + 1, level + 1):
            for w, own in enumerate(out):
                own = np.append(own, np.uint8(NONE))
                out[w] = own[_chosen_of_two(x, 1 << len(own).bit_length())[: len(own) // 2]]
        return out


class Walker:
    """The shared walks: for each walk, kind and place, how long a character stays, and the four bits of a sample."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        bit = (_drawn(s.walks * KINDS * PERIOD, s.seed) & np.uint64(1)).reshape(s.walks, KINDS, PERIOD).astype(bool)
        stay, now = np.zeros(bit.shape, np.uint8), np.ones(bit.shape[:2], np.int64)
        for p in range(2 * PERIOD - 1, -1, -1):  # round twice, as the first round begins at an open end
            now = np.where(bit[:, :, p % PERIOD], 1, np.minimum(now + 1, STAY))
            stay[:, :, p % PERIOD] = now
        self.stay = stay
        self.strides = np.stack([self._strides(walk) for walk in stay])
        self.value = (_drawn(bit.size, s.seed + 1) % np.uint64(VALUES)).astype(np.uint8).reshape(bit.shape)
        self.pick = (_drawn(s.bands * s.width, s.seed + 2) % np.uint64(s.samples * s.walks)).astype(np.int64).reshape(s.bands, s.width)
        self.drawn = _drawn(256, s.seed + 4)  # of a sample in a band
        self.factor = _drawn(s.bands * s.width, s.seed + 3).reshape(s.bands, s.width) | np.uint64(1)

    @staticmethod
    def _strides(stay: np.ndarray) -> np.ndarray:
        """For each STRIDE kinds in a row and each place: how far the walk goes over them."""
        places, total = np.arange(PERIOD), np.zeros((1, PERIOD), np.int64)
        for _ in range(STRIDE):
            more = stay[:, (places + total) & (PERIOD - 1)]  # kind, kinds before, place
            total = (total[:, None, :] + np.moveaxis(more, 0, 1)).reshape(-1, PERIOD)
        return total.astype(np.uint8)

    def level(self, n: int) -> int:
        """Texts of n characters fill some 2 n places."""
        level = 0
        while 2 * n > self.s.samples << level:
            level += 1
        return level

    def walk(self, kinds: list[np.ndarray], walks: np.ndarray, places: np.ndarray) -> list[Trail]:
        """Walks over texts from given places on, side by side: one step takes a stride of every text that is left."""
        n = np.array([len(x) // STRIDE for x in kinds], np.int64)
        taken = np.concatenate([x[: STRIDE * k] for x, k in zip(kinds, n.tolist(), strict=True)]).reshape(-1, STRIDE).astype(np.int32) if len(n) else np.empty((0, STRIDE), np.int32)
        packed = (taken[:, 0] * KINDS + taken[:, 1]) * KINDS + taken[:, 2]
        begin = np.concatenate([[0], n.cumsum()])
        at = np.empty(begin[-1] + len(n), np.int64)
        order = np.argsort(-n, kind="stable")
        left = np.cumsum(np.bincount(n)[::-1])[::-1] if len(n) else n  # texts of at least so many strides
        table, row = self.strides.reshape(-1), walks[order] * KINDS**STRIDE
        source, target, now = begin[:-1][order], (begin[:-1] + np.arange(len(n)))[order], places[order].astype(np.int64)
        step, active = 0, len(n)
        at[target] = now
        while step + 1 < len(left) and left[step + 1] > FEW:
            active = int(left[step + 1])
            here = now[:active]
            here += table[(row[:active] + packed[source[:active] + step]) * PERIOD + (here & (PERIOD - 1))]
            step += 1
            at[target[:active] + step] = here
        for k in np.flatnonzero(n[order] > step).tolist():
            rows = self.strides[walks[order[k]]]
            one = lambda place, c, rows=rows: place + int(rows[c, place & (PERIOD - 1)])
            own = accumulate(packed[source[k] + step : source[k] + n[order[k]]].tolist(), one, initial=int(now[k]))
            at[target[k] + step : target[k] + n[order[k]] + 1] = np.fromiter(own, np.int64)
        starts = (begin + np.arange(len(begin))).tolist()
        return [Trail(self, int(w), x, at[a:b]) for w, x, a, b in zip(walks.tolist(), kinds, starts[:-1], starts[1:], strict=True)]

    def trails(self, texts: list[np.ndarray]) -> list[list[Trail]]:
        """All walks over each text."""
        many = [x for x in texts for _ in range(self.s.walks)]
        found = self.walk(many, np.tile(np.arange(self.s.walks), len(texts)), np.zeros(len(many), np.int64))
        return [found[i : i + self.s.walks] for i in range(0, len(found), self.s.walks)]

    def fingerprint(self, text: str) -> Fingerprint:
        level = self.level(len(text))
        return Fingerprint(level, tuple(t.samples(level) for t in self.trails([codes(text)])[0]))

    def bands(self, f: Fingerprint, level: int) -> np.ndarray:
        """A hash for each band of the samples at a level; places after the end count as a value of their own."""
        padded = np.full((self.s.walks, self.s.samples), NONE, np.uint8)
        for w, own in enumerate(f.at_level(level)):
            padded[w, : len(own)] = own[: self.s.samples]
        return (self.drawn[padded.reshape(-1)[self.pick]] * self.factor).sum(axis=1, dtype=np.uint64) + np.uint64(level)

    def common_bands(self, a: Fingerprint, b: Fingerprint) -> int:
        level = max(a.level, b.level)
        return int((self.bands(a, level) == self.bands(b, level)).sum())


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of characters that agree in the embedding, 0 to 1, estimated from the samples at the coarser level."""
    level, best = max(a.level, b.level), 0.0
    for x, y in zip(a.at_level(level), b.at_level(level), strict=True):
        both, most = min(len(x), len(y)), max(len(x), len(y))
        equal = int((x[:both] == y[:both]).sum())
        share = equal / most if most else 1.0
        best = max(best, 1.0 if not most else (share - 1 / VALUES) / (1 - 1 / VALUES))
    return min(1.0, best)


def _results(walker: Walker, rows: list[tuple[int | None, str]], nexts: list[str]) -> list[tuple]:
    """A result for each (doc_id, text) and the text after it."""
    s = walker.s
    texts = list(dict.fromkeys([t for _, t in rows] + nexts))
    number, kinds = {t: i for i, t in enumerate(texts)}, [codes(t) for t in texts]
    trails = walker.trails(kinds)
    prints = [Fingerprint(level, tuple(t.samples(level) for t in own)) for own, level in ((own, walker.level(len(t))) for own, t in zip(trails, texts, strict=True))]
    pairs = list(dict.fromkeys(zip((number[t] for _, t in rows), map(number.__getitem__, nexts), strict=True)))
    keep = [len(texts[a]) - len(texts[a]) // 2 for a, _ in pairs]
    # the walk over an edited text goes on from where that over its beginning stood
    tails = [kinds[b][: len(texts[a]) // 2] for a, b in pairs for _ in range(s.walks)]
    stood = np.array([trails[a][w].place(n) for (a, _), n in zip(pairs, keep, strict=True) for w in range(s.walks)], np.int64)
    ends = walker.walk(tails, np.tile(np.arange(s.walks), len(pairs)), stood)
    found = {}
    for i, ((a, b), n) in enumerate(zip(pairs, keep, strict=True)):
        edited = texts[a][:n] + texts[b][: len(texts[a]) // 2]
        level = walker.level(len(edited))
        changed = Fingerprint(level, tuple(np.concatenate([trails[a][w].samples(level, n), ends[i * s.walks + w].samples(level)]) for w in range(s.walks)))
        likes = likeness(prints[a], changed), likeness(prints[a], prints[b])
        bands = walker.common_bands(prints[a], changed), walker.common_bands(prints[a], prints[b])
        found[a, b] = (len(texts[a]), hashlib.sha256(edited.encode()).hexdigest(), prints[a].text(), changed.text(), *likes, *bands)
    return [(doc_id, *found[number[t], number[x]]) for (doc_id, t), x in zip(rows, nexts, strict=True)]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_bands", pa.int32()), ("next_bands", pa.int32())]
_MORE = [("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def with_edits(docs: DataFrame, settings: Settings | None = None, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is replaced by the beginning of the next document."""
    s, spark = settings or Settings(), docs.sparkSession
    nothing = (None,) * len(_FIELDS[1:])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, part, held, size = Walker(s), TaskContext.get().partitionId(), [], 0

        def done() -> pa.RecordBatch:
            rows = [(*r, DONE, part, None) for r in _results(walker, held[:-1], [t for _, t in held[1:]])]
            del held[:-1]
            return _batch(rows, _FIELDS + _MORE)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if not held:
                    yield _batch([(doc_id, *nothing, FIRST, part, text)], _FIELDS + _MORE)
                held.append((doc_id, text))
                size += len(text) + 100
                if size > TOGETHER and len(held) > 1:
                    yield done()
                    size = len(text)
        if len(held) > 1:
            yield done()
        if held:
            yield _batch([(held[0][0], *nothing, LAST, part, held[0][1])], _FIELDS + _MORE)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(s)
        for batch in batches:
            for doc_id, text, next_text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                yield _batch(_results(walker, [(doc_id, text)], [next_text]), _FIELDS)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # rows equal in both may lie in several parts, as a number drawn for each row parts them
    ranged = docs.select("doc_id", "text").repartitionByRange(parts or shuffle_parts(spark), *order, F.rand(s.seed)).sortWithinPartitions(*order)
    path = scratch_path(spark, "fingerprints")
    marked = ranged.mapInArrow(tidy(ordered), f"{RESULT}, kind int, part int, text string")
    marked.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(marked.schema).parquet(path)
    # two rows a part, without their texts in the window
    first = stored.where(F.col("kind") == FIRST)
    follows = first.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy()).alias("least"))
    heads = follows.select("part", F.coalesce("next", "least").alias("next")).join(first.select(F.col("part").alias("next"), F.col("text").alias("next_text")), "next")
    open_ = stored.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(heads.select("part", "next_text"), "part")
    return stored.where(F.col("kind") == DONE).select([name for name, _ in _FIELDS]).union(open_.select("doc_id", "text", "next_text").mapInArrow(tidy(joined), RESULT))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def near_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id and component_id of every row: the smallest id that near documents lead to.

    A text takes part at its own level and the next coarser one, so that texts of about the same length meet at one. Texts
    that share a band are compared by all their samples there; candidates are found with a probability that grows with their
    likeness. Null and empty texts are near nothing, not even each other."""
    s = settings or Settings()
    # of the samples, this share of the joint set agrees where so many per cent of the characters do
    raw = 1 / VALUES + (1 - 1 / VALUES) * s.percent / 100
    percent = int(100 * raw / (2 - raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(s)
        for batch in batches:
            out = []
            # one text at a time, as a batch may have any number of characters
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                f = walker.fingerprint(text.as_py())
                for level in (f.level, f.level + 1):
                    tokens = [mix(mix(np.arange(len(x), dtype=np.uint64) * np.uint64(64) + np.uint64(w)) + x) ^ np.uint64(level) for w, x in enumerate(f.at_level(level))]
                    tokens = [t[x != NONE] for t, x in zip(tokens, f.at_level(level), strict=True)]
                    sig = int(mix(np.array([key], np.int64).view(np.uint64) + np.uint64(level)).view(np.int64)[0])
                    out.append((key, sig, np.unique(np.concatenate(tokens)).tobytes(), walker.bands(f, level).view(np.int64).tolist()))
            if out:
                yield _batch(out, [("key", pa.int64()), ("sig", pa.int64()), ("tokens", pa.binary()), ("bands", pa.list_(pa.int64()))])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where("length(text) > 0")
    least = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("least")), "least")
    prints = materialize(keyed.dropDuplicates(["key"]).select("key", "text").mapInArrow(tidy(run), "key long, sig long, tokens binary, bands array<long>"), "prints")
    meet = blocks.meeting(prints.select(F.explode("bands").alias("grp"), "sig").distinct())
    sets = lambda wanted: wanted.join(prints.select("sig", "tokens"), "sig").select("block", "sig", "tokens")
    links = blocks.group_links(meet, sets, percent, s.block)
    same = prints.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("b"))
    joint = connected_components(links.union(same.select("a", "b")))
    classes = prints.groupBy("key").agg(F.min("sig").alias("node")).join(joint, "node").select("key", "component")
    smallest = materialize(classes.join(least, "key").groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    by_key = classes.join(smallest, "component").select("key", "component_id")
    return docs.select("doc_id", F.when(F.length("text") > 0, F.xxhash64("text")).alias("key")).join(by_key, "key", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
