"""Operator 6: token ids as flat binary files that are read back memory-mapped.

Documents are dealt into key ranges and sorted, so every task writes one part of the corpus in ascending doc_id order:

    tokens-PPPPPP.u16    all ids of the part, little-endian unsigned integers, 16-bit if every id of the vocabulary fits,
                         else 32-bit (.u32); documents end with end_id
    offsets-PPPPPP.u64   rows + 1 little-endian unsigned 64-bit integers: where each document begins in the part
    keys-PPPPPP.i64      the documents' ids in the same order; a null id is the smallest integer

A task writes under a name of its own attempt and renames, so a repeated or speculative attempt leaves the same whole
files. The manifest has a row for each part (part, width in bytes, documents, tokens, first_token, first_document); its two bases are
prefix sums over the parts, so any document's global position is its part's base plus its own offset.

Tokenisation works on words between white space, which the tokenizer's normaliser drops, so a word's ids never depend on
its neighbours, nor do those of its letters on marks after them; they are kept in a cache of a bounded number of bytes.
Texts with separators that Python and the tokenizer disagree on are encoded whole, and so is every text by a tokenizer of
another normaliser or split.

Defined results: a null text is an empty one, so it has the end id alone; an empty table has no parts; repeated rows and
repeated ids are documents of their own, ordered by id and then by text; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import materialize, new_id, scratch_path, table
from skerry.llm.workers import kept, tidy

#: What a worker's cache of words may hold, in bytes, of which an entry takes so many besides its word and ids.
CACHE_BYTES, ENTRY_BYTES = 96_000_000, 160
READ_DOCS = 20_000
#: Bytes of one part; and a size from which an estimate is none (some plans have no statistics).
PART_BYTES, UNKNOWN_BYTES = 128 << 20, 1 << 60
NULL_KEY = -(2**63)
# The normaliser and the split into words, in the tokenizer's own form, under which a word's ids never depend on its neighbours.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Separators for Python's split() that aren't white space for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
#: ASCII marks that a tokenizer of words separates from letters before them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _filesystem(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def _letters(core: str) -> bool:
    """Whether a word is letters and stays so when the tokenizer normalises it."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())


class _Words(dict):
    """word -> its ids as bytes, until they take more than a bounded number of bytes."""

    def __init__(self, tokenizer: str, kind: str) -> None:
        # a task has one core; threads of the library's own only cost time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.taken = Tokenizer.from_str(tokenizer), kind, 0
        parts = json.loads(tokenizer)
        self.by_words = all(parts.get(k) == v for k, v in BY_WORDS.items())
        suffix, vocabulary = parts["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids end a run of letters or of marks.
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def ids(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, words: list[str]) -> None:
        """The ids of words that are one run of letters or marks each, told apart by the ids that end one."""
        # the fast form keeps no offsets
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._encoded(words)
            return
        raw, width, low = ids.tobytes(), ids.itemsize, 0
        for word, high in zip(words, (ends * width).tolist(), strict=True):
            self._put(word, raw[low:high])
            low = high

    def _encoded(self, words: list[str]) -> None:
        """The ids of words, told apart by where in their joint text they come from."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        ids, at = np.array(got.ids, self.kind), np.array([x for x, _ in got.offsets], np.int64)
        edges = np.searchsorted(at, starts)
        for word, low, high in zip(words, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self._put(word, ids[low:high].tobytes())

    def _put(self, word: str, ids: bytes) -> None:
        self.taken += ENTRY_BYTES + 2 * len(word) + len(ids)
        self[word] = ids

    def _learn(self, words: set[str]) -> None:
        runs, new, made = set(), set(), []
        for word in words:
            core = word.rstrip(_MARKS)
            if core == word and word.isascii():
                core = word.lower()
            if core != word and _letters(core):  # letters and marks after them are tokenised apart
                parts = (core, word[len(core) :]) if len(core) < len(word) else (core,)
                made.append((word, parts))
                runs.update(x for x in parts if x not in self)
            elif _letters(word):
                runs.add(word)
            else:
                new.add(word)
        if runs:
            self._runs(list(runs))
        if new := {w for w in new if w not in self}:
            self._encoded(list(new))
        for word, parts in made:
            self._put(word, b"".join(map(self.__getitem__, parts)))

    def encode(self, text: str) -> bytes:
        if not self.by_words or _ODD.search(text):
            return self.ids(text)
        if self.taken > CACHE_BYTES:
            self.clear()
            self.taken = 0
        words = text.split()
        if unknown := set(filterfalse(self.__contains__, set(words))):
            self._learn(unknown)
        return b"".join(map(self.__getitem__, words))


def vocabulary_size(tokenizer_json: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()) + 1


def _parts(docs: DataFrame) -> int:
    """Parts of some PART_BYTES of stored text, and as many as shuffles have at least; the planner's own estimate needs no pass."""
    size = int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // PART_BYTES + 1) if size < UNKNOWN_BYTES else least


def write(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Write the files of docs into folder, which tasks and driver share, and return the manifest."""
    spark = docs.sparkSession
    parts = parts or _parts(docs)
    words, job = spark.sparkContext.broadcast(tokenizer_json), new_id()
    wide = max(vocabulary_size(tokenizer_json), end_id + 1) > 2**16
    kind, width, suffix = ("I", 4, "u32") if wide else ("H", 2, "u16")
    end = array(kind, [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        task = TaskContext.get()
        part, own = task.partitionId(), f".{task.taskAttemptId()}"
        encoder, offsets, keys, at = None, [0], [], 0
        names = {k: f"{path}/{k.split('.')[0]}-{part:06d}.{k.split('.')[1]}" for k in (f"tokens.{suffix}", "offsets.u64", "keys.i64")}
        tokens = None
        for b in batches:
            if encoder is None:
                fs.create_dir(path, recursive=True)
                encoder, tokens = kept(job, lambda: _Words(words.value, kind)), fs.open_output_stream(names[f"tokens.{suffix}"] + own)
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                tokens.write(ids)
                at += len(ids) // width
                offsets.append(at)
                keys.append(NULL_KEY if key is None else key)
        if tokens is None:
            return
        tokens.close()
        for name, data in (("offsets.u64", np.array(offsets, "<u8")), ("keys.i64", np.array(keys, "<i8"))):
            with fs.open_output_stream(names[name] + own) as f:
                f.write(data.tobytes())
        for name in names.values():
            fs.move(name + own, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "width": pa.array([width], pa.int32()), "documents": pa.array([len(keys)], pa.int64()), "tokens": pa.array([at], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    written = materialize(ordered.mapInArrow(run, "part int, width int, documents long, tokens long"), "manifest")
    # one row a part: the window is over as many rows as there are parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumns({"first_token": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "first_document": F.coalesce(F.sum("documents").over(before), F.lit(0))})


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, and part; tasks map the parts they read into memory."""

    def mapped(name: str, kind: str) -> np.ndarray:
        fs, path = _filesystem(folder)
        if fs.type_name == "local":
            return np.memmap(f"{path}/{name}", kind, "r") if os.path.getsize(f"{path}/{name}") else np.empty(0, kind)
        with fs.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read_buffer(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, width, base in zip(*(b.column(c).to_pylist() for c in ("part", "width", "first_token")), strict=True):
                ids, offsets, keys = mapped(f"tokens-{part:06d}.u{8 * width}", f"<u{width}"), mapped(f"offsets-{part:06d}.u64", "<u8").astype(np.int64), mapped(f"keys-{part:06d}.i64", "<i8")
                for i in range(0, len(keys), READ_DOCS):
                    own, at = np.array(keys[i : i + READ_DOCS]), offsets[i : i + READ_DOCS + 1]
                    sums = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_KEY), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64()), pa.array(np.full(len(own), part, np.int32))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("part", "width", "first_token").repartition(n, "part").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def tokens_of(folder: str, part: int, row: int, width: int) -> np.ndarray:
    """The ids of one document, mapped from its part's files; for readers outside Spark."""
    path = _filesystem(folder)[1]
    at = np.memmap(f"{path}/offsets-{part:06d}.u64", "<u8", "r")[row : row + 2]
    return np.memmap(f"{path}/tokens-{part:06d}.u{8 * width}", f"<u{width}", "r")[int(at[0]) : int(at[1])]


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = materialize(write(table(spark, sf_dir, "documents"), folder, default_tokenizer()), "bases")
    return read(manifest, folder)
