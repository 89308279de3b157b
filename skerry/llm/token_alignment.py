"""Operator 11: alignment of two tokenizers' tokens by a sweep over the events of their ends.

Every token is an event: the byte offset in its document where it ends, its side (A or B) and its id. The events of both
sides are united, dealt out by document and sorted by offset within a task, where one state machine streams through
them: it holds the tokens since the last offset where both sides ended, and emits a group and a link at every such offset.
Events travel packed, a row for all of one side that end in one window of a document, so that a row costs some bytes a
token; a document of any length is a stream of such rows, and a task's state is one window and the open group.

The state machine also emits each window's linked pairs of ids with how often they stand. Their counts over the corpus are
one aggregation, combined on the map side. While there are at most `broadcast_pairs` of them they are sent to all tasks
(16 bytes each); beyond it the documents' pairs are joined with them by a shuffle. Both give the same rows.

Defined results: a null or an empty text, and one that either side can't give back byte for byte, has no tokens: zeros and
an empty digest. Rows are documents of their own, also with equal or null ids. Texts of more than `piece` characters are
encoded in pieces, cut at a single space between ASCII letters, where neither side has a token across. Other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import new_id, scratch_path, table
from skerry.llm.workers import kept, tidy

EVENTS = "row long, at long, side int, doc_id long, n int, data binary"
ALIGNED = "row long, last boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, size int, pairs binary, times binary"
#: Rows of one output batch; pairs that a task sums up before it hands them on.
OUT_ROWS, SUM_PAIRS = 2000, 4_000_000
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Settings:
    window: int = 1 << 13
    piece: int = 1 << 20
    broadcast_pairs: int = 2_000_000


def _byte_level() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer in a worker: the ids of a text, and the bytes of every id."""

    bytes: list[bytes]

    def __init__(self, file: bytes) -> None:
        raise NotImplementedError

    def ids(self, text: str) -> list[int]:
        """The ids of a space and the text."""
        raise NotImplementedError

    def encode(self, text: str, piece: int) -> np.ndarray | None:
        """The ids of a text, None if their bytes aren't those of a space and the text."""
        ids = [np.array(self.ids(x), np.uint32) for x in pieces(text, piece)]
        ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
        return ids if b"".join(map(self.bytes.__getitem__, ids.tolist())) == b" " + text.encode() else None


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in parts of some `size` characters, without the spaces at which it is cut."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


# Fixed value: how byte-level vocabularies split a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of characters whose kind no version of Unicode has changed; others are left to the library of the file.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]*")


class ByteLevel(Side):
    """A tokenizer of the tokenizers library with byte-level pieces; a space is put before every text.

    Where the file's merges are in the order of their ids and its split is the usual one, plain texts go through the faster
    tiktoken with the file's own vocabulary, which gives the same ids."""

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        byte, vocabulary = _byte_level(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.fast = self._faster(json.loads(file), byte, vocabulary)

    def _faster(self, parts: dict, byte: dict[str, int], vocabulary: dict[str, int]):
        special = {t["content"] for t in parts.get("added_tokens", [])}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in parts["model"].get("merges", [])]
        in_order = [vocabulary[m] for m in merged] == list(range(len(byte), len(byte) + len(merged)))
        pre = parts.get("pre_tokenizer") or {}
        usual = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        if not (in_order and usual and parts.get("normalizer") is None and parts["model"].get("dropout") is None):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class Pieces(Side):
    """A model of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, file: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        tokens = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.bytes = [bytes([int(_BYTE.fullmatch(t)[1], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(tokens)]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def _packed(values: np.ndarray) -> bytes:
    """Numbers in few bytes: all their first bytes, all their second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def events(docs: DataFrame, a: tuple[type[Side], bytes], b: tuple[type[Side], bytes], s: Settings) -> DataFrame:
    """The end events of both sides, a row for each window and side; a document without tokens has one row without events."""
    files, job = docs.sparkSession.sparkContext.broadcast((a[1], b[1])), new_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = kept(job, lambda: [kind(file) for kind, file in zip((a[0], b[0]), files.value, strict=True)])
        lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in sides]
        row, out = TaskContext.get().partitionId() << 40, []

        def add(doc_id: int | None, text: str | None) -> None:
            both = [side.encode(text, s.piece) for side in sides] if text else [None]
            if any(x is None for x in both):
                out.append((row, 0, 0, doc_id, 0, b""))
                return
            for side, ids in enumerate(both):
                ends = lengths[side][ids].cumsum()
                window = ends // s.window
                edges = np.flatnonzero(np.diff(window, prepend=-1, append=-1))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    at = int(window[x]) * s.window
                    # ends as differences, the first from the window's beginning
                    out.append((row, at, side, doc_id, y - x, _packed(np.concatenate([ids[x:y], np.diff(ends[x:y], prepend=at).astype(np.uint32)]))))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                add(doc_id, text.as_py())
                row += 1
                if len(out) >= OUT_ROWS:
                    yield _batch(out, EVENTS)
                    out.clear()
        if out:
            yield _batch(out, EVENTS)

    return docs.select("doc_id", "text").mapInArrow(run, EVENTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [pa.field(*((name := x.split())[0], kinds[name[1]])) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def _digits(n: int) -> np.ndarray:
    """Of ids 0, 1, ...: each one's decimal digits after the mark that stands before it, three marks an id, padded with zero bytes."""
    return np.array([mark + str(i) for i in range(n) for mark in ",|;"], "S")


class Machine:
    """The state of the sweep within a document: tokens since the last joint end, and what is known of the document."""

    def __init__(self, row: int, doc_id: int | None, digits: np.ndarray) -> None:
        self.row, self.doc_id, self.digits = row, doc_id, digits
        self.open = [np.empty(0, np.uint32), np.empty(0, np.uint32)]
        self.n, self.groups, self.hash, self.begun = [0, 0], 0, hashlib.sha256(), False

    def step(self, ids: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Takes the events of one window; the linked pairs of ids in it, and how often each is linked."""
        marked = [np.zeros(1 + int(max(e[-1] if len(e) else 0 for e in ends)), bool) for _ in ends]
        for mark, e in zip(marked, ends, strict=True):
            mark[e] = True
        at = [np.flatnonzero(marked[1 - side][ends[side]]) for side in (0, 1)]
        for side in (0, 1):
            self.n[side] += len(ids[side])
        if not len(at[0]):
            self.open = [np.concatenate([x, y]) for x, y in zip(self.open, ids, strict=True)]
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        linked = [x[i] for x, i in zip(ids, at, strict=True)]
        n_groups, codes, after = len(at[0]), [], []
        for side in (0, 1):
            before, last = len(self.open[side]), int(at[side][-1]) + 1
            whole = 3 * np.concatenate([self.open[side], ids[side][:last]]).astype(np.int64)
            ends_after = at[side] + before + 1  # tokens of this side up to the end of each group
            whole[np.concatenate([[0], ends_after[:-1]])] += 2 - side  # mark 2 begins a group, 1 its B side
            codes.append(whole)
            after.append(ends_after)
            self.open[side] = ids[side][last:]
        # group by group, A's tokens before B's: each token moves by the other side's tokens before it
        order = np.empty(len(codes[0]) + len(codes[1]), np.int64)
        sizes = [np.diff(x, prepend=0) for x in after]
        order[np.arange(len(codes[0])) + np.repeat(after[1] - sizes[1], sizes[0])] = codes[0]
        order[np.arange(len(codes[1])) + np.repeat(after[0], sizes[1])] = codes[1]
        text = self.digits[order].tobytes().translate(None, b"\0")
        self.hash.update(text if self.begun else text[1:])
        self.begun = True
        self.groups += n_groups
        pairs, times = np.unique((linked[0].astype(np.uint64) << np.uint64(32)) | linked[1], return_counts=True)
        return pairs, times.astype(np.uint32)

    def result(self, last: bool, pairs: np.ndarray, times: np.ndarray) -> tuple:
        """An output row; all numbers of a document stand in its last one."""
        numbers = (self.n[0], self.n[1], self.groups, self.groups, self.hash.hexdigest() if self.begun else "") if last else (0, 0, 0, 0, "")
        return (self.row, last, self.doc_id, *numbers, len(pairs), _packed(np.diff(pairs, prepend=np.uint64(0))), _packed(times))


def sweep(ended: DataFrame, n_ids: int) -> DataFrame:
    """Groups and links of every document from its events; one row a document, and one more for each further window."""
    job = new_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = kept(job, lambda: _digits(n_ids))
        none = np.empty(0, np.uint32)
        machine, window, now, out, links = None, None, [(none, none), (none, none)], [], (none.astype(np.uint64), none)

        def close_window(last: bool) -> None:
            if machine is not None:
                found = machine.step([x[0] for x in now], [x[1] for x in now])
                now[:] = [(none, none), (none, none)]
                out.append(machine.result(last, *found))

        for batch in batches:
            for row, at, side, doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "side", "doc_id", "n", "data")), strict=True):
                if machine is None or row != machine.row:
                    close_window(True)
                    machine, window = Machine(row, doc_id, digits), at
                elif at != window:
                    close_window(False)
                    window = at
                if n:
                    both = _unpacked(data, 2 * n, "<u4")
                    now[side] = both[:n], both[n:].cumsum()
                if len(out) >= OUT_ROWS:
                    yield _batch(out, ALIGNED)
                    out.clear()
        close_window(True)
        if out:
            yield _batch(out, ALIGNED)

    return ended.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(run, ALIGNED)


def _links_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids and how often each stands, row by row."""
    for n, pairs, times in zip(batch.column("size").to_pylist(), batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
        yield _unpacked(pairs, n, "<u8").cumsum(dtype=np.uint64).view(np.int64), _unpacked(times, n, "<u4").astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair of ids (A's in the high 32 bits), and if no other of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, place = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            # whole numbers below 2**53 are exact in floating point
            return pairs, np.bincount(place, np.concatenate([x[1] for x in held])).astype(np.int64)

        def rows(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["pair", "n"])

        for batch in batches:
            for pairs, times in _links_of(batch):
                held.append((pairs, times))
                size += len(pairs)
                if size > SUM_PAIRS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > SUM_PAIRS // 2:
                        yield rows(held[0])
                        held, size = [], 0
        if size:
            yield rows(summed())

    counted = aligned.select("size", "pairs", "times").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))


def with_best(counted: DataFrame) -> DataFrame:
    """Marks the pairs that no other of their B id exceeds; there is one highest count a B id."""
    highest = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scored_by_lookup(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    rows = counts.orderBy("pair").toPandas()
    known = aligned.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            sums = []
            for pairs, times in _links_of(batch):
                at = np.searchsorted(pair, pairs)
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1))], ["row", "n_best", "count_sum"])

    return aligned.select("row", "size", "pairs", "times").mapInArrow(tidy(run), "row long, n_best long, count_sum long")


def _scored_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (pairs, times) in zip(batch.column("row").to_pylist(), _links_of(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    links = aligned.select("row", "size", "pairs", "times").mapInArrow(tidy(run), "row long, pair long, times long")
    scored = links.join(counts, "pair")
    return scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align(docs: DataFrame, a: tuple[type[Side], bytes], b: tuple[type[Side], bytes], settings: Settings | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document; a and b are a kind of side and its file."""
    s = settings or Settings()
    n_ids = max(len(kind(file).bytes) for kind, file in (a, b))
    aligned = _stored(sweep(events(docs, a, b, s), n_ids), "aligned")
    counts = _stored(with_best(pair_counts(aligned)), "pairs")
    few = counts.limit(s.broadcast_pairs + 1).count() <= s.broadcast_pairs
    scores: Callable = _scored_by_lookup if few else _scored_by_join
    scored = scores(aligned.where("size > 0"), counts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.where("last").join(scored, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_sides() -> tuple[tuple[type[Side], bytes], tuple[type[Side], bytes]]:
    import public_tokenizers

    def read(name: str) -> bytes:
        with open(public_tokenizers.path(name), "rb") as f:
            return f.read()

    return (ByteLevel, read("byte_bpe_50k.json")), (Pieces, read("piece_bpe_32k.model"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_sides())
