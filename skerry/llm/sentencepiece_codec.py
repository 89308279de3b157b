"""Operator 2: SentencePiece encoding by a streaming Viterbi search, and decoding.

The search walks over the characters and keeps a window of boundaries no longer than the longest piece, as no piece that
begins before it can end later. Whenever the backpointer paths of every boundary in the window meet in one boundary, the
ids up to it are committed and forgotten, so memory doesn't depend on the text's length. Two kinds of boundary are known to be such
meeting points without a search: a space mark after another character (no piece has one inside) and either side of a
character that no piece contains. The text between two of them is a closed search of its own, which ends there; its ids are kept
in a cache of a bounded number of bytes, which a task begins empty.

What a path must do depends on the vocabulary. With piece scores (a unigram vocabulary) the highest total wins, and of
equal ones the one whose last piece is longest, at every boundary. With merge ranks (a BPE vocabulary, whose scores only
order its merges) a path survives if every two neighbouring pieces are what merging makes of their joint text; that
leaves one path to every boundary, and its ids are those that merging gives the whole text. Characters outside the
vocabulary become byte pieces.

Defined results: a null text is an empty one and has no ids; a text that holds the space mark U+2581 itself decodes to a
space there, and round_trip says so; a null doc_id passes through; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import table
from skerry.llm.workers import tidy

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: What a task's caches may hold: bytes of ids of closed searches, answers on pairs of pieces, searches of common beginnings.
CACHE_BYTES = 64_000_000
ENTRY_BYTES = 200
CACHE_PAIRS = 200_000
BEGINNING, BEGINNINGS = 4, 12_000
OUT_IDS = 500_000
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


# Fixed values of the vocabulary file: it is a protocol buffer, whose field 2 holds the trainer's settings; there field 3
# is the kind of model, 1 (the default) a unigram model and 2 merge ranks.
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            at += size
            yield number, data[at - size : at]


def model_kind(proto: bytes) -> int:
    settings = next((v for k, v in _fields(proto) if k == 2), b"")
    return next((v for k, v in _fields(settings) if k == 3), UNIGRAM)


class Pieces:
    """A vocabulary: scored pieces, byte pieces, and what follows from them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], plain: list[bool], ranks: bool = False, unknown_id: int = 0) -> None:
        """ranks: the scores are merge ranks."""
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i] and p}
        self.pieces, self.scores, self.byte_ids, self.ranks, self.unknown_id = pieces, scores, byte_ids, ranks, unknown_id
        self.longest = max(map(len, self.ids))
        self.unknown = min(scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.alphabet = set("".join(self.ids))
        self.endings = {p[i:] for p in self.ids for i in range(len(p))}
        self.closed_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # in place of an id: before a text, and of a character that is no piece
        self.start, self.odd = len(pieces), len(pieces) + 1
        self.joins: dict[int, bool] = {}
        self.growth: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.out = [p.encode() for p in pieces]
        for value, i in enumerate(byte_ids):
            self.out[i] = bytes([value])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        byte_ids = sorted((int(m.id_to_piece(i)[1:-1], 16), i) for i in ids if m.is_byte(i))
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in ids]
        return cls([m.id_to_piece(i) if plain[i] else "" for i in ids], [m.get_score(i) for i in ids], [i for _, i in byte_ids], plain, model_kind(m.serialized_model_proto()) == BPE, m.unk_id())

    def spelled(self, c: str) -> tuple[int, ...]:
        """Ids of a character that isn't a piece: of its bytes, or the unknown id."""
        return tuple(self.byte_ids[b] for b in c.encode()) if self.byte_ids else (self.unknown_id,)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the neighbours that form the piece of the best rank join first, the leftmost of equals."""
        parts = list(text)
        while self._merge(parts) is not None:
            pass
        return parts

    def _merge(self, parts: list[str]) -> float | None:
        """The next merge, done in place, and its rank."""
        ranked = [(-self.scores[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids]
        if not ranked:
            return None
        rank, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return rank

    def grown(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How merging makes a piece of its characters: each merge's rank and then infinity, and the first and the last part before it.

        Of a text that merging doesn't make one piece of, the piece is missing at the end."""
        got = self.growth.get(piece)
        if got is None:
            parts, ranks, first, last = list(piece), [], [], []
            while not ranks or ranks[-1] < math.inf:
                first.append(parts[0])
                last.append(parts[-1])
                rank = self._merge(parts)
                ranks.append(math.inf if rank is None else rank)
            got = ranks, first, last
            if piece in self.ids:
                self.growth[piece] = got
        return got

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether merging keeps the two pieces apart and whole.

        Until a merge joins them across their boundary, each of the two grows as it does alone, and the next merge is the
        better one of the two next ones, the left one of equals. So both are replayed, looking at each step whether the
        parts at the boundary would join before that."""
        own, first, _ = self.grown(piece)
        if first[-1] != piece:
            return False
        left, _, last = self.grown(before) if before else ([math.inf], [], [""])
        i = j = 0
        while before:
            across = self.ids.get(last[i] + first[j])
            if across is not None and -self.scores[across] < left[i] and -self.scores[across] <= own[j]:
                return False
            if left[i] > own[j]:
                j += 1
            elif left[i] < math.inf:
                i += 1
            else:
                break
        return True

    def keeps_apart(self, last: int, before: str, i: int) -> bool:
        """may_follow of the piece i after the text `before`, whose id is `last`."""
        key = last * len(self.pieces) + i
        got = self.joins.get(key)
        if got is None:
            got = self.may_follow(before, self.pieces[i])
            if last != self.odd:
                if len(self.joins) >= CACHE_PAIRS:
                    self.joins.clear()
                self.joins[key] = got
        return got


class Search:
    """The Viterbi search over a stream of text, which comes in parts of any length.

    text, last, back and gain are those of the window alone: its characters and, for each boundary between them, the id of
    the best path's last piece, where that begins, and the path's score. opening is the piece before the window."""

    def __init__(self, p: Pieces) -> None:
        self.p, self.text, self.opening = p, "", ""
        self.last, self.back, self.gain = [p.start], [0], [0.0]

    def copy(self) -> Search:
        out = Search(self.p)
        out.text, out.opening, out.last, out.back, out.gain = self.text, self.opening, self.last[:], self.back[:], self.gain[:]
        return out

    def feed(self, part: str) -> list[int]:
        """Go on with the text; returns the ids that no later text can change."""
        done: list[int] = []
        step, on = self.p.longest, self._by_ranks if self.p.ranks else self._by_scores
        for i in range(0, len(part), step):
            self.text += part[i : i + step]
            on()
            if len(self.text) >= 2 * step:
                done += self._commit(self._meeting())
        return done

    def finish(self) -> list[int]:
        """The other ids: at the end of the text the path to its last boundary is the best one."""
        return self._commit(len(self.text))

    def _by_ranks(self) -> None:
        """The survivor at each new boundary by merge ranks; the first one met is the only one."""
        p, text, last, back = self.p, self.text, self.last, self.back
        ids, joins, endings, size = p.ids, p.joins, p.endings, len(p.pieces)
        for end in range(len(last), len(text) + 1):
            start = end
            while start:
                start -= 1
                piece = text[start:end]
                if piece in ids:
                    own = ids[piece]
                    key = last[start] * size + own
                    if joins[key] if key in joins else p.keeps_apart(last[start], text[back[start] : start] if start else self.opening, own):
                        break
                elif piece not in endings:  # no piece ends so
                    start, own = end - 1, p.odd
                    break
            else:
                start, own = end - 1, p.odd
            last.append(own)
            back.append(start)

    def _by_scores(self) -> None:
        """The survivor at each new boundary by the sum of scores, of equal ones that of the longest last piece."""
        p, text, last, back, gain = self.p, self.text, self.last, self.back, self.gain
        for end in range(len(last), len(text) + 1):
            start = end - 1
            own = p.ids.get(text[start], p.odd)
            best = gain[start] + (p.unknown if own == p.odd else p.scores[own])
            for at in range(end - 2, max(-1, end - p.longest - 1), -1):
                longer = p.ids.get(text[at:end])
                if longer is not None and gain[at] + p.scores[longer] >= best:
                    best, start, own = gain[at] + p.scores[longer], at, longer
            last.append(own)
            back.append(start)
            gain.append(best)

    def _meeting(self) -> int:
        """The latest boundary that the paths of all boundaries pass from which a piece may yet begin."""
        back, live = self.back, set(range(len(self.text) - self.p.longest + 1, len(self.text) + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(back[far])
        return live.pop()

    def _commit(self, end: int) -> list[int]:
        """Ids of the path to a boundary, which becomes the first one of the window."""
        out, at = [], end
        while at:
            own = self.last[at]
            if own == self.p.odd:
                out += reversed(self.p.spelled(self.text[at - 1]))
            else:
                out.append(own)
            at = self.back[at]
        if end:
            self.opening = self.text[self.back[end] : end]
            self.text, self.last = self.text[end:], self.last[end:]
            self.back = [max(0, b - end) for b in self.back[end:]]
            self.gain = [g - self.gain[end] for g in self.gain[end:]]
        out.reverse()
        return out


def viterbi_stream(parts: Iterable[str], p: Pieces) -> Iterator[int]:
    """Ids of the best segmentation of a text that comes in parts, given out as soon as they are certain."""
    search = Search(p)
    for part in parts:
        yield from search.feed(part)
    yield from search.finish()


class _Closed(dict):
    """Ids (as little-endian 32-bit bytes) of closed searches, kept until they take more than a bounded number of bytes.

    A search goes on from where another one of the same first characters was."""

    def __init__(self, pieces: Pieces, prefix: str, room: int) -> None:
        self.pieces, self.prefix, self.room, self.taken = pieces, prefix, room, 0
        self.begun: dict[str, tuple[Search, list[int]]] = {}

    def __missing__(self, text: str) -> bytes:
        start = text[:BEGINNING]
        if start not in self.begun:
            if len(self.begun) >= BEGINNINGS:
                self.begun.clear()
            first = Search(self.pieces)
            self.begun[start] = (first, first.feed(self.prefix + start))
        first, done = self.begun[start]
        search = first.copy()
        ids = array("i", done + search.feed(text[BEGINNING:]) + search.finish()).tobytes()
        if len(text) <= 64:
            self.taken += ENTRY_BYTES + 2 * len(text) + len(ids)
            if self.taken > self.room:
                self.clear()
                self.taken = 0
            self[text] = ids
        return ids


class Encoder:
    """Encodes whole texts; add_dummy_prefix as in the vocabulary's normaliser, which otherwise leaves texts as they are."""

    def __init__(self, pieces: Pieces, cache_bytes: int = CACHE_BYTES) -> None:
        self.pieces = pieces
        self.after_mark, self.bare = _Closed(pieces, MARK, cache_bytes), _Closed(pieces, "", cache_bytes // 8)
        self.lines_closed = "\n" not in pieces.alphabet
        self.newline = np.array([pieces.byte_ids[10]], np.int32).tobytes() if pieces.byte_ids else b""

    def _line(self, line: str, first: bool) -> bytes:
        if MARK in line or "  " in line or (line[-1:] == " ") or (first and line[:1] == " "):
            return b"".join(map(self.bare.__getitem__, _RUNS.findall((MARK if first else "") + line.replace(" ", MARK))))
        words = line.split(" ")
        if first:
            return b"".join(map(self.after_mark.__getitem__, words))
        return (self.bare[words[0]] if words[0] else b"") + b"".join(map(self.after_mark.__getitem__, words[1:]))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if not self.pieces.closed_marks:
            return np.fromiter(viterbi_stream([MARK + text.replace(" ", MARK)], self.pieces), np.int32)
        if not self.lines_closed or "\n" not in text:
            return np.frombuffer(self._line(text, True), np.int32)
        first, *rest = text.split("\n")
        lines = [self._line(first, True) if first else self.bare[MARK], *(self._line(x, False) if x else b"" for x in rest)]
        return np.frombuffer(self.newline.join(lines), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.out.__getitem__, ids.tolist())).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_ids, ids and round_trip (the ids decode to the text) of every row; one pass, no shuffle. A smaller cache takes more time."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Encoder(vocabulary.value, cache_bytes)
        for b in batches:
            keys, texts = b.column("doc_id"), b.column("text")
            start, held, size = 0, [], 0
            same = []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                held.append(ids := codec.encode(text))
                same.append(codec.decode(ids) == text)
                size += len(ids)
                if size >= OUT_IDS or i == len(texts) - 1:
                    counts = np.array([len(x) for x in held], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts.cumsum()]), pa.int32()), pa.array(np.concatenate(held), pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), pa.array(counts), lists, pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])
                    start, held, size, same = i + 1, [], 0, []

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows that hold ids."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Encoder(vocabulary.value)
        for b in batches:
            texts = [codec.decode(np.array(ids or [], np.int32)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model())
