"""Operator 13: words that differ by one character, by forward and backward minimal acyclic automata.

Of two words one edit apart, one half of the first stands whole in the second: the first half at its beginning, or the
last half at its end. So every word looks for its half from the left in an automaton of the words, and from the right in
one of the reversed words, follows that half exactly and the other half with one error. Both automata are minimal and
acyclic; each edge carries how many words come before those it leads to, so that the sum along a path is the word's
number, by which its count and spelling are found. Words found in both directions are told once.

Words meet in groups of equal halves (a hash of direction, query's length and half); a task takes its groups one after
the other and builds the automata of some `block` words at a time. The words of one half can be very many. Those of a group
of more than `block` are dealt out anew by the same reasoning: of what is left of the query, which has one error, the first or the
last half is exact too. Every step halves what is left; in the end only words that differ at one place can share a group.

The form of a word is its near word of the largest count, at least `ratio` times its own; its root is the end of the chain
of forms, found by doubling, as counts at least double along a chain.

Defined results: null and empty texts have no words; a null doc_id is written as nothing in the drawing of edits; an empty
table gives no rows; repeated rows and ids count each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import materialize, small_lookup, table
from skerry.llm.workers import tidy

#: Distinct words that a task counts before it hands them on, and code points of the words of one block's automata.
HELD_WORDS, BLOCK_CHARS = 300_000, 400_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    edit_every: int = 97
    block: int = 20_000


def with_edits(doc_id: int | None, runs: Counter[str], every: int) -> Iterator[tuple[str, int]]:
    """The runs of a document, one character less where a checksum of document and run says so."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        drawn = zlib.crc32(run.encode(), begun)
        if drawn % every == 0:
            at = drawn % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(docs: DataFrame, s: Settings) -> DataFrame:
    """(word, n) for the words of min_length and min_count; counts are combined in the tasks that read the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for word, n in with_edits(doc_id, Counter(_RUN.findall((text.as_py() or b"").translate(_LOWER).decode())), s.edit_every):
                    if len(word) >= s.min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    counted = docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= s.min_count)


class Automaton:
    """A minimal acyclic automaton of sorted words; edges are character -> (state, number of words before its own)."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # open states: final, closed edges
        before = ""
        for word in [*words, None]:
            keep = 0
            if word is not None:
                while keep < min(len(word), len(before)) and word[keep] == before[keep]:
                    keep += 1
            while len(path) - 1 > keep:
                state = self._closed(*path.pop())
                path[-1][1][before[len(path) - 1]] = state
            if word is not None:
                path += [(False, {}) for _ in word[keep:]]
                path[-1] = (True, path[-1][1])
                before = word
        self.start = self._closed(*path.pop())

    def _closed(self, final: bool, edges: dict[str, int]) -> int:
        """The state of these edges, an equal one if there is one."""
        key = (final, *edges.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            before, numbered = int(final), {}
            for c, to in edges.items():
                numbered[c] = (to, before)
                before += self.size[to]
            self.edges.append(numbered)
            self.final.append(final)
            self.size.append(before)
        return state

    def number(self, word: str) -> int | None:
        """How many words come before this one, None if it isn't among them."""
        state, number = self.start, 0
        for c in word:
            if c not in self.edges[state]:
                return None
            state, skipped = self.edges[state][c]
            number += skipped
        return number if self.final[state] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words one edit away that share the first `exact` characters.

        Goes a level of the automaton at a time; a place is (state, number so far, characters of the word used, edited)."""
        state, number, length = self.start, 0, len(word)
        for c in word[:exact]:
            step = self.edges[state].get(c)
            if step is None:
                return set()
            state, number = step[0], number + step[1]
        now, found = {(state, number, exact, False)}, set()
        while now:
            later: set[tuple[int, int, int, bool]] = set()
            # a character of the word is left out
            now |= {(q, k, i + 1, True) for q, k, i, edited in now if not edited and i < length}
            for q, k, i, edited in now:
                edges = self.edges[q]
                if edited:
                    if i == length:
                        if self.final[q]:
                            found.add(k)
                    elif word[i] in edges:
                        to, skipped = edges[word[i]]
                        later.add((to, k + skipped, i + 1, True))
                    continue
                own = word[i] if i < length else None
                for c, (to, skipped) in edges.items():
                    later.add((to, k + skipped, i, True))  # a character more
                    if c == own:
                        later.add((to, k + skipped, i + 1, False))
                    elif own is not None:
                        later.add((to, k + skipped, i + 1, True))
            now = later
        return found


def _halves(words: DataFrame, s: Settings) -> DataFrame:
    """(word, n, back, length, a, b, grp) for every half that a query of length word's own, one less or one more would look for.

    The exact part of such a query is its first a and last b characters."""
    lengths = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("length")
    rows = words.select("word", "n", lengths).where(F.col("length") >= s.min_length)
    half = F.expr("length div 2")
    forward = rows.withColumns({"back": F.lit(False), "a": half, "b": F.lit(0)})
    backward = rows.withColumns({"back": F.lit(True), "a": F.lit(0), "b": F.col("length") - half})
    return _grouped(forward.union(backward))


def _grouped(rows: DataFrame) -> DataFrame:
    ends = F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))).otherwise("")
    return rows.withColumn("grp", F.xxhash64("back", "length", "a", "b", *ends))


def meetings(words: DataFrame, s: Settings) -> DataFrame:
    """The rows of _halves, dealt out anew while a group has more than s.block of them; stored. Equal hashes only join groups."""
    open_, done = materialize(_halves(words, s), "halves"), []
    while True:
        # a group whose queries have but one character open can't be parted further, and has but words that differ there
        large = materialize(open_.groupBy("grp").agg(F.count("*").alias("size"), F.max(F.col("length") - F.col("a") - F.col("b")).alias("open")).where((F.col("size") > s.block) & (F.col("open") > 1)).select("grp"), "large")
        if large.isEmpty():
            return _united([*done, open_])
        marked = small_lookup(open_, large.withColumn("split", F.lit(True)), ["grp"])
        done.append(marked.where("split IS NULL").select(open_.columns))
        split = marked.where("split").withColumn("first", F.expr("(length - a - b) div 2"))
        left = split.withColumn("a", F.col("a") + F.col("first"))
        right = split.withColumn("b", F.col("length") - F.col("a") - F.col("first"))
        parts = left.where("first > 0").union(right)
        open_ = materialize(_grouped(parts.where("a + b <= length(word)").select(open_.columns)), "halves")


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _pairs_of(words: dict[str, int], queries: list[tuple[str, bool, int]]) -> Iterator[tuple[str, str, int]]:
    """(query, near word, its count) for queries (word, backward, characters of its exact half)."""
    for back, turned in ((False, lambda w: w), (True, lambda w: w[::-1])):
        asked = [(w, exact) for w, b, exact in queries if b == back]
        if asked:
            listed = sorted(map(turned, words))
            automaton = Automaton(listed)
            for word, exact in asked:
                for number in automaton.near(turned(word), exact):
                    near = turned(listed[number])
                    if near != word:
                        yield word, near, words[near]


def near_words(met: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, near, near_n) for words one edit apart, each once, from the rows of meetings()."""

    def run(batches: Iterator[pa.RecordBatch], block: int = 0) -> Iterator[pa.RecordBatch]:
        words, queries, size, now = {}, [], 0, None

        def told() -> Iterator[pa.RecordBatch]:
            out = list(dict.fromkeys(_pairs_of(words, queries)))
            for i in range(0, len(out), 50_000):
                columns = list(zip(*out[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            for grp, word, n, back, length, a, b in zip(*(batch.column(c).to_pylist() for c in ("grp", "word", "n", "back", "length", "a", "b")), strict=True):
                if grp != now:
                    if size > chars:
                        yield from told()
                        words, queries, size = {}, [], 0
                    now = grp
                size += len(word)
                words[word] = n
                if len(word) == length:
                    queries.append((word, back, b if back else a))
        yield from told()

    rows = met.repartition("grp").sortWithinPartitions("grp").mapInArrow(tidy(run), "word string, near string, near_n long")
    return rows.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, given as (word, form): pointers are doubled until none moves."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def variants(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    s = settings or Settings()
    words = materialize(count_words(docs, s), "words")
    near = near_words(meetings(words, s))
    # the largest count first, then the smallest in the order of code points, which is that of UTF-8 bytes
    best = materialize(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("top")), "near")
    joined = words.join(best, "word", "left")
    has: Callable[[Column], Column] = lambda value: F.when(-F.col("top.n") >= s.ratio * F.col("n"), value)
    formed = materialize(joined.select("word", has(F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), has(-F.col("top.n")).alias("form_n")), "forms")
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in SQL: words near each other share what is left of them with one place blanked or left out."""
    return """
WITH RECURSIVE bits AS (SELECT list(c ORDER BY v) AS crc_table FROM (
  SELECT v, list_reduce(list_concat([v], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS v))),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
drawn AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
    lambda c, byte: xor(c >> 8, crc_table[CAST(xor(c & 255, byte) + 1 AS INT)])), 4294967295) AS h FROM coded, bits),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM drawn),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pairs),
formed AS (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
chains AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL"""
