"""A Python data source for directories of Markdown notes.

    register(spark)
    notes = spark.read.format("vault").load("/vaults/home")

Spark's own file sources skip names that begin with _ or ., and replace invalid UTF-8 instead of skipping the file, so
the listing is done here: the driver lists the upper level, tasks list the folders below it, read and parse. The option folder narrows the
listing. Filters aren't pushed down: Spark keeps one reader for a DataFrame, so those of one query would narrow the others
on it. The folder must be reachable under one path by driver and executors; for
other stores load raw texts with Spark and use parse_notes().
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skerry.errors import EngineError
from skerry.sources import markdown

EXCLUDED = [".git", ".skerry"]
#: What searches and managed indexes leave out unless they are told otherwise.
INDEX_EXCLUDED = [".skerry", ".git", ".obsidian", "memory/log", "memory/sessions"]
SCHEMA = (
    "path string, name string, basename string, ext string, folder string, size bigint, ctime string, mtime string, modified timestamp, raw string, body string, "
    "frontmatter_json string, fm_error string, tags array<string>, links array<string>, embeds array<string>, title string, headings array<string>, content_hash string"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
ARROW = {"string": pa.string(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string())}
ROWS = pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in SCHEMA.split(", "))])


def excluded(path: str, prefixes: list[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


def indexed(path: Column, prefixes: list[str] | None = None) -> Column:
    """Whether searches and managed indexes take a path: it is none of the excluded ones, nor below one."""
    out = F.lit(True)
    for p in INDEX_EXCLUDED if prefixes is None else prefixes:
        out = out & (path != p) & ~path.startswith(p + "/")
    return out


def parse_note(path: str, content: bytes, created: float | None = None, changed: float | None = None) -> dict | None:
    """A note's row; None if it isn't UTF-8. Bad frontmatter is an empty mapping with fm_error; bad links are no links."""
    try:
        raw = content.decode()
    except UnicodeDecodeError:
        return None
    error, head, body = None, {}, raw
    try:
        head, body = markdown.frontmatter(raw)
    except EngineError as e:
        error = str(e)
    try:
        found = markdown.links(body)
    except EngineError:
        found = []
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    heads = markdown.headings(body)
    at = [None if t is None else dt.datetime.fromtimestamp(t, dt.UTC) for t in (created, changed)]
    values = [
        path, name, stem if dot else name, ext if dot else "", path.rpartition("/")[0], len(content), *(None if t is None else str(t) for t in at), at[1], raw, body,
        markdown.as_json(head), error, markdown.tags(head, body), list(dict.fromkeys(x.target for x in found if not x.embed)), list(dict.fromkeys(x.target for x in found if x.embed)),
        markdown.title(head, heads, path), heads, hashlib.sha256(content).hexdigest(),
    ]
    return dict(zip(COLUMNS, values, strict=True))


def parse_notes(files: DataFrame) -> DataFrame:
    """Notes from files(path, content binary), wherever Spark read them; a map in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_note(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r for r in found if r], ROWS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(VaultSource)


class VaultSource(DataSource):
    """Options: path (the root), folder (below it, to read no other), exclude (comma-separated prefixes, besides those always excluded), batch (files of the upper levels a task, 500),
    levels (folders so many levels below are each listed and read by a task of their own, 1)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options)


class VaultReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.exclude = [*EXCLUDED, *(p for p in options.get("exclude", "").split(",") if p)]
        self.batch = int(options.get("batch", 500))
        self.levels = max(1, int(options.get("levels", 1)))
        self.folder = options.get("folder", "").strip("/")
        if ".." in self.folder.split("/"):
            raise EngineError("path/outside-root", self.folder)

    def partitions(self) -> list[InputPartition]:
        """Folders `levels` below the root are each walked by a task; the driver lists what lies above them."""
        files, folders = [], []
        for own, inner, names in self._walk(self.folder):
            files += names
            if own.count("/") + 1 >= self.levels + self.folder.count("/") + bool(self.folder):
                folders += [own + d for d in inner]
                inner.clear()
        files.sort()
        parts = [InputPartition((files[i : i + self.batch], None)) for i in range(0, len(files), self.batch)]
        return parts + [InputPartition(([], f)) for f in sorted(folders)] or [InputPartition(([], None))]

    def _walk(self, top: str) -> Iterator[tuple[str, list[str], list[str]]]:
        """Prefix, subfolders and notes of every folder from top on, without what is excluded."""
        for folder, inner, names in os.walk(os.path.join(self.root, top)):
            own = os.path.relpath(folder, self.root).replace(os.sep, "/")
            own = "" if own == "." else own + "/"
            inner[:] = sorted(d for d in inner if not excluded(own + d, self.exclude))
            yield own, inner, [own + n for n in sorted(names) if n.lower().endswith(".md") and not excluded(own + n, self.exclude)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, folder = partition.value
        if folder is not None:
            files = (path for _, _, names in self._walk(folder) for path in names)
        found = []
        for path in files:
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    content = f.read()
                stat = os.stat(full)
            except OSError:
                continue
            if row := parse_note(path, content, stat.st_ctime, stat.st_mtime):
                found.append(row)
            if len(found) >= 100:
                yield pa.RecordBatch.from_pylist(found, ROWS)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, ROWS)


def out_links(notes: DataFrame, text: str = "raw") -> DataFrame:
    """(edge_id, from, target, kind) of every link in the whole file, for the graph; notes with a bad link have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found += [(f"{path}#{x.pos}", path, x.target, "embed" if x.embed else "link") for x in markdown.links(raw or "")]
                except EngineError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(4)], ["edge_id", "from", "target", "kind"])

    return notes.select("path", F.col(text)).mapInArrow(run, "edge_id string, `from` string, target string, kind string")
