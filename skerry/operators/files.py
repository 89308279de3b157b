"""Relations over the contents of files: facts, attachments, requests for many, resources, and edits as rows.

files has path and content (binary), as Spark's binaryFile source gives them, or path and text. An edit never writes in
place: it gives the new texts as rows, to be stored by the caller in one write.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.operators.listing import HIDDEN, matches

ATTACHMENT_BYTES = 10 * 1024 * 1024
# First bytes of some formats, in hexadecimal, and the types of file extensions.
MAGIC = {
    "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip",
    "4F676753": "audio/ogg", "494433": "audio/mpeg", "664C6143": "audio/x-flac", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "38425053": "image/vnd.adobe.photoshop",
}
EXTENSIONS = {
    "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "yaml": "text/x-yaml", "yml": "text/x-yaml",
    "xml": "text/xml", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4", "zip": "application/zip",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def is_text(content: Column) -> Column:
    """UTF-8 without a zero byte."""
    return F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.unhex(F.lit("00")))


def mime(path: Column, content: Column | None = None) -> Column:
    """The type by the first bytes if they tell it, else by the extension, else text or bytes."""
    by_name = F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), extension(path))
    if content is None:
        return F.coalesce(by_name, F.lit("application/octet-stream"))
    head = F.hex(F.substring(content, 1, 16))
    riff = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    by_magic = F.coalesce(riff, *(F.when(head.startswith(k), v) for k, v in MAGIC.items()))
    return F.coalesce(by_magic, by_name, F.when(is_text(content), "text/plain").otherwise("application/octet-stream"))


def info(files: DataFrame, cap: int = ATTACHMENT_BYTES) -> DataFrame:
    """(path, kind, size, modified, sha256 if the size is at most cap) of files(path, content, and modificationTime if known)."""
    size = F.octet_length("content").cast("long")
    at = F.col("modificationTime") if "modificationTime" in files.columns else F.lit(None).cast("timestamp")
    return files.select("path", F.lit("file").alias("kind"), size.alias("size"), at.alias("modified"), F.when(size <= cap, F.sha2("content", 256)).alias("sha256"))


def allowed_roots(spark: SparkSession, roots: dict[str, str], managed: list[str] = ()) -> DataFrame:
    """(name, path, managed) of the roots that a session may read."""
    if any(not n.strip() or "/" in n for n in roots):
        raise EngineError("path/invalid-vault-name", str(list(roots)))
    return spark.createDataFrame([(n, p.rstrip("/"), n in managed) for n, p in roots.items()], "name string, path string, managed boolean")


def read_many(requests: DataFrame, files: DataFrame, cap: int | None = None) -> DataFrame:
    """requests with text and error: a missing path, a directory's name, or a text beyond cap bytes fails alone."""
    folders = files.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n - 1), "/")), lambda x: x != "")).alias("path"))
    found = requests.join(files.select("path", "text", F.lit(True).alias("_is")), "path", "left").join(folders.distinct().withColumn("_dir", F.lit(True)), "path", "left")
    long = F.lit(False) if cap is None else F.octet_length("text") > cap
    error = F.when(F.col("_is") & long, "io/too-large").when(F.col("_is"), None).when(F.col("_dir"), "path/not-file").otherwise("path/not-found")
    return found.withColumn("error", error).withColumn("text", F.when(error.isNull(), F.col("text"))).drop("_is", "_dir")


def attachments(files: DataFrame, cap: int = ATTACHMENT_BYTES) -> DataFrame:
    """(path, mime, size, is_text, content, error): content is null beyond cap bytes."""
    content = F.col("content")
    large = F.octet_length(content) > cap
    return files.select("path", mime(F.col("path"), content).alias("mime"), F.octet_length(content).cast("long").alias("size"), is_text(content).alias("is_text"), F.when(~large, content).alias("content"), F.when(large, "io/too-large").alias("error"))


def resources(files: DataFrame, allowed: list[str], root: str = "vault") -> DataFrame:
    """(root, path, mime, size) of the files that one of the globs allows, each once; hidden ones never."""
    key = root if root in files.columns else None
    keep = files.where(matches(F.col("path"), allowed) & ~matches(F.col("path"), HIDDEN))
    keys = [key, "path"] if key else ["path"]
    return keep.dropDuplicates(keys).select(*keys, mime(F.col("path")).alias("mime"), F.col("size").cast("long").alias("size"))


def resource_counts(found: DataFrame, root: str = "vault") -> DataFrame:
    return found.groupBy(root).agg(F.count("*").alias("resources"))


def append(files: DataFrame, additions: DataFrame, preamble: str = "") -> DataFrame:
    """(path, text) after additions(path, addition); a new or an empty file begins with the preamble."""
    both = files.select("path", "text").join(additions, "path", "full_outer")
    text = F.coalesce("text", F.lit(""))
    return both.select("path", F.when(F.col("addition").isNull(), text).otherwise(F.concat(F.when(text == "", F.lit(preamble)).otherwise(text), "addition")).alias("text"))


def exact_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, error) after edits(path, seq, old_text, new_text), one after the other; each old text must stand exactly once.

    A file with an edit that fails keeps its text, and error says which of its edits it was."""
    steps = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "old_text", "new_text"))).alias("_steps"))  # one user's edits of one file
    both = files.select("path", "text").join(steps, "path", "left")

    def step(s: Column, e: Column) -> Column:
        times = (F.length(s["text"]) - F.length(F.replace(s["text"], e["old_text"], F.lit("")))) / F.length(e["old_text"])
        error = F.when((e["old_text"] == "") | (times == 0), "not-found").when(times > 1, "ambiguous")
        code = F.concat(F.lit("edit/"), error, F.lit(" at "), e["seq"].cast("string"))
        return F.when(s["error"].isNotNull(), s).otherwise(F.struct(F.when(error.isNull(), F.replace(s["text"], e["old_text"], e["new_text"])).otherwise(s["text"]).alias("text"), code.alias("error")))

    start = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("error"))
    done = F.aggregate(F.coalesce("_steps", F.array().cast(steps.schema["_steps"].dataType)), start, step)
    return both.select("path", F.when(done["error"].isNull(), done["text"]).otherwise(F.col("text")).alias("text"), done["error"].alias("error"))


def diff(before: DataFrame, after: DataFrame, max_bytes: int = 200_000) -> DataFrame:
    """(path, status, patch, truncated) of files(path, text) that are added, removed or changed; the patch is a unified one, cut to whole lines of max_bytes."""
    if max_bytes < 1:
        raise EngineError("io/invalid-argument", "max_bytes is positive")
    both = before.select("path", F.col("text").alias("a")).join(after.select("path", F.col("text").alias("b")), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    both = both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("status"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patches, cut = [], []
            for path, a, b in zip(batch["path"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                made = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{path}", f"b/{path}", lineterm="")
                text, size = [], 0
                for line in made:
                    size += len(line.encode()) + 1
                    if size > max_bytes:
                        break
                    text.append(line)
                patches.append("\n".join(text))
                cut.append(size > max_bytes)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["status"], pa.array(patches, pa.string()), pa.array(cut, pa.bool_())], ["path", "status", "patch", "truncated"])

    return both.mapInArrow(run, "path string, status string, patch string, truncated boolean")


def new_notes(rows: DataFrame, at: Column) -> DataFrame:
    """rows(path, title, content, overrides map<string,string>) as notes: frontmatter (a map of JSON values) and text.

    The defaults come first, in this order; overrides, given as JSON values, replace them or follow."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', "$1")
    stamp = quoted(at.cast("string"))
    defaults = {"type": F.lit('"note"'), "title": quoted(F.col("title")), "entity": F.lit('"personal"'), "status": F.lit('"new"'), "created": stamp, "updated": stamp, "tags": F.lit("[]"), "aliases": F.lit("[]")}
    keys = F.array(*map(F.lit, defaults))
    own = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    base = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.try_element_at(own, F.lit(k)), v))))
    head = F.map_concat(base, F.map_filter(own, lambda k, _: ~F.array_contains(keys, k)))
    lines = F.array_join(F.transform(F.map_entries(head), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    text = F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), F.coalesce("content", F.lit("")))
    return rows.select("path", F.when(~blank, head).alias("frontmatter"), F.when(~blank, text).alias("text"), F.when(blank, "note/empty-title").alias("error"))


def bounded_preview(text: Column, max_bytes: int) -> Column:
    """(text, shortened): the whole lines that fit max_bytes; if not even the first does, its characters that begin within them."""
    lines = F.transform(F.split(text, "(?<=\n)"), lambda x: x)
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(s: Column, line: Column) -> Column:
        full = s["full"] | (F.octet_length(s["text"]) + F.octet_length(line) > max_bytes)
        return F.struct(F.when(full, s["text"]).otherwise(F.concat(s["text"], line)).alias("text"), full.alias("full"))

    whole = F.aggregate(lines, start, add)["text"]
    first = F.aggregate(
        F.split(F.substring(text, 1, max_bytes + 1), ""),
        F.lit(""),
        lambda s, c: F.when(F.octet_length(s) <= max_bytes, F.concat(s, c)).otherwise(s),
    )
    shortened = F.octet_length(text) > max_bytes
    return F.struct(F.when(~shortened, text).when(whole != "", whole).otherwise(first).alias("text"), shortened.alias("shortened"))
