"""Relations over paths: directory listings, trees, glob search, the table of a directory, and lines of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.errors import EngineError

#: Folders of version control and of the engine itself.
HIDDEN = [".git", ".git/**", ".skerry", ".skerry/**"]


def glob_regex(pattern: str) -> str:
    """A glob over a whole relative path as a regular expression: ** spans folders, * and ? don't, [..] and {a,b} as usual."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise EngineError("io/invalid-pattern", pattern)
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c))
        i += 1
    return f"(?i)^{out}$"


def matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def search(files: DataFrame, pattern: str, exclude: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Paths that match, whatever their case, in order of lower(path), without excluded and hidden ones; what names a folder excludes all below it."""
    gone = [x for p in exclude or [] for x in (p, p.rstrip("/") + "/**")]
    keep = matches(F.col("path"), [pattern]) & ~matches(F.col("path"), [*HIDDEN, *gone])
    return files.where(keep).orderBy(F.lower("path"), "path").limit(limit)


def entries(files: DataFrame) -> DataFrame:
    """(parent, name, is_file, depth, size) of every file and of every folder above one."""
    parts = F.split("path", "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), F.element_at(parts, n).alias("name"), (n == F.size(parts)).alias("is_file"), n.alias("depth")))
    rows = files.select(F.explode(ways).alias("e"), "size").select("e.*", "size")
    return rows.groupBy("parent", "name", "is_file", "depth").agg(F.sum("size").alias("size"))


def listing(files: DataFrame, folder: str = "", by_size: bool = False) -> DataFrame:
    """Direct children: folders first, then by name; or by size, largest last."""
    rows = entries(files).where(F.col("parent") == folder).select("name", "is_file", "size")
    return rows.orderBy("size", "name") if by_size else rows.orderBy("is_file", "name")


def tree(files: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every entry down to a depth, in order of its path."""
    rows = entries(files).where(F.col("depth") <= max_depth)
    return rows.select(F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("path"), "is_file", "depth").orderBy("path")


def lines(df: DataFrame, key: str, text: str, head: int | None = None, tail: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """(key, line_no, line) of the first or last lines or of a range, from 1, both ends included; all if none is given."""
    if sum(x is not None for x in (head, tail, between)) > 1 or (between and not 1 <= between[0] <= between[1]):
        raise EngineError("io/invalid-range", "give one of head, tail and a range from 1")
    rows = df.select(key, F.split(F.col(text), "\n").alias("_lines")).select(key, F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_at", "line")).withColumn("line_no", F.col("_at") + 1)
    if head is not None:
        rows = rows.where(F.col("line_no") <= head)
    if tail is not None:
        rows = rows.where(F.col("line_no") > F.col("_n") - tail)
    if between is not None:
        rows = rows.where(F.col("line_no").between(*between))
    return rows.select(key, "line_no", "line")


def index_tables(files: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(folder, body): a table of each folder's entries by kind and name; a kept summary comes before a generated one.

    files has path and summary; summaries has folder, name and summary."""
    rows = files.select(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "summary")
    if summaries is not None:
        kept = summaries.select("folder", "name", F.col("summary").alias("_kept"))
        rows = rows.join(kept, ["folder", "name"], "left").withColumn("summary", F.coalesce("_kept", "summary")).drop("_kept")
    cell = F.replace(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    rows = rows.select("folder", F.struct(F.lower("name").alias("low"), "name", F.concat(F.lit("| "), "name", F.lit(" | "), cell, F.lit(" |")).alias("row")).alias("e"))
    return rows.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["row"]), "\n").alias("body"))


#: Marks between which an index file's table is managed; a file of another engine may have its own.
MARKERS = ("<!-- skerry:index:begin -->", "<!-- skerry:index:end -->")
AUTO = " <!-- auto -->"


def managed_indexes(entries_: DataFrame, existing: DataFrame, markers: tuple[str, str] = MARKERS) -> DataFrame:
    """(folder, text, state) of every folder's index after entries(folder, name, is_file, summary), where existing(folder, text) may have one.

    The table stands between the markers. A summary that a person wrote there stays, one marked as automatic is made anew.
    A text without markers gets the table at its end; one whose markers are out of order or repeated is left, as invalid.
    state is created, updated, unchanged or invalid."""
    begin, end = markers
    cut = F.split("text", F.concat(F.lit("\\Q"), F.lit(begin), F.lit("\\E")))
    rest = F.split(F.element_at(cut, -1), F.concat(F.lit("\\Q"), F.lit(end), F.lit("\\E")))
    ends = F.size(F.split("text", F.concat(F.lit("\\Q"), F.lit(end), F.lit("\\E")))) - 1
    begins = F.size(cut) - 1
    old = existing.select("folder", "text", begins.alias("_b"), ends.alias("_e"), cut[0].alias("_before"), rest[0].alias("_table"), F.get(rest, 1).alias("_after"), F.size(rest).alias("_r"))
    old = old.withColumn("_valid", ((F.col("_b") == 0) & (F.col("_e") == 0)) | ((F.col("_b") == 1) & (F.col("_e") == 1) & (F.col("_r") == 2)))
    # summaries of persons, by name: | name | summary |
    row = F.transform(F.regexp_extract_all("_table", F.lit(r"(?m)^\| .* \|$"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^\| \[?\[?([^|\]]*?)\]?\]? \| ", 1).alias("name"), F.regexp_extract(x, r"^\| [^|]* \| (.*) \|$", 1).alias("kept")))
    kept = old.where("_valid AND _b = 1").select("folder", F.explode(row).alias("x")).select("folder", "x.*").where(~F.col("kept").endswith(AUTO.strip()) & (F.col("kept") != "") & ~F.col("name").isin("Name", "---"))
    rows = entries_.join(kept.dropDuplicates(["folder", "name"]), ["folder", "name"], "left")
    clean = F.replace(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), "name", F.lit(" | "), F.coalesce("kept", F.concat(clean, F.lit(AUTO))), F.lit(" |"))
    tables = rows.select("folder", F.struct("is_file", F.lower("name").alias("low"), "name", line.alias("row")).alias("e")).groupBy("folder")
    table = tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["row"]), "\n").alias("_rows"))  # the entries of one folder
    table = table.select("folder", F.concat(F.lit(f"{begin}\n| Name | Summary |\n| --- | --- |\n"), "_rows", F.lit(f"\n{end}")).alias("_block"))
    both = table.join(old, "folder", "left")
    fresh = F.concat(F.lit("## Contents\n\n"), "_block", F.lit("\n"))
    text = (
        F.when(F.col("text").isNull(), fresh)
        .when(~F.col("_valid"), F.col("text"))
        .when(F.col("_b") == 0, F.concat(F.regexp_replace("text", r"\n?\z", "\n"), F.lit("\n"), fresh))
        .otherwise(F.concat("_before", "_block", "_after"))
    )
    state = F.when(F.col("text").isNull(), "created").when(~F.col("_valid"), "invalid").when(text == F.col("text"), "unchanged").otherwise("updated")
    return both.select("folder", text.alias("text"), state.alias("state"))


def rebuild_report(indexes: DataFrame) -> DataFrame:
    """One row of counters of managed_indexes()."""
    return indexes.agg(F.count("*").alias("directories_scanned"), *(F.count_if(F.col("state") == x).alias(x) for x in ("created", "updated", "unchanged", "invalid")))


def slugs(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, order, slug): lower case, other characters than letters and digits become -, repetitions within a key get -1, -2, ..."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    rows = df.select(key, order, base.alias("_slug"))
    n = F.row_number().over(Window.partitionBy(key, "_slug").orderBy(order)) - 1
    return rows.withColumn("_n", n).select(key, order, F.when(F.col("_n") == 0, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_n").cast("string"))).alias("slug"))
