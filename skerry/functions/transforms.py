"""Rewrites of Markdown for display, as column expressions over whole texts.

A text is first split into code (fenced blocks and spans between equal runs of backticks) and prose; only prose changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fenced blocks, and code spans within a line.
CODE = r"(?ms)(^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z)|(?<!`)(`+)(?!`)[^\n]*?(?<!`)\2(?!`))"
FENCE = r"(?ms)(^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z))"
# Other names of callout kinds.
ALIASES = {"summary": "abstract", "tldr": "abstract", "hint": "tip", "important": "tip", "check": "success", "done": "success", "help": "question", "faq": "question", "caution": "warning", "attention": "warning", "fail": "failure", "missing": "failure", "error": "danger", "cite": "quote"}


def outside(text: Column, code: str, change: Callable[[Column], Column]) -> Column:
    """text with a change of what stands between the matches of code."""
    parts = F.zip_with(F.split(text, code), F.regexp_extract_all(text, F.lit(code), F.lit(0)), lambda prose, kept: F.concat(change(prose), F.coalesce(kept, F.lit(""))))
    return F.array_join(parts, "")


def strip_comments(text: Column) -> Column:
    """Without %%inline%% comments and blocks between lines of %%; one that isn't closed stays."""
    return outside(text, CODE, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?ms)^[ \t]*%%[ \t]*\n.*?^[ \t]*%%[ \t]*(?:\n|\z)", ""), r"%%[^\n]*?%%", ""))


def highlights(text: Column) -> Column:
    """==marked== words in <mark>."""
    return outside(text, CODE, lambda x: F.regexp_replace(x, r"==(?=\S)([^\n]*?\S)==", "<mark>$1</mark>"))


def tag_spans(text: Column) -> Column:
    """#tags, which begin with a letter after white space or a line's start, in <span class="tag">."""
    return outside(text, CODE, lambda x: F.regexp_replace(x, r"(?m)(^|(?<=\s))#([\p{L}_][\p{L}\p{N}_/-]*)", '<span class="tag">#$2</span>'))


def block_ids(text: Column) -> Column:
    """A ^id at the end of a line becomes an anchor."""
    return outside(text, FENCE, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?m)^\^([\p{L}\p{N}-]+)[ \t]*$", '<span id="$1"></span>'), r"(?m)[ \t]+\^([\p{L}\p{N}-]+)[ \t]*$", ' <span id="$1"></span>'))


def block(text: Column, name: Column) -> Column:
    """The lines in a row without a blank one that end with the marker ^name, or before it where it has a line of its own; else null."""
    marked = F.concat(F.lit(r"(?m)((?:^(?![ \t]*$)[^\n]*\n)*?^(?![ \t]*$)[^\n]*?)[ \t]*(?:\n(?:[ \t]*\n)*)?[ \t]*(?<![^\s])\^"), name, F.lit(r"[ \t]*$"))
    got = F.regexp_extract_all(text, marked, F.lit(1))
    return F.trim(F.get(got, 0))


def callouts(text: Column) -> Column:
    """Every callout outside fences, in order: kind as written, canonical kind, title and body without its quote marks."""
    found = F.regexp_extract_all(F.regexp_replace(text, FENCE, ""), F.lit(r"(?m)^[ \t]*>[ \t]*\[![\p{L}\p{N}_-]+\][^\n]*(?:\n[ \t]*>[^\n]*)*"), F.lit(0))
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def parts(block: Column) -> Column:
        kind = F.lower(F.regexp_extract(block, r"\[!([^\]]+)\]", 1))
        title = F.trim(F.regexp_extract(block, r"^[^\n]*?\][+-]?([^\n]*)", 1))
        body = F.regexp_replace(F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)$", 1), r"(?m)^[ \t]*>[ ]?", "")
        default = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)))
        return F.struct(kind.alias("kind"), F.coalesce(F.try_element_at(alias, kind), kind).alias("canonical"), F.when(title == "", default).otherwise(title).alias("title"), body.alias("body"))

    return F.transform(found, parts)


def bad_callouts(text: Column) -> Column:
    """Numbers of the lines outside fences whose callout has no closing bracket or no valid kind."""
    plain = F.split(F.array_join(F.zip_with(F.split(text, FENCE), F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), lambda prose, code: F.concat(prose, F.coalesce(F.regexp_replace(code, r"[^\n]", ""), F.lit("")))), ""), "\n")
    lines = F.transform(plain, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    bad = F.filter(lines, lambda x: x["text"].rlike(r"^\s*(?:>\s*)*\[!") & ~x["text"].rlike(r"^\s*(?:>\s*)*\[![\p{L}\p{N}_-]+\]"))
    return F.transform(bad, lambda x: x["line"])


def fences(text: Column) -> Column:
    """Every fenced block in order: its language and its lines."""
    found = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    return F.transform(found, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^[ \t]*(?:`{3,}|~{3,})([^\n]*)", 1)).alias("language"), F.regexp_replace(F.regexp_replace(b, r"^[^\n]*\n?", ""), r"\n?[ \t]*(?:`{3,}|~{3,})[^\n]*$", "").alias("body")))


def wikilinks(text: Column) -> Column:
    """Every [[target#anchor|display]] of a display text outside code, in order, and whether it embeds."""
    plain = F.regexp_replace(text, CODE, "")
    found = F.regexp_extract_all(plain, F.lit(r"!?\[\[[^\[\]\n]+\]\]"), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"\[\[([^#|\]^]*)", 1)).alias("target"), F.nullif(F.regexp_extract(x, r"[#]?((?<=#)[^|\]]+|\^[^|\]]+)", 1), F.lit("")).alias("anchor"), F.nullif(F.trim(F.regexp_extract(x, r"\|([^\]]*)", 1)), F.lit("")).alias("display"), x.startswith("!").alias("embed")
        ),
    )
