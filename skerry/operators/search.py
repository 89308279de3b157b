"""Ranked text search with BM25 over the fields of a table, by a scan; text_index has the stored index.

search() makes two scans and needs no index: the first one gathers the statistics of the query's terms (one row), the
second scores and keeps the top k. Only term counts of the query are computed, inside the row, so nothing is shuffled but
the k best of each task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import values as V
from skerry.functions.transforms import FENCE

K1, B = 1.2, 0.75
LONG = 40
BOOSTS = {"title": 2.0, "headings": 1.5, "body": 1.0}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, of fewer than LONG bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < LONG))


@dataclass
class Clause:
    """One word or phrase of a query: + required, - excluded, else optional; in one field or in all."""

    words: list[str]
    field: str | None = None
    sign: str = ""


@dataclass
class Query:
    clauses: list[Clause] = field(default_factory=list)


_PART = re.compile(r'\s*([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse(text: str, fields: list[str]) -> Query:
    """Words are alternatives; "a phrase", field:word, +required and -excluded are understood; AND and OR between words too."""
    if text.count('"') % 2:
        raise EngineError("index/invalid-query", "a phrase isn't closed")
    out, conjunction = Query(), False
    for sign, name, phrase, word in _PART.findall(text):
        if word in ("AND", "OR"):
            if word == "AND" and out.clauses:
                out.clauses[-1].sign = out.clauses[-1].sign or "+"
            conjunction = word == "AND"
            continue
        if name and name not in fields:
            raise EngineError("index/invalid-query", f"no field {name}")
        words = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if words:
            out.clauses.append(Clause(words, name or None, sign or ("+" if conjunction else "")))
        conjunction = False
    if not out.clauses:
        raise EngineError("index/invalid-query", "the query has no words")
    return out


def frequency(words: Column, clause: Clause) -> Column:
    """How often a word, or the words of a phrase in a row, occur among tokens."""
    if len(clause.words) == 1:
        return F.size(F.filter(words, lambda t: t == clause.words[0]))
    # tokens hold letters and digits only, so a phrase is a part of their joint text, with two spaces between them
    text = F.concat(F.lit("  "), F.array_join(words, "  "), F.lit("  "))
    phrase = " " + "  ".join(clause.words) + " "
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def under(path: Column, prefix: str) -> Column:
    """A path is the prefix or below it: whole segments, case-sensitive."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def has_tag(tags: Column, tag: str) -> Column:
    """Hierarchical: project matches project/alpha."""
    return F.coalesce(F.exists(tags, lambda t: (t == tag) | t.startswith(tag + "/")), F.lit(False))


def field_equals(document: Column, key: str, value: object) -> Column:
    """A frontmatter field, or with a dotted key one inside another, equals a scalar or is an array with this string."""
    if value is None or isinstance(value, (list, dict)):
        raise EngineError("index/invalid-query", f"{key} must be compared with a scalar")
    *above, last = key.split(".")
    for name in above:
        document = V.of_json(document, name)["json"]
    lanes = V.of_json(document, last)
    inside = F.array_contains(lanes["strings"], value) if isinstance(value, str) else F.lit(False)
    return V.equals(lanes, value) | F.coalesce(inside, F.lit(False))


def search(df: DataFrame, key: str, query: str, k: int = 20, boosts: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """The k best rows of df that satisfy `where`: key, score (ties by key), over the columns named in boosts.

    Statistics are those of all rows; filters restrict the result and don't add to scores."""
    boosts = boosts or {c: w for c, w in BOOSTS.items() if c in df.columns}
    q = parse(query, list(boosts))
    split = df.select("*", *(tokens(F.col(f)).alias(f"_t_{f}") for f in boosts))
    counted, used_ = [F.size(f"_t_{f}").alias(f"_n_{f}") for f in boosts], used(q, boosts)
    counted += [frequency(F.col(f"_t_{f}"), clause).alias(f"_tf_{i}_{f}") for i, f, clause in used_]
    rows = split.select(*df.columns, *counted)
    stats = rows.agg(F.count("*").alias("_rows"), *(F.avg(f"_n_{f}").alias(f"_avg_{f}") for f in boosts), *(F.count_if(F.col(f"_tf_{i}_{f}") > 0).alias(f"_df_{i}_{f}") for i, f, _ in used_))
    return best(rows if where is None else rows.where(where), stats, q, used_, boosts, df.columns, key, k)


def used(q: Query, boosts: dict[str, float]) -> list[tuple[int, str, Clause]]:
    return [(i, f, clause) for i, clause in enumerate(q.clauses) for f in (boosts if clause.field is None else [clause.field])]


def best(rows: DataFrame, stats: DataFrame, q: Query, used: list, boosts: dict[str, float], columns: list[str], key: str, k: int) -> DataFrame:
    """The k best of rows, which have _n_<field> and _tf_<clause>_<field>, by one row of statistics."""
    scored = rows.crossJoin(F.broadcast(stats))
    score, found = F.lit(0.0), {i: F.lit(False) for i in range(len(q.clauses))}
    for i, f, clause in used:
        tf, df_ = F.col(f"_tf_{i}_{f}"), F.col(f"_df_{i}_{f}")
        found[i] = found[i] | (tf > 0)
        if clause.sign == "-":
            continue
        idf = F.ln(1 + (F.col("_rows") - df_ + 0.5) / (df_ + 0.5))
        score = score + F.when(tf > 0, boosts[f] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"_n_{f}") / F.col(f"_avg_{f}")))).otherwise(0.0)
    keep = score > 0
    for i, clause in enumerate(q.clauses):
        keep = keep & (found[i] if clause.sign == "+" else ~found[i]) if clause.sign else keep
    return scored.where(keep).select(*columns, score.alias("score")).orderBy(F.desc("score"), key).limit(max(k, 1))


def snippet(text: Column, words: list[str], size: int = 240) -> Column:
    """The fragment of at most `size` characters with most matches, the first of equals, marked and after the heading above it; without a match the first 160 characters."""
    pattern = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])"
    lengths = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda between, match: F.struct(F.length(between).alias("skip"), F.length(match).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,end:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        at, end = s["at"] + x["skip"], s["at"] + x["skip"] + x["size"]
        return F.when(x["size"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("at"), end.alias("end")))).alias("out")))

    def best(hits: Column) -> Column:
        """Where the fragment begins: a quarter of its size before the hit after which most others fit."""
        scored = F.transform(hits, lambda x: F.struct(F.size(F.filter(hits, lambda y: (y["at"] >= x["at"]) & (y["end"] <= x["at"] + size * 3 // 4))).alias("n"), (-x["at"]).alias("neg_at")))
        return F.greatest(-F.array_max(scored)["neg_at"] - size // 4, F.lit(0))

    def shown(at: Column) -> Column:
        marked = F.regexp_replace(F.substring(text, at + 1, F.lit(size)), "(" + pattern + ")", "<b>$1</b>")
        above = F.regexp_extract_all(F.regexp_replace(F.substring(text, F.lit(1), at + 1), FENCE, ""), F.lit(r"(?m)^[ \t]*#{1,6}[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$"), F.lit(1))
        return F.concat(F.coalesce(F.concat(F.try_element_at(above, F.lit(-1)), F.lit(" › ")), F.lit("")), marked)

    hits = F.aggregate(lengths, start, add, lambda s: s["out"])
    found = F.transform(F.array(hits), lambda x: F.when(F.size(x) > 0, best(x)))[0]
    return F.transform(F.array(found), lambda at: F.when(at.isNull(), F.substring(F.trim(text), 1, 160)).otherwise(shown(at)))[0]
