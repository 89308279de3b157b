"""Operator 8: licence detection by ordered signature rules.

A text is read as its words, in lower case with two spaces between them, so that any run of other characters, a line's end
or a comma, parts words alike. A rule (see license_rules) is a regular expression over such texts with a label, a priority
(smaller is stronger) and a keyword, a word that all its matches hold. A text without any of the gates, parts of words of
which every match of every rule holds one, is never matched; in the others a rule runs only if its keyword is there.

All matches become intervals of the text. In the order of their priority, then of their length, the longest first, then of
their start, an interval stays unless it overlaps one that stays: so a bare name inside a notice or inside a licence's
sentence is suppressed, and what a suppressed interval would have suppressed is not.

Words are runs of ASCII digits, letters and all other code points from U+0080; the case of A-Z alone doesn't count. Apart
from the rules, three base phrases are counted as runs of words; their labels stay whatever the rules find. score is the
weight of the strongest priority that stays, or that of a bare name where only base phrases are found. Only built-in
expressions are used, within the row: no shuffle.

Defined results: a null text is an empty one: no words, no labels, score 0; first_word and last_word are null without a
base phrase; a null doc_id passes through; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import let, table
from skerry.llm.license_rules import GATES, parsed

GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.6}
INTERVALS = "array<struct<priority:int,neg_size:int,start:int,label:string>>"


def spaced(regex: str) -> str:
    """An expression for texts of single spaces as one for double spaces, with a space at either end."""
    return " " + regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def rules() -> list[tuple[str, str, int, str]]:
    """(label, expression over double spaces, priority, keyword)."""
    return [(label, spaced(regex), priority, key) for label, regex, priority, key in parsed()]


def _n_words(part: Column) -> Column:
    """Words of a part of a text of double spaces, cut within such spaces."""
    return F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _intervals(text: Column, rule: Column) -> Column:
    """Priority, size (as a negative number, for sorting), start and label of each match of a rule."""
    lengths = F.zip_with(
        F.split(text, rule["regex"]), F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda between, match: F.struct(F.length(between).alias("skip"), F.length(match).alias("size"))
    )

    def add(s: Column, x: Column) -> Column:
        found = F.struct(rule["priority"].alias("priority"), (-x["size"]).alias("neg_size"), (s["at"] + x["skip"]).alias("start"), rule["label"].alias("label"))
        return F.when(x["size"].isNull(), s).otherwise(F.struct((s["at"] + x["skip"] + x["size"]).alias("at"), F.concat(s["out"], F.array(found)).alias("out")))

    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast(INTERVALS).alias("out")), add, lambda s: s["out"])


def _resolved(found: Column) -> Column:
    """Sorted intervals without those that overlap one that stays."""

    def add(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["start"] < x["start"] - x["neg_size"]) & (x["start"] < k["start"] - k["neg_size"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.sort_array(found), F.array().cast(INTERVALS), add)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections (label and words from and to) of every document."""
    plain = F.regexp_replace(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")), GAP, " ")
    rows = docs.select("doc_id", plain.alias("_plain")).withColumn("_low", F.lower("_plain"))
    gate = functools.reduce(operator.or_, (F.contains("_low", F.lit(g)) for g in GATES))
    rows = rows.select(
        "doc_id",
        (F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        F.when(gate, F.replace(F.translate("_plain", UPPER, LOWER), F.lit(" "), F.lit("  "))).otherwise("").alias("_words"),
    )
    words = F.col("_words")
    # the parts between a base phrase's places, if it has any
    cut = {p: F.when(F.contains(words, F.lit(spaced(p))), F.split(words, spaced(p))) for p in BASE}
    all_rules = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(priority).alias("priority"), F.lit(key).alias("key")) for label, regex, priority, key in rules()))
    runs = F.flatten(F.transform(F.filter(all_rules, lambda r: F.contains(words, r["key"])), lambda r: _intervals(words, r)))
    found = F.when(words != "", let(runs, _resolved)).otherwise(F.array().cast(INTERVALS))
    rows = rows.select("doc_id", "n_words", "_words", *(c.alias(f"_{v}") for (p, v), c in zip(BASE.items(), cut.values(), strict=True)), found.alias("_found"))
    parts = {p: F.col(f"_{v}") for p, v in BASE.items()}
    n_base = functools.reduce(operator.add, (F.coalesce(F.size(x) - 1, F.lit(0)) for x in parts.values()))
    first = F.least(*(_n_words(x[0]) for x in parts.values()))
    last = F.greatest(*(F.col("n_words") - _n_words(F.element_at(x, -1)) - len(p.split()) for p, x in parts.items()))
    base = F.array_compact(F.array(*(F.when(parts[p].isNotNull(), F.lit(v)) for p, v in BASE.items())))
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    before = lambda x: _n_words(F.substring(F.col("_words"), F.lit(1), x["start"]))
    inside = lambda x: _n_words(F.substring(F.col("_words"), x["start"] + 1, -x["neg_size"]))
    return rows.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, F.transform("_found", lambda x: x["label"]))))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda x: weight[x["priority"]])), F.when(n_base > 0, F.lit(WEIGHTS[5])), F.lit(0.0)).alias("score"),
        F.transform("_found", lambda x: F.struct(x["label"].alias("label"), before(x).alias("first_word"), (before(x) + inside(x)).alias("end_word"))).alias("detections"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


def oracle() -> str:
    """The same in SQL: the rules as a table, each text's matches numbered in order, and a recursion that keeps or suppresses one after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table_of = ", ".join(f"({quoted(label)}, {quoted(regex)}, {priority}, {quoted(key)})" for label, regex, priority, key in rules())
    gap = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
    count = "CAST(floor((length({0}) - length(replace({0}, ' ', ''))) / 2) AS BIGINT)"
    cuts = ", ".join(f"CASE WHEN contains(words, {quoted(spaced(p))}) THEN string_split(words, {quoted(spaced(p))}) END AS p_{v}" for p, v in BASE.items())
    n_base = " + ".join(f"coalesce(len(p_{v}) - 1, 0)" for v in BASE.values())
    first = ", ".join(count.format(f"p_{v}[1]") for v in BASE.values())
    last = ", ".join(f"n_words - {count.format(f'p_{v}[-1]')} - {len(p.split())}" for p, v in BASE.items())
    base = "list_filter([" + ", ".join(f"CASE WHEN p_{v} IS NOT NULL THEN '{v}' END" for v in BASE.values()) + "], lambda x: x IS NOT NULL)"
    weight = "CASE p " + " ".join(f"WHEN {k} THEN {v}" for k, v in WEIGHTS.items()) + " END"
    return f"""
WITH RECURSIVE rules(label, regex, priority, key) AS (VALUES {table_of}),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(' ' || coalesce(text, '') || ' ', '{gap}', ' ', 'g') AS plain FROM documents),
d AS (SELECT rid, doc_id, CAST(length(plain) - length(replace(plain, ' ', '')) - 1 AS BIGINT) AS n_words, replace(translate(plain, '{UPPER}', '{LOWER}'), ' ', '  ') AS words FROM t),
b AS (SELECT *, {cuts} FROM d),
h AS (SELECT rid, label, priority, regexp_extract_all(words, regex) AS hits, string_split_regex(words, regex) AS parts FROM d JOIN rules ON contains(words, key) WHERE regexp_matches(words, regex)),
i AS (SELECT rid, label, priority, unnest(range(1, len(hits) + 1)) AS n, hits, parts FROM h),
s AS (SELECT rid, label, priority, length(hits[n]) AS size, coalesce(list_sum(list_transform(parts[1:n], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda x: length(x))), 0) AS start FROM i),
o AS (SELECT rid, label, priority, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, row_number() OVER (PARTITION BY rid ORDER BY priority, size DESC, start, label) AS k FROM s),
r AS (
  SELECT rid, 0::BIGINT AS k, CAST([] AS STRUCT(label VARCHAR, priority INTEGER, start BIGINT, stop BIGINT)[]) AS kept FROM (SELECT DISTINCT rid FROM o)
  UNION ALL
  SELECT r.rid, o.k, CASE WHEN len(list_filter(r.kept, lambda x: x.start < o.stop AND o.start < x.stop)) > 0 THEN r.kept
    ELSE list_append(r.kept, CAST({{'label': o.label, 'priority': o.priority, 'start': o.start, 'stop': o.stop}} AS STRUCT(label VARCHAR, priority INTEGER, start BIGINT, stop BIGINT))) END
  FROM r JOIN o ON o.rid = r.rid AND o.k = r.k + 1
),
f AS (SELECT rid, arg_max(kept, k) AS kept FROM r GROUP BY rid),
x AS (SELECT b.*, {base} AS base, coalesce(list_distinct(list_transform(kept, lambda x: x.label)), []) AS own, list_min(list_transform(kept, lambda x: x.priority)) AS p FROM b LEFT JOIN f USING (rid))
SELECT doc_id, n_words, CAST({n_base} AS BIGINT) AS n_base, least({first}) AS first_word, greatest({last}) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels, CAST(coalesce({weight}, CASE WHEN {n_base} > 0 THEN {WEIGHTS[5]} END, 0.0) AS DOUBLE) AS score FROM x"""
