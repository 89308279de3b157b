"""Registered queries over the driver's tables, and the SQL that each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry import store
from skerry.functions import astro, transforms, values
from skerry.operators import chunks, files, graph, listing, quality, render, search, semantic, sync, vectors
from skerry.operators.text_index import TextIndex
from skerry.plans import base_query as bq
from skerry.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(name: str, table: str, definition: dict, sql: str, ties: list[str], change=lambda df: df) -> None:
    """Register a view query over a table."""
    query(sql, name)(lambda spark, d: bq.run(change(read(spark, d, table)), bq.from_inline(definition), ties))


# --- view queries: filters, sort, limit, columns ----------------------------------------------------------------------

view(
    "base_query_flagship", "documents",
    {"filters": {"and": ['lang == "en"', {"not": ['source == "src7"']}, 'text.contains("the")']}, "order": ["doc_id", "source", "n_chars"], "sort": [{"property": "n_chars", "direction": "DESC"}], "limit": 25},
    "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND NOT source = 'src7' AND contains(text, 'the') ORDER BY n_chars DESC, doc_id LIMIT 25", ["doc_id"],
)
view("base_filter_eq_and", "documents", {"filters": {"and": ['lang == "fr"', 'source == "src4"']}, "order": ["doc_id", "lang"]}, "SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND source = 'src4'", ["doc_id"])
view("base_or_not", "customer", {"filters": {"or": ['c_mktsegment == "BUILDING"', {"not": ["c_nationkey != 3"]}]}, "order": ["c_custkey", "c_mktsegment"]}, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3", ["c_custkey"])
view("base_nand", "customer", {"filters": {"not": ['c_mktsegment == "BUILDING"', "c_nationkey == 3"]}, "order": ["c_custkey"]}, "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 3)", ["c_custkey"])
view("base_contains", "part", {"filters": 'p_name.contains("e")', "order": ["p_partkey", "p_name"]}, "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e')", ["p_partkey"])
view("base_missing_ne", "nation", {"filters": 'status != "done"', "order": ["n_nationkey"]}, "SELECT n_nationkey FROM nation", ["n_nationkey"])
view("base_empty_operands", "region", {"filters": {"and": [{"and": []}, {"not": [{"or": []}]}]}, "order": ["r_regionkey"]}, "SELECT r_regionkey FROM region WHERE true AND NOT false", ["r_regionkey"])
view("base_typed_equality", "part", {"filters": {"or": ["p_size == 7", "p_size == 8.0", 'p_size == "9"']}, "order": ["p_partkey", "p_size"]}, "SELECT p_partkey, p_size FROM part WHERE p_size = 7", ["p_partkey"])
view(
    "base_string_expr_precedence", "orders", {"filters": 'o_orderstatus == "F" || o_orderstatus == "O" && !(o_orderpriority == "1-URGENT")', "order": ["o_orderkey", "o_orderstatus", "o_orderpriority"]},
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND NOT o_orderpriority = '1-URGENT')", ["o_orderkey"],
)
view("base_sort_multi_limit", "customer", {"order": ["c_custkey", "c_nationkey", "c_acctbal"], "sort": [{"property": "c_nationkey"}, {"property": "c_acctbal", "direction": "DESC"}], "limit": 40}, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 40", ["c_custkey"])
view("base_formula_marker", "nation", {"order": ["n_name", "formula.twice", "formula.name"], "formulas": {"twice": "n_nationkey * 2", "name": "n_name"}}, "SELECT n_name, 'formula.twice (not evaluated)' AS \"formula.twice\", n_name AS \"formula.name\" FROM nation", ["n_nationkey"])


def _paged(df: DataFrame) -> DataFrame:
    """Pages as notes: the path and folder of their url, and a title."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+/?(.*)$", 1), "/+$", "")
    rows = df.withColumn("path", path).withColumn("folder", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1)).withColumn("basename", F.element_at(F.split("path", "/"), -1))
    return rows.withColumn("title", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).withColumn("body", F.regexp_replace("html", "(?s)<[^>]*>", " "))


PAGES = r"""(SELECT *, regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) AS folder, list_last(string_split(path, '/')) AS basename, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
  regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS body FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1), '/+$', '') AS path FROM pages))"""


view("base_in_folder", "pages", {"filters": 'file.inFolder("en") || file.inFolder("fr/")', "order": ["page_id", "file.path"]}, f"SELECT page_id, path AS \"file.path\" FROM {PAGES} WHERE folder IN ('en', 'fr') OR starts_with(folder, 'en/') OR starts_with(folder, 'fr/')", ["page_id"], _paged)


@query(f"SELECT page_id, '[[' || path || '|' || basename || ']]' AS link FROM {PAGES}")
def base_formula_aslink(spark, d):
    rows = bq.run(_paged(read(spark, d, "pages")), bq.from_inline({"order": ["page_id", "formula.l"], "formulas": {"l": "file.asLink()"}}), ["page_id"])
    return rows.select("page_id", render.cell(rows, "formula.l").alias("link"))


@query("SELECT p_partkey, p_type FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'steel')")
def base_has_tag(spark, d):
    tagged = read(spark, d, "part").withColumn("tags", F.split(F.lower("p_type"), " "))
    return bq.run(tagged, bq.from_inline({"filters": 'file.hasTag("steel")', "order": ["p_partkey", "p_type"]}), ["p_partkey"])


@query("SELECT count(*) AS matched FROM orders WHERE o_orderstatus = 'O'")
def base_matched_count(spark, d):
    return bq.matched(read(spark, d, "orders"), bq.from_inline({"filters": 'o_orderstatus == "O"', "order": ["o_orderkey"], "limit": 3}))


@query("""SELECT event_id, rank, number FROM (SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE 2 END AS rank, v AS number FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS v FROM events)) ORDER BY rank NULLS FIRST, number NULLS FIRST, event_id""")
def base_null_rank_sort(spark, d):
    """Sorting by a dynamic property that a third of the rows lack."""
    props = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.col("props"))
    rows = read(spark, d, "events").select("event_id", props.alias("frontmatter_json"))
    lanes = bq.Properties(rows).lanes("k")
    return rows.orderBy(*values.order_keys(lanes), "event_id").select("event_id", lanes["rank"].alias("rank"), lanes["i"].alias("number"))


@query("SELECT n_nationkey || ',' || CASE WHEN n_name LIKE '%,%' THEN '\"' || n_name || '\"' ELSE n_name END || ',\"a \"\"quoted\"\", b\"' AS line FROM nation")
def base_render_csv(spark, d):
    return render.csv_lines(read(spark, d, "nation").select("n_nationkey", "n_name", F.lit('a "quoted", b').alias("c")))


@query(r"SELECT '| ' || n_nationkey || ' | ' || n_name || ' | a\|b c |' AS line FROM nation")
def base_render_table(spark, d):
    return render.table_lines(read(spark, d, "nation").select("n_nationkey", "n_name", F.lit("a|b\nc").alias("c")))


@query("""SELECT event_type, round(avg(value), 6) AS value_average, min(value) AS value_min, max(user_id) AS user_id_max, count(DISTINCT user_id) AS user_id_unique, count(*) AS n FROM events GROUP BY event_type""")
def base_groupby_summaries(spark, d):
    df = read(spark, d, "events").withColumns({"value_": F.col("value"), "user_id_": F.col("user_id"), "n": F.lit(1)})
    made = {}
    for names in ({"value": "Average", "user_id": "Max", "n": "Count"}, {"value": "Min", "user_id": "Unique"}):
        made[str(names)] = bq.summarize(df, bq.from_inline({"order": ["event_type"], "groupBy": {"property": "event_type"}, "summaries": names}))
    a, b = made.values()
    return a.join(b, "event_type").select("event_type", F.round("value_average", 6).alias("value_average"), "value_min", "user_id_max", "user_id_unique", F.col("n_count").alias("n"))


@query("""SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum, median(l_extendedprice) AS l_extendedprice_median, max(l_shipdate) AS l_shipdate_latest, max(l_tax) - min(l_tax) AS l_tax_range, round(stddev(l_discount), 8) AS l_discount_stddev,
  count(l_linestatus) AS l_linestatus_filled, min(l_orderkey) AS l_orderkey_earliest, count(*) FILTER (l_partkey IS NULL) AS l_partkey_empty FROM lineitem GROUP BY l_returnflag""")
def base_groupby_more_summaries(spark, d):
    kinds = {"l_quantity": "Sum", "l_extendedprice": "Median", "l_shipdate": "Latest", "l_tax": "Range", "l_discount": "Stddev", "l_linestatus": "Filled", "l_orderkey": "Earliest", "l_partkey": "Empty"}
    got = bq.summarize(read(spark, d, "lineitem"), bq.from_inline({"order": ["l_returnflag"], "groupBy": {"property": "l_returnflag"}, "summaries": kinds}))
    return got.withColumn("l_discount_stddev", F.round("l_discount_stddev", 8))


# --- text search -------------------------------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND strlen(t) < 40)"


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS n_tokens, len(list_distinct({WORDS.format('text')})) AS n_distinct FROM documents")
def text_tokens(spark, d):
    t = search.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def _bm25_sql(table: str, key: str, fields: dict[str, float], words: list[str], k: int, where: str = "true", require: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(t_{f}, lambda x: x = '{w}')) AS tf_{f}_{i}" for f in fields for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf_{f}_{i} > 0) AS df_{f}_{i}" for f in fields for i in range(len(words)))
    score = " + ".join(f"CASE WHEN tf_{f}_{i} > 0 THEN {b} * ln(1 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * tf_{f}_{i} * 2.2 / (tf_{f}_{i} + 1.2 * (0.25 + 0.75 * len(t_{f}) / avg_{f})) ELSE 0 END" for f, b in fields.items() for i in range(len(words)))
    return f"""WITH tok AS (SELECT *, {', '.join(f'{WORDS.format(f)} AS t_{f}' for f in fields)} FROM {table}),
      c AS (SELECT *, {tf} FROM tok), s AS (SELECT count(*) AS n, {', '.join(f'avg(len(t_{f})) AS avg_{f}' for f in fields)}, {df} FROM c)
      SELECT {key}, round(score, 6) AS score FROM (SELECT {key}, {score} AS score FROM c, s WHERE ({where}) AND ({require})) WHERE score > 0 ORDER BY round(score, 9) DESC, {key} LIMIT {k}"""


def _hits(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.round("score", 6).alias("score"))


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen"], 20))
def text_bm25_topk(spark, d):
    return _hits(search.search(read(spark, d, "documents"), "doc_id", "onen", 20, {"text": 1.0}), "doc_id")


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen", "thre", "eaux"], 20))
def text_multi_term(spark, d):
    return _hits(search.search(read(spark, d, "documents"), "doc_id", "onen thre eaux", 20, {"text": 1.0}), "doc_id")


@query(_bm25_sql(PAGES, "page_id", {"title": 2.0, "body": 1.0}, ["the", "of"], 20))
def text_field_boost(spark, d):
    return _hits(search.search(_paged(read(spark, d, "pages")), "page_id", "the of", 20, {"title": 2.0, "body": 1.0}), "page_id")


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen", "thre"], 20, require="tf_text_0 > 0 AND tf_text_1 > 0"))
def text_required_terms(spark, d):
    return _hits(search.search(read(spark, d, "documents"), "doc_id", "+onen +thre", 20, {"text": 1.0}), "doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS w FROM documents) WHERE contains(w, ' of the ')")
def text_phrase(spark, d):
    docs = read(spark, d, "documents")
    clause = search.parse('"of the"', ["text"]).clauses[0]
    return docs.withColumn("_t", search.tokens(F.col("text"))).where(search.frequency(F.col("_t"), clause) > 0).select("doc_id")


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen"], 20, where="lang <> 'de' AND source <> 'src3'"))
def text_exclude_scope(spark, d):
    keep = ~search.under(F.col("source"), "src3") & (F.col("lang") != "de")
    return _hits(search.search(read(spark, d, "documents"), "doc_id", "onen", 20, {"text": 1.0}, keep), "doc_id")


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen"], 20, where="lang = 'en'"))
def text_field_filter(spark, d):
    docs = read(spark, d, "documents").withColumn("frontmatter_json", F.to_json(F.struct("lang", "source")))
    return _hits(search.search(docs, "doc_id", "onen", 20, {"text": 1.0}, search.field_equals(F.col("frontmatter_json"), "lang", "en")), "doc_id")


@query("""SELECT p_partkey FROM (SELECT *, lower(p_brand) || '/' || replace(lower(p_type), ' ', '/') AS tag FROM part) WHERE tag = 'brand#1' OR starts_with(tag, 'brand#1/') OR tag = 'brand#13/small' OR starts_with(tag, 'brand#13/small/')""")
def text_tag_hierarchy(spark, d):
    """Tags like brand#13/small: a shorter one matches those below it, whole segments only."""
    tag = F.concat(F.lower("p_brand"), F.lit("/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")))
    tagged = read(spark, d, "part").withColumn("tags", F.array(F.lit("other"), tag))
    return tagged.where(search.has_tag(F.col("tags"), "brand#1") | search.has_tag(F.col("tags"), "brand#13/small")).select("p_partkey")


def _indexed(spark: SparkSession, rows: DataFrame) -> TextIndex:
    """A new index of doc_id and text, with the checksum of a text as its stamp."""
    index = TextIndex(spark, store.new_path(spark, "index"), "doc_id", ["text"])
    index.upsert(rows, _stamp())
    return index


def _stamp() -> Column:
    return F.crc32(F.col("text").cast("binary")).cast("string")


_LATER = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'onen onen' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"""


def _later(docs: DataFrame) -> DataFrame:
    """Documents after a fifth of them went and a seventh of the texts changed."""
    return docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "onen onen").otherwise(F.col("text"))).select("doc_id", "text")


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["onen", "thre"], 20))
def text_stored_index(spark, d):
    """The same as a scan, from postings that are stored once; of these only levels that can hold a hit are read."""
    return _hits(_indexed(spark, read(spark, d, "documents")).query("onen thre", 20, {"text": 1.0}), "doc_id")


@query(_bm25_sql(_LATER, "doc_id", {"text": 1.0}, ["onen"], 20))
def text_refreshed_index(spark, d):
    """An index brought up to date after rows went and texts changed: a segment each for what changed and what went."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    index = _indexed(spark, docs)
    index.refresh(_later(docs), _stamp())
    return _hits(index.query("onen", 20, {"text": 1.0}), "doc_id")


@query(_bm25_sql(_LATER, "doc_id", {"text": 1.0}, ["onen", "eaux"], 20))
def text_upserted_segments(spark, d):
    """Texts replaced by key in three updates, rows removed, and the later segments joined into one."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    index, now = _indexed(spark, docs.where("doc_id % 3 <> 0")), _later(docs)
    index.upsert(docs.where("doc_id % 3 = 0"), _stamp())
    index.upsert(now.where("doc_id % 7 = 0"), _stamp())
    index.remove(docs.where("doc_id % 5 = 0").select("doc_id"))
    index.compact(keep=1)
    return _hits(index.query("onen eaux", 20, {"text": 1.0}), "doc_id")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS term FROM {_LATER}) GROUP BY term")
def text_index_dictionary(spark, d):
    """How many live rows have each term, from the dictionaries of all segments."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    index = _indexed(spark, docs)
    index.refresh(_later(docs), _stamp())
    return index.dictionary().select("term", "df")


# --- documents -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def doc_hash_and_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), chunks.estimate_tokens(F.col("text")).alias("tokens"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents)"


@query(f"SELECT doc_id, line_no, line FROM {_LINES} WHERE line_no <= 2")
def doc_lines_head(spark, d):
    return listing.lines(read(spark, d, "documents"), "doc_id", "text", head=2)


@query(f"SELECT doc_id, line_no, line FROM {_LINES} WHERE line_no > n - 2")
def doc_lines_tail(spark, d):
    return listing.lines(read(spark, d, "documents"), "doc_id", "text", tail=2)


@query(f"SELECT doc_id, line_no, line FROM {_LINES} WHERE line_no BETWEEN 2 AND 4")
def doc_lines_range(spark, d):
    return listing.lines(read(spark, d, "documents"), "doc_id", "text", between=(2, 4))


@query()
def chunk_documents(spark, d):
    return chunks.chunk(read(spark, d, "documents"), "doc_id", "text")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")
def conversation_thread(spark, d):
    return sync.ordinals(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "ordinal")


# --- graph -----------------------------------------------------------------------------------------------------------------

_HREFS = f"""(SELECT page_id, p.path AS "from", ltrim(h.target, '/') AS target, h.pos AS pos FROM {PAGES} p, (SELECT page_id AS pid, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages) h WHERE p.page_id = h.pid AND ltrim(h.target, '/') <> '')"""


def _page_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = _paged(read(spark, d, "pages"))
    links = pages.select(F.col("page_id"), F.col("path").alias("from"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "target"))
    links = links.select(F.concat_ws("#", F.col("page_id").cast("string"), F.col("pos").cast("string")).alias("edge_id"), "from", F.ltrim("target", F.lit("/")).alias("target"), F.lit("link").alias("kind"))
    return graph.resolve(links, pages.select("path", "title"))


_RESOLVED = f"""(SELECT page_id || '#' || pos AS edge_id, "from", coalesce(n1.path, n2.path, s.path, target) AS "to", coalesce(n1.path, n2.path, s.path) IS NULL AS phantom FROM {_HREFS} h
  LEFT JOIN (SELECT DISTINCT path FROM {PAGES}) n1 ON n1.path = target LEFT JOIN (SELECT DISTINCT path FROM {PAGES}) n2 ON n2.path = target || '.md'
  LEFT JOIN (SELECT regexp_replace(list_last(string_split(path, '/')), '\\.md$', '', 'i') AS stem, min(path) AS path FROM {PAGES} GROUP BY 1) s ON s.stem = target AND NOT contains(target, '/'))"""


@query(f'SELECT edge_id, "from", "to" FROM {_RESOLVED}')
def graph_edges(spark, d):
    return _page_graph(spark, d)[1].select("edge_id", "from", "to")


@query(f"""SELECT "to" AS path, list_sort(list(DISTINCT "from")) AS backlinks FROM {_RESOLVED} GROUP BY 1""")
def graph_backlinks(spark, d):
    return graph.backlinks(_page_graph(spark, d)[1])


@query(f'SELECT DISTINCT path FROM {PAGES} WHERE path NOT IN (SELECT "from" FROM {_RESOLVED}) AND path NOT IN (SELECT "to" FROM {_RESOLVED})')
def graph_orphans(spark, d):
    return graph.orphans(*_page_graph(spark, d)).select("path")


@query(f'SELECT DISTINCT "to" AS target FROM {_RESOLVED} WHERE phantom')
def graph_unresolved(spark, d):
    return graph.unresolved(*_page_graph(spark, d))


@query(f'SELECT (SELECT count(DISTINCT path) FROM {PAGES}) + (SELECT count(DISTINCT "to") FROM {_RESOLVED} WHERE phantom) AS nodes, (SELECT count(*) FROM {_RESOLVED}) AS edges')
def graph_counts(spark, d):
    nodes, edges = _page_graph(spark, d)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def _trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers, nations and regions as a graph."""
    parts = [("customer", "c_custkey", "c", "c_nationkey", "n"), ("supplier", "s_suppkey", "s", "s_nationkey", "n"), ("nation", "n_nationkey", "n", "n_regionkey", "r")]
    out = None
    for table, a, x, b, y in parts:
        rows = read(spark, d, table).select(F.concat(F.lit(x), F.col(a)).alias("edge_id"), F.concat(F.lit(x), F.col(a)).alias("from"), F.concat(F.lit(y), F.col(b)).alias("to"), F.lit("link").alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


_TRADE = "(SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _distance_sql(start: str, depth: int, both: bool) -> str:
    steps = f"(SELECT a, b FROM {_TRADE} UNION SELECT b, a FROM {_TRADE})" if both else _TRADE
    return f"WITH RECURSIVE w AS (SELECT '{start}' AS path, 0 AS distance UNION SELECT s.b, w.distance + 1 FROM w JOIN {steps} s ON s.a = w.path WHERE w.distance < {depth}) SELECT path, min(distance) AS distance FROM w GROUP BY path"


for _depth in (1, 2, 3):
    query(_distance_sql("c1", _depth, True), f"graph_neighbours_d{_depth}")(lambda spark, d, n=_depth: graph.distances(_trade_graph(spark, d), "c1", n, "both"))


@query(f"SELECT a AS edge_id, a AS \"from\", b AS \"to\" FROM {_TRADE} WHERE a = 'c1' OR a IN (SELECT b FROM {_TRADE} WHERE a = 'c1')")
def graph_neighbour_edges_out(spark, d):
    return graph.neighbours(_trade_graph(spark, d), "c1", 2, "out")[1].select("edge_id", "from", "to")


@query("SELECT 0 AS hop, 'c1' AS path UNION ALL SELECT 1, 'n' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def graph_path(spark, d):
    edges = _trade_graph(spark, d)
    nation = read(spark, d, "customer").where("c_custkey = 1").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return graph.shortest_path(edges, "c1", f"r{nation}")


# --- vectors ---------------------------------------------------------------------------------------------------------------


def _probe(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _knn_sql(where: str) -> str:
    return f"SELECT vec_id, label, round(score, 5) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings WHERE {where}) ORDER BY score DESC, vec_id LIMIT 10"


def _knn(spark: SparkSession, d: str, where: Column | None) -> DataFrame:
    return vectors.nearest(read(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 10, where).withColumn("score", F.round("score", 5))


query(_knn_sql("true"), "knn_topk")(lambda spark, d: _knn(spark, d, None))
query(_knn_sql("label = 3"), "knn_scoped")(lambda spark, d: _knn(spark, d, F.col("label") == 3))
query(_knn_sql("label <> 0"), "knn_excluded")(lambda spark, d: _knn(spark, d, F.col("label") != 0))
query("SELECT count(DISTINCT label) AS paths, count(*) AS vectors FROM embeddings", "vector_stats")(lambda spark, d: vectors.statistics(read(spark, d, "embeddings"), "label"))


def _hash_sql(text: str) -> str:
    part = lambda i, at: f"CAST('0x' || substring(sha256(encode({text}) || unhex('{i:02x}{'0' * 14}')), {at}, 2) AS INTEGER)"
    return "[" + ", ".join(f"CAST(({part(i, 1)} + {part(i, 3)} * 256) / 65535.0 * 2 - 1 AS FLOAT)" for i in range(16)) + "]"


@query(f"SELECT doc_id, round(list_sum(e), 4) AS total, round(e[1], 5) AS first, round(e[16], 5) AS last FROM (SELECT doc_id, {_hash_sql('text')} AS e FROM documents)")
def hash_embeddings(spark, d):
    e = read(spark, d, "documents").select("doc_id", vectors.hash_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.element_at("e", 1).cast("double"), 5).alias("first"), F.round(F.element_at("e", 16).cast("double"), 5).alias("last"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as chunks of notes."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("ordinal"), "text").dropDuplicates(["path", "ordinal"])
    return rows.where("text IS NOT NULL").select("path", "ordinal", F.array(F.lit("H")).alias("heading_context"), "text", F.sha2("text", 256).alias("content_hash"))


_TURNS = "(SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INTEGER) AS ordinal, any_value(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL)"


@query(f"""SELECT path, ordinal, round(score, 5) AS score FROM (SELECT path, ordinal, list_cosine_similarity(CAST({_hash_sql('text')} AS DOUBLE[]), CAST({_hash_sql("'hello there'")} AS DOUBLE[])) AS score FROM {_TURNS})
  ORDER BY score DESC, path LIMIT 12""")
def semantic_query(spark, d):
    turns = _turns(spark, d)
    hits = semantic.query(semantic.embed(turns), turns.withColumn("text", F.concat_ws("|", "ordinal", "text")), "hello there", 12)
    return hits.select("path", F.split("text", r"\|")[0].cast("int").alias("ordinal"), F.round("score", 5).alias("score"))


@query(f"""SELECT count(DISTINCT path) AS paths_scanned, count(*) FILTER (ordinal % 3 = 0) AS embedded, count(*) FILTER (ordinal % 3 <> 0) AS skipped, 0 AS failed FROM {_TURNS}""")
def semantic_rebuild_report(spark, d):
    turns = _turns(spark, d)
    return semantic.refresh(semantic.embed(turns.where("ordinal % 3 <> 0")), turns)[1]


@query("SELECT count(*) FILTER (doc_id % 11 <> 0) AS documents, count(*) FILTER (doc_id % 11 = 0 AND doc_id % 13 <> 0 OR doc_id % 11 <> 0 AND (doc_id % 13 = 0 OR doc_id % 7 = 0)) AS stale_estimate, max(n_chars) FILTER (doc_id % 11 <> 0) AS last_build FROM documents")
def semantic_index_status(spark, d):
    before, after = _edited(spark, d)
    return semantic.status(before.withColumn("indexed_at", F.col("mtime")), after)


# --- freshness ---------------------------------------------------------------------------------------------------------------


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents before and after edits that their ids decide."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), (F.col("doc_id") % 4).cast("int").alias("ordinal"), F.sha2("text", 256).alias("content_hash"))
    before = docs.where("path % 11 <> 0")
    after = docs.where("path % 13 <> 0").withColumns({"mtime": F.when(F.col("path") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")), "content_hash": F.when(F.col("path") % 7 == 0, F.lit("edited")).otherwise(F.col("content_hash"))})
    return before, after


_STATES = """(SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN b.doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state
  FROM (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0) a FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0) b ON a.doc_id = b.doc_id)"""


query(f"SELECT path, state FROM {_STATES}", "sync_freshness")(lambda spark, d: sync.freshness(*_edited(spark, d)))
query(f"SELECT count(*) FILTER (state <> 'removed') AS scanned, count(*) FILTER (state IN ('new', 'changed')) AS reindexed, count(*) FILTER (state = 'removed') AS removed FROM {_STATES}", "sync_report")(lambda spark, d: sync.freshness_report(sync.freshness(*_edited(spark, d))))
query(f"SELECT count(*) FILTER (state <> 'unchanged') AS stale FROM {_STATES}", "sync_stale_estimate")(lambda spark, d: sync.stale(sync.freshness(*_edited(spark, d))))
query("SELECT doc_id AS path FROM documents WHERE doc_id % 13 <> 0 AND (doc_id % 11 = 0 OR doc_id % 7 = 0)", "sync_hash_skip")(lambda spark, d: sync.to_embed(*_edited(spark, d)[::-1]).select("path"))
query("SELECT doc_id AS path FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0", "sync_prune")(lambda spark, d: sync.to_prune(*_edited(spark, d)).select("path"))
query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1", "sync_dup_content")(lambda spark, d: quality.duplicates(read(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash")), ["content_hash"]))


@query("SELECT user_id AS key, event_id AS seq, event_type AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_cdc_latest(spark, d):
    log = read(spark, d, "events").select(F.lit("user").alias("kind"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.lit(5).alias("generation"))
    return sync.replay(log, 0, 5).select("key", "seq", "value")


# --- change events -------------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, min(ts) AS began, max(ts) AS last_at, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_debounce_sessions(spark, d):
    return ev.commits(read(spark, d, "events"), "user_id", "ts", "6 hours")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_paths(spark, d):
    return ev.queue(read(spark, d, "events"), "user_id").select("user_id")


@query("SELECT event_id, unnest(CASE WHEN event_type IN ('click', 'purchase') THEN ['index', 'log', 'version', 'search'] ELSE ['version', 'search'] END) AS consumer FROM events")
def stream_fanout_routes(spark, d):
    origin = F.when(F.col("event_type").isin("click", "purchase"), "tool").otherwise("internal")
    return ev.route(read(spark, d, "events").withColumn("origin", origin)).select("event_id", "consumer")


@query("""SELECT event_id, strftime(ts, '%H:%M:%S') || ' | tool | ' || event_type || ' | user ' || user_id || ' | files: ' || event_id || '.md, x.md' AS line FROM events""")
def stream_oplog_lines(spark, d):
    files = F.array(F.concat(F.col("event_id").cast("string"), F.lit(".md")), F.lit("x.md"))
    return read(spark, d, "events").select("event_id", ev.log_line(F.col("ts"), F.lit("tool"), F.col("event_type"), F.concat(F.lit("user \n "), F.col("user_id")), files).alias("line"))


# --- paths, tables of folders, history, diagnostics ------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _paged(read(spark, d, "pages")).select("path", F.octet_length("html").cast("long").alias("size"), "title").where("path <> ''").dropDuplicates(["path"])


_FILES = f"(SELECT DISTINCT path FROM {PAGES} WHERE path <> '')"
_WAYS = f"(SELECT DISTINCT path, n, list_extract(string_split(path, '/'), n) AS name, n = len(string_split(path, '/')) AS is_file, array_to_string(list_slice(string_split(path, '/'), 1, n - 1), '/') AS parent FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM {_FILES}))"
query(f"SELECT DISTINCT name, is_file FROM {_WAYS} WHERE n = 1", "fs_list")(lambda spark, d: listing.listing(_files(spark, d)).select("name", "is_file"))
query(
    f"SELECT w.name, w.is_file, sum(s.size) AS size FROM (SELECT DISTINCT path, name, is_file FROM {_WAYS} WHERE n = 1) w JOIN (SELECT path, any_value(size) AS size FROM (SELECT path, strlen(html) AS size, row_number() OVER (PARTITION BY path) AS r FROM {PAGES}) GROUP BY path HAVING count(DISTINCT size) = 1) s USING (path) GROUP BY ALL", "fs_list_sizes",
)(lambda spark, d: listing.listing(_sized_once(spark, d), by_size=True))


def _sized_once(spark: SparkSession, d: str) -> DataFrame:
    """Paths all whose pages have one size."""
    rows = _paged(read(spark, d, "pages")).where("path <> ''").groupBy("path").agg(F.min(F.octet_length("html")).alias("size"), F.max(F.octet_length("html")).alias("_most"))
    return rows.where("size = _most").drop("_most")


query(f"SELECT DISTINCT CASE WHEN parent = '' THEN name ELSE parent || '/' || name END AS path, is_file, CAST(n AS INT) AS depth FROM {_WAYS} WHERE n <= 2", "fs_tree_depth")(lambda spark, d: listing.tree(_files(spark, d), 2))
query(f"SELECT path FROM {_FILES} WHERE regexp_matches(path, '(?i)^(?:.*/)?[^/]*1[^/]*$') ORDER BY lower(path), path LIMIT 200", "fs_glob")(lambda spark, d: listing.search(_files(spark, d), "**/*1*").select("path"))
query(
    f"SELECT folder, string_agg('| ' || basename || ' | ' || basename || ' |', chr(10) ORDER BY lower(basename), basename) AS body FROM (SELECT DISTINCT folder, basename FROM {PAGES} WHERE path <> '') GROUP BY folder", "index_table_per_dir",
)(lambda spark, d: listing.index_tables(_files(spark, d).select("path", F.element_at(F.split("path", "/"), -1).alias("summary"))))


@query("SELECT o_orderkey AS id, o_orderdate AS time FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def history_log_prefix(spark, d):
    log = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time"), F.array(F.concat(F.col("o_orderpriority"), F.lit("/a.md"))).alias("files_changed"))
    return sync.commit_log(log, "1-URGENT").select("id", "time")


query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)", "quality_dangling")(lambda spark, d: quality.dangling(read(spark, d, "labels"), read(spark, d, "documents").where("doc_id % 3 <> 0"), "doc_id").select("doc_id"))
query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1", "quality_duplicate_ids")(lambda spark, d: quality.duplicates(read(spark, d, "conversations"), ["conv_id", "role"]))

# --- calendar -----------------------------------------------------------------------------------------------------------------------

_BORN = "DATE '1980-02-29'"


@query(f"""WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y FROM orders),
  a AS (SELECT o_orderkey, day, make_date(y, 2, CASE WHEN day(last_day(make_date(y, 2, 1))) = 29 THEN 29 ELSE 28 END) AS t, make_date(y - 1, 2, CASE WHEN day(last_day(make_date(y - 1, 2, 1))) = 29 THEN 29 ELSE 28 END) AS p FROM b),
  n AS (SELECT o_orderkey, CAST(day - CASE WHEN t <= day THEN t ELSE p END AS DOUBLE) AS days FROM a),
  i AS (SELECT o_orderkey, days, CAST(least(greatest(floor(days / (365.25 / 7)), 0), 6) AS INT) AS k FROM n)
  SELECT o_orderkey, k + 1 AS period_number, list_extract(['Sun', 'Moon', 'Mars', 'Mercury', 'Jupiter', 'Venus', 'Saturn'], k + 1) AS ruling_planet,
  abs(days - k * (CAST(365.25 AS DOUBLE) / 7)) <= 2 OR abs(days - (k + 1) * (CAST(365.25 AS DOUBLE) / 7)) <= 2 AS transition FROM i""")
def astro_personal_year(spark, d):
    p = astro.personal_year(F.lit("1980-02-29").cast("date"), F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.*")


def _trig(name: str, degrees: str) -> str:
    return f"{name}(radians({degrees}))"


def _delta_t_sql(y: str) -> str:
    t, u = f"({y} - 2000)", f"(({y} - 1820) / 100.0)"
    return f"""CASE WHEN {y} BETWEEN 2005 AND 2049 THEN 62.92 + 0.32217 * {t} + 0.005589 * {t} * {t} WHEN {y} BETWEEN 1986 AND 2004 THEN 63.86 + 0.3345 * {t} - 0.060374 * {t} * {t} + 0.0017275 * {t} * {t} * {t}
      WHEN {y} BETWEEN 1961 AND 1985 THEN 45.45 + 1.067 * ({y} - 1975) - ({y} - 1975) * ({y} - 1975) / 260.0 WHEN {y} BETWEEN 1900 AND 1960 THEN 29.07 + 0.407 * ({y} - 1950) - ({y} - 1950) * ({y} - 1950) / 233.0 ELSE -20 + 32 * {u} * {u} END"""


def _season_sql(i: int) -> str:
    """A table of (year, seconds since 1970 of one season's beginning)."""
    c = [f"CAST({x} AS DOUBLE)" for x in astro.SEASONS[i]]
    y = "((year - 2000) / 1000.0)"
    jde = f"((({c[4]} * {y} + {c[3]}) * {y} + {c[2]}) * {y} + {c[1]}) * {y} + {c[0]}"
    total = " + ".join(f"{a} * {_trig('cos', f'{b0} + {c0} * t')}" for a, b0, c0 in astro.TERMS)
    return f"""(SELECT year, CAST(round((jd - 2440587.5) * 86400 - ({_delta_t_sql('year')})) AS BIGINT) AS seconds FROM (SELECT year, j + 0.00001 * ({total}) / (1 + 0.0334 * {_trig('cos', 'w')} + 0.0007 * {_trig('cos', '2 * w')}) AS jd
      FROM (SELECT *, 35999.373 * t - 2.47 AS w FROM (SELECT *, (j - 2451545.0) / 36525 AS t FROM (SELECT year, {jde} AS j FROM (SELECT DISTINCT CAST(year(o_orderdate) AS DOUBLE) AS year FROM orders))))))"""


@query(" UNION ALL ".join(f"SELECT CAST(year AS INTEGER) AS year, '{name}' AS event, seconds FROM {_season_sql(i)}" for i, name in enumerate(astro.EVENTS)))
def astro_solar_events(spark, d):
    found = astro.solar_events(read(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct(), "year")
    return found.select("year", "event", F.unix_seconds("instant").alias("seconds"))


_FIXED_DAYS = {0: "02-01", 2: "05-01", 4: "08-01", 6: "10-31"}


@query(
    " UNION ALL ".join(
        f"SELECT year, '{name}' AS name, 'Checkpoint' AS role, CAST(epoch(CAST(year || '-{_FIXED_DAYS[i]}' AS TIMESTAMP)) AS BIGINT) AS seconds FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders)" if i in _FIXED_DAYS
        else f"SELECT CAST(year AS BIGINT) AS year, '{name}' AS name, 'Boundary' AS role, seconds FROM {_season_sql(i // 2)}"
        for i, name in enumerate(astro.WHEEL)
    )
)
def astro_wheel_of_year(spark, d):
    found = astro.wheel_of_year(read(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct(), "year")
    return found.select("year", "name", "role", (F.unix_date(F.to_date("instant")).cast("long") * 86400 + F.hour("instant") * 3600 + F.minute("instant") * 60 + F.second("instant")).alias("seconds"))


@query(f"""SELECT day, round((1 + {_trig('cos', f"180 - d - 6.289 * {_trig('sin', 'mp')} + 2.100 * {_trig('sin', 'm')} - 1.274 * {_trig('sin', '2 * d - mp')} - 0.658 * {_trig('sin', '2 * d')} - 0.214 * {_trig('sin', '2 * mp')} - 0.110 * {_trig('sin', 'd')}")}) / 2, 9) AS illumination
  FROM (SELECT *, 297.8501921 + 445267.1114034 * t AS d, 357.5291092 + 35999.0502909 * t AS m, 134.9633964 + 477198.8675055 * t AS mp FROM (SELECT day, (day - DATE '1970-01-01' + CAST(2440587.5 AS DOUBLE) - 2451545.0) / 36525 AS t FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)))""")
def astro_moon_illumination(spark, d):
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.round(astro.moon_phase(F.col("day"))["illumination_fraction"], 9).alias("illumination"))


@query()
def astro_moon_phase(spark, d):
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", astro.moon_phase(F.col("day")).alias("p")).select("day", "p.*")


@query()
def astro_boundaries(spark, d):
    return astro.boundaries(spark, "2024-01-01", "2024-12-31", "1980-02-29")


# --- contents of files, edits -------------------------------------------------------------------------------------------------------


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files by their url's path, with the larger of texts of one path."""
    rows = _paged(read(spark, d, "pages")).where("path <> ''")
    return rows.groupBy("path").agg(F.max("html").alias("text")).withColumn("content", F.col("text").cast("binary"))


_CONTENTS = f"(SELECT path, max(html) AS text FROM {PAGES} WHERE path <> '' GROUP BY path)"
_EXT = "regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)"


query(f"SELECT path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN strlen(text) <= 8000 THEN sha256(text) END AS sha256 FROM {_CONTENTS}", "fs_info")(lambda spark, d: files.info(_contents(spark, d), 8000).drop("modified"))
query(
    f"SELECT path, CASE WHEN {_EXT} IN ('html', 'htm') THEN 'text/html' ELSE 'text/plain' END AS mime, CAST(strlen(text) AS BIGINT) AS size, true AS is_text, CASE WHEN strlen(text) > 8000 THEN 'io/too-large' END AS error FROM {_CONTENTS}", "fs_attachments",
)(lambda spark, d: files.attachments(_contents(spark, d), 8000).drop("content"))
query(
    f"""SELECT r.path, n, CASE WHEN strlen(text) <= 9000 THEN md5(text) END AS digest, CASE WHEN text IS NULL AND r.path IN ('en', 'fr') THEN 'path/not-file' WHEN text IS NULL THEN 'path/not-found' WHEN strlen(text) > 9000 THEN 'io/too-large' END AS error
    FROM (SELECT n, CASE WHEN n % 10 = 0 THEN 'none/' || n WHEN n % 10 = 1 THEN 'fr' ELSE path END AS path FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM {_CONTENTS})) r LEFT JOIN {_CONTENTS} c ON c.path = r.path""", "fs_read_many",
)(lambda spark, d: files.read_many(_requests(_contents(spark, d)), _contents(spark, d), 9000).select("path", "n", F.md5("text").alias("digest"), "error"))


def _requests(contents: DataFrame) -> DataFrame:
    rows = contents.select("path", F.row_number().over(Window.orderBy("path")).alias("n"))  # as many as a request's paths
    return rows.select("n", F.when(F.col("n") % 10 == 0, F.concat(F.lit("none/"), F.col("n"))).when(F.col("n") % 10 == 1, "fr").otherwise(F.col("path")).alias("path"))


def _resources(spark: SparkSession, d: str) -> DataFrame:
    sized = _contents(spark, d).select(F.split("path", "/")[0].alias("vault"), "path", F.octet_length("content").alias("size"))
    return files.resources(sized, ["**/*.html", "en/*"])


_ALLOWED = f"(SELECT string_split(path, '/')[1] AS vault, path, strlen(text) AS size FROM {_CONTENTS} WHERE regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.html$') OR regexp_matches(path, '(?i)^en/[^/]*$'))"
query(f"SELECT path, CASE WHEN {_EXT} IN ('html', 'htm') THEN 'text/html' ELSE 'application/octet-stream' END AS mime, CAST(size AS BIGINT) AS size FROM {_ALLOWED}", "fs_resources")(lambda spark, d: _resources(spark, d).select("path", "mime", "size"))
query(f"SELECT vault, count(*) AS resources FROM {_ALLOWED} GROUP BY vault", "fs_resource_counts")(lambda spark, d: files.resource_counts(_resources(spark, d)))


@query("SELECT c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN '# Log' || chr(10) ELSE c_mktsegment END || c_name WHEN c_custkey % 6 = 3 THEN '' ELSE c_mktsegment END AS text FROM customer")
def edit_append(spark, d):
    rows = read(spark, d, "customer")
    texts = rows.select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("text"))
    return files.append(texts, rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("addition")), "# Log\n")


_TIMES = "(length(p_name) - length(replace(p_name, 'an', ''))) / 2"


@query(f"SELECT p_partkey AS path, CASE WHEN {_TIMES} = 1 THEN replace(p_name, 'an', 'AN') || '' ELSE p_name END AS text, CASE WHEN {_TIMES} = 0 THEN 'edit/not-found at 1' WHEN {_TIMES} > 1 THEN 'edit/ambiguous at 1' END AS error FROM part")
def edit_exact(spark, d):
    texts = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("text"))
    return files.exact_edits(texts, texts.select("path", F.lit(1).alias("seq"), F.lit("an").alias("old_text"), F.lit("AN").alias("new_text")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS status, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 1 ELSE 2 END AS changed_lines FROM customer WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 35 <> 0 AND c_custkey % 3 = 0)")
def edit_diff(spark, d):
    rows, key = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("text"), "c_custkey"), F.col("c_custkey")
    after = rows.where(key % 7 != 0).withColumn("text", F.when(key % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    patch = files.diff(rows.where(key % 5 != 0), after)
    return patch.select("path", "status", F.size(F.filter(F.split("patch", "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2} )"))).alias("changed_lines"))


@query("""SELECT s_suppkey AS path, '---' || chr(10) || 'type: "note"' || chr(10) || 'title: "' || s_name || '"' || chr(10) || 'entity: "personal"' || chr(10) || 'status: "' || CASE WHEN s_suppkey % 2 = 0 THEN 'done' ELSE 'new' END || '"' || chr(10)
  || 'created: "2024-01-02"' || chr(10) || 'updated: "2024-01-02"' || chr(10) || 'tags: []' || chr(10) || 'aliases: []' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'nation: ' || s_nationkey ELSE '' END || chr(10) || '---' || chr(10) || s_name AS text FROM supplier""")
def note_create(spark, d):
    own = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("status"), F.lit('"done"'), F.lit("nation"), F.col("s_nationkey").cast("string")))
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_name").alias("title"), F.col("s_name").alias("content"), own.alias("overrides"))
    return files.new_notes(rows, F.lit("2024-01-02")).select("path", "text")


@query(f"""SELECT folder, n AS rows, 'created' AS state FROM (SELECT folder, count(*) AS n FROM (SELECT DISTINCT folder, basename FROM {PAGES} WHERE path <> '') GROUP BY folder)""")
def index_managed(spark, d):
    made = _indexes(spark, d)
    return made.select("folder", (F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("| "))) - 2).cast("long").alias("rows"), "state")


query(f"SELECT count(DISTINCT folder) AS directories_scanned, count(DISTINCT folder) AS created, 0 AS updated, 0 AS unchanged, 0 AS invalid FROM {PAGES} WHERE path <> ''", "index_rebuild_report")(lambda spark, d: listing.rebuild_report(_indexes(spark, d)))


def _indexes(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    entries = _files(spark, d).select(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), name.alias("name"), F.lit(True).alias("is_file"), name.alias("summary"))
    return listing.managed_indexes(entries, spark.createDataFrame([], "folder string, text string"))


# --- upkeep of the graph, links of a note ---------------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT target, {{}} AS resolved FROM {_HREFS} h""".format(f"target <> '' AND NOT regexp_matches(target, '^/|[\\\\:]|(^|/)\\.\\.(/|$)') AND (lower(CASE WHEN regexp_matches(list_last(string_split(target, '/')), '[^.]\\.[^.]*$') THEN target ELSE target || '.md' END) IN (SELECT lower(path) FROM {PAGES}) OR (NOT contains(target, '/') AND lower(CASE WHEN regexp_matches(target, '[^.]\\.[^.]*$') THEN target ELSE target || '.md' END) IN (SELECT lower(basename) FROM {PAGES})))"))
def links_for_reading(spark, d):
    pages = _paged(read(spark, d, "pages"))
    links = pages.select(F.col("path").alias("from"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).withColumn("target", F.ltrim("target", F.lit("/")))
    return graph.resolve_reading(links, pages).select("target", "resolved").distinct()


def _trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    keys = [("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s"), ("nation", "n_nationkey", "n"), ("region", "r_regionkey", "r")]
    out = None
    for table, key, x in keys:
        rows = read(spark, d, table).select(F.concat(F.lit(x), F.col(key)).alias("path"), F.concat(F.lit(x), F.col(key)).alias("title"), F.lit(False).alias("phantom"))
        out = rows if out is None else out.unionByName(rows)
    return out


_ALL = "(SELECT 'c' || c_custkey AS path FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)"


@query(f"""SELECT path, path AS title, starts_with(path, 'n') AND CAST(substr(path, 2) AS INT) % 2 = 0 AS phantom FROM {_ALL} WHERE NOT (starts_with(path, 'n') AND CAST(substr(path, 2) AS INT) % 2 = 0 AND path NOT IN (SELECT b FROM {_TRADE}))""")
def graph_removed_notes(spark, d):
    """Every second nation is deleted; those to which customers or suppliers lead become phantoms."""
    gone = _trade_nodes(spark, d).where("path LIKE 'n%' AND CAST(substring(path, 2) AS INT) % 2 = 0").select("path")
    return graph.remove(_trade_nodes(spark, d), _trade_graph(spark, d), gone)[0]


@query(f"""SELECT a AS "from", CASE WHEN a IN ('c1', 'c2', 'c3') THEN CASE a WHEN 'c1' THEN 'new' ELSE 'r0' END ELSE b END AS "to" FROM {_TRADE} UNION ALL SELECT 'x', 'n0'""")
def graph_upserted_edges(spark, d):
    """Three customers get other links and one note is new."""
    notes = spark.createDataFrame([(x, x) for x in ("c1", "c2", "c3", "x")], "path string, title string")
    links = spark.createDataFrame([("u1", "c1", "new", "link"), ("u2", "c2", "r0", "link"), ("u3", "c3", "r0", "link"), ("u4", "x", "n0", "link")], "edge_id string, `from` string, target string, kind string")
    return graph.upsert(_trade_nodes(spark, d), _trade_graph(spark, d), notes, links)[1].select("from", "to")


# --- canvases, transforms ------------------------------------------------------------------------------------------------------------------


def _canvas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions as canvases of their nations."""
    node = F.struct(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.lit("text").alias("type"), (F.col("n_nationkey") * 7 % 50).alias("x"), (F.col("n_nationkey") * 5 % 30).alias("y"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    edge = F.struct(F.concat(F.lit("e"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("fromNode"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1)).alias("toNode"))
    rows = read(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(edge)).alias("edges"))
    return quality.canvas_tables(rows.select("path", F.to_json(F.struct("nodes", "edges")).alias("json")))


_BOX = "min(n_nationkey * 7 % 50) - 40 AS x, min(n_nationkey * 5 % 30) - 40 AS y, max(n_nationkey * 7 % 50) + 10 - min(n_nationkey * 7 % 50) + 80 AS width, max(n_nationkey * 5 % 30) + 20 - min(n_nationkey * 5 % 30) + 80 AS height"
query(f"SELECT CAST(n_regionkey AS VARCHAR) AS path, {_BOX} FROM nation GROUP BY 1", "canvas_groups")(lambda spark, d: quality.add_canvas_groups(_canvas(spark, d)[0], _canvas(spark, d)[0].select("path", "id")).where("type = 'group'").select("path", "x", "y", "width", "height"))
query(
    "SELECT CAST(a.n_regionkey AS VARCHAR) AS path, 'canvas/dangling-edge' AS code, a.n_nationkey AS n FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND b.n_regionkey = a.n_regionkey WHERE b.n_nationkey IS NULL", "canvas_dangling_edges",
)(lambda spark, d: _loose(*_canvas(spark, d)))


def _loose(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    at = edges.select("path", F.concat(F.lit("edges["), "pos", F.lit("].toNode")).alias("at"), "id")
    return quality.canvas_problems(nodes, edges).join(at, ["path", "at"]).select("path", "code", F.regexp_replace("id", "^e", "").cast("int").alias("n"))


query("SELECT CAST(n_regionkey AS VARCHAR) AS path, max(n_nationkey * 7 % 50) + 70 AS x, 0 AS y FROM nation GROUP BY 1", "canvas_added_nodes")(
    lambda spark, d: quality.add_canvas_nodes(_canvas(spark, d)[0], _canvas(spark, d)[0].select("path").distinct().selectExpr("path", "0 AS pos", "'new' AS type")).where("type = 'new'").select("path", "x", "y")
)


@query("SELECT c_custkey, '<mark>' || c_mktsegment || '</mark> `==' || c_mktsegment || '==` <span class=\"tag\">#s/' || c_nationkey || '</span>  end' AS text FROM customer")
def transform_markup(spark, d):
    text = F.concat(F.lit("=="), F.col("c_mktsegment"), F.lit("== `=="), F.col("c_mktsegment"), F.lit("==` #s/"), F.col("c_nationkey"), F.lit(" %%hidden%% end"))
    return read(spark, d, "customer").select("c_custkey", transforms.tag_spans(transforms.highlights(transforms.strip_comments(text))).alias("text"))


@query("SELECT c_custkey, 'tip' AS canonical, c_mktsegment AS title, 'a' || chr(10) || c_name AS body FROM customer")
def transform_callouts(spark, d):
    text = F.concat(F.lit("intro\n> [!Hint]- "), F.col("c_mktsegment"), F.lit("\n> a\n> "), F.col("c_name"), F.lit("\n\n```\n> [!no]\n```\n"))
    found = read(spark, d, "customer").select("c_custkey", F.explode(transforms.callouts(text)).alias("c"))
    return found.select("c_custkey", "c.canonical", "c.title", "c.body")


@query("SELECT c_custkey, c_name || chr(10) || 'second' AS block FROM customer")
def transform_block(spark, d):
    text = F.concat(F.lit("first\n\n"), F.col("c_name"), F.lit("\nsecond ^b-"), F.col("c_custkey"), F.lit("\n\nlast ^other"))
    return read(spark, d, "customer").select("c_custkey", transforms.block(text, F.concat(F.lit("b-"), F.col("c_custkey").cast("string"))).alias("block"))


from skerry.plans import upkeep_catalogue  # noqa: E402, F401  its queries are added to these
