"""Registered queries, and their SQL, for logs of generations, live streams, history, roots of paths and SQL table functions.

catalogue imports this module at its end, so that its queries stand among the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import store
from skerry.functions import astro
from skerry.operators import graph, paths, semantic, sync
from skerry.operators.graph_store import GraphStore
from skerry.plans import catalogue as c
from skerry.plans import registry
from skerry.plans import base_query as bq
from skerry.streaming import drain as dr
from skerry.streaming import events as ev
from skerry.streaming import ordered

LINKS = "edge_id string, `from` string, target string, kind string"

# --- views and graphs with hits ---------------------------------------------------------------------------------------


@c.query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN ('economy', 'promo')")
def base_has_tag_of_types(spark, d):
    tagged = c.read(spark, d, "part").withColumn("tags", F.split(F.lower("p_type"), " "))
    return bq.run(tagged, bq.from_inline({"filters": 'file.hasTag("economy") || file.hasTag("promo")', "order": ["p_partkey", "p_type"]}), ["p_partkey"])


@c.query("SELECT 'd' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def graph_orphan_documents(spark, d):
    """Documents and their labels as a graph, in which a document without a label has no link."""
    nodes = c.read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(False).alias("phantom"))
    edges = c.read(spark, d, "labels").select(F.concat(F.lit("l"), "doc_id").alias("from"), F.concat(F.lit("d"), "doc_id").alias("to"))
    return graph.orphans(nodes, edges).select("path")


# --- the graph as a log of generations ----------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> tuple[GraphStore, object]:
    """The trade graph after four generations, and a reader's state as of the first: customers move, a note is new, nations go."""
    log = GraphStore(spark, store.new_path(spark, "graph"))
    log.rebuild(c._trade_nodes(spark, d), c._trade_graph(spark, d))
    reader = log.load()
    moved = c.read(spark, d, "customer").where("c_custkey % 50 = 1").select(F.concat(F.lit("c"), "c_custkey").alias("path"))
    log.upsert(moved.select("path", F.concat(F.lit("moved "), "path").alias("title")), moved.select(F.concat("path", F.lit("#")).alias("edge_id"), F.col("path").alias("from"), F.lit("r0").alias("target"), F.lit("link").alias("kind")))
    log.upsert(spark.createDataFrame([("x", "x")], "path string, title string"), spark.createDataFrame([("x#", "x", "nowhere", "embed")], LINKS))
    log.remove(c.read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("path")))
    return log, reader


_EVEN = "(starts_with(a, 'n') AND CAST(substr(a, 2) AS INT) % 2 = 0)"
_MOVED = "(starts_with(a, 'c') AND CAST(substr(a, 2) AS BIGINT) % 50 = 1)"


@c.query(f"""SELECT a AS "from", CASE WHEN {_MOVED} THEN 'r0' ELSE b END AS "to", 'link' AS kind FROM {c._TRADE} WHERE NOT {_EVEN} UNION ALL SELECT 'x', 'nowhere', 'embed'""")
def graph_generations_replayed(spark, d):
    """A reader of the first generation replays the three after it."""
    log, reader = _log(spark, d)
    state, how = log.catch_up(reader)
    return state.edges.where(F.lit(how == "partial")).select("from", "to", "kind")


@c.query(f"""WITH ends AS (SELECT CASE WHEN {_MOVED} THEN 'r0' ELSE b END AS b FROM {c._TRADE} WHERE NOT {_EVEN}),
  gone AS (SELECT 'n' || n_nationkey AS path FROM nation WHERE n_nationkey % 2 = 0)
SELECT 1 AS generation, 'reset' AS kind, 1 AS n
UNION ALL SELECT 2, 'remove_edge', count(*) FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT 2, 'upsert_edge', count(*) FROM customer WHERE c_custkey % 50 = 1
UNION ALL SELECT 2, 'upsert_node', count(*) FROM customer WHERE c_custkey % 50 = 1
UNION ALL SELECT 3, 'upsert_edge', 1 UNION ALL SELECT 3, 'upsert_node', 2
UNION ALL SELECT 4, 'remove_edge', count(*) FROM gone
UNION ALL SELECT 4, kind, count(*) FROM (SELECT CASE WHEN path IN (SELECT b FROM ends) THEN 'upsert_node' ELSE 'remove_node' END AS kind FROM gone) GROUP BY kind""")
def graph_generation_log(spark, d):
    """How many changes of each kind every generation has."""
    return _log(spark, d)[0].changes().groupBy("generation", "kind").agg(F.count("*").alias("n"))


@c.query("""SELECT event_type AS kind, user_id AS key, event_id AS seq, value FROM (SELECT *, event_id // 100 + 1 AS generation FROM events) WHERE generation > 4
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1""")
def stream_cdc_generations(spark, d):
    """The last change of each kind and key in the generations after the fourth, of a hundred changes each."""
    log = c.read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", F.expr("event_id div 100 + 1").alias("generation"))
    newest = log.agg(F.max("generation")).first()[0] or 0  # one number
    return sync.replay(log, 4, newest, retention=newest).select("kind", "key", "seq", "value")


# --- live streams -------------------------------------------------------------------------------------------------------


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, from a folder of its own, as a stream can't begin at a single file."""
    events = c.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = store.new_path(spark, "events")
    events.write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def _ran(spark: SparkSession, live: DataFrame, run) -> DataFrame:
    folder = store.new_path(spark, "live")
    run(live, f"{folder}/out", f"{folder}/check")
    return spark.read.schema(live.schema).parquet(f"{folder}/out")


@c.query("""SELECT user_id, began, last_at, n_events FROM (SELECT user_id, min(ts) AS began, max(ts) AS last_at, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s)
  WHERE last_at + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY""")
def stream_live_commits(spark, d):
    """Commits of a stream whose quiet time is behind the watermark, a day behind the newest event; the rest stays in state."""
    done = _ran(spark, ev.commits(_live(spark, d), "user_id", "ts", "6 hours", "1 day"), dr.run_available)
    return done.select("user_id", *(F.col(x).cast("timestamp_ntz").alias(x) for x in ("began", "last_at")), "n_events")


@c.query("SELECT DISTINCT user_id FROM events")
def stream_live_queue(spark, d):
    return _ran(spark, ev.queue(_live(spark, d), "user_id", "60 days", "ts").select("user_id"), dr.run_available)


class _Ticks:
    """A clock that goes on by one whenever it is read."""

    def __init__(self) -> None:
        self.now = 0

    def __call__(self) -> int:
        self.now += 1
        return self.now


@c.query("""SELECT lane, place, path, waiting FROM (SELECT user_id % 8 AS lane, CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id % 8 ORDER BY min(event_id)) - 1 AS place,
  greatest(count(*) OVER (PARTITION BY user_id % 8) - 6, 0) AS waiting FROM events GROUP BY user_id) WHERE place < 6""")
def stream_budgeted_drain(spark, d):
    """Users to work on, each once a lane in the order of their first event; a batch's budget is six of a lane, the rest waits."""
    live = _live(spark, d).withColumn("lane", F.col("user_id") % 8)
    with dr.rocks(spark):
        return _ran(spark, dr.drain(live, "lane", "user_id", "event_id", str.upper, 6, _Ticks()), dr.run_once).select("lane", "place", "path", "waiting")


def _refuse_dear(row: dict) -> None:
    if row["value"] > 100:
        raise ValueError("dear")


def _take(row: dict) -> None:
    pass


@c.query("""WITH first AS (SELECT user_id, min(event_id) FILTER (value > 100) AS stop, min(event_id) FILTER (value > 300) AS late FROM events GROUP BY user_id),
  turn AS (SELECT e.user_id, e.event_id, CASE WHEN f.stop IS NULL OR e.event_id < f.stop THEN 1 ELSE 2 END AS flush FROM events e JOIN first f USING (user_id))
SELECT CAST(user_id AS VARCHAR) AS partition, max(event_id) AS position, count(*) FILTER (flush = 2) AS applied FROM turn GROUP BY user_id""")
def oplog_retry_buffer(spark, d):
    """A user's events are applied up to the first that the sink refuses, and the rest by a second flush from there."""
    events = c.read(spark, d, "events")
    buffer = ordered.RetryBuffer(spark, store.new_path(spark, "positions"))
    buffer.flush(events, "user_id", "event_id", _refuse_dear)
    return buffer.flush(events, "user_id", "event_id", _take).select("partition", "position", "applied")


# --- history ------------------------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of users' files: an error deletes one, any other event writes its value."""
    content = F.when(F.col("event_type") != "error", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    return c.read(spark, d, "events").select(F.concat(F.lit("users/"), F.col("user_id") % 7, F.lit("/"), "user_id").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), content.alias("content"))


def _as_of_sql(where: str) -> str:
    return f"""(SELECT path, content FROM (SELECT 'users/' || user_id % 7 || '/' || user_id AS path, ts, event_id, CASE WHEN event_type <> 'error' THEN event_type || ' ' || event_id END AS content FROM events WHERE {where})
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1)"""


_THEN = "TIMESTAMP '2024-01-11'"


@c.query(f"SELECT path, content FROM {_as_of_sql(f'ts <= {_THEN}')} WHERE content IS NOT NULL")
def history_as_of(spark, d):
    return sync.as_of(_versions(spark, d), F.lit("2024-01-11").cast("timestamp"))


@c.query(f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.content IS NULL THEN 'delete' ELSE 'write' END AS action, a.content FROM (SELECT * FROM {_as_of_sql(f'ts <= {_THEN}')} WHERE content IS NOT NULL) a
  FULL OUTER JOIN (SELECT * FROM {_as_of_sql('true')} WHERE content IS NOT NULL) b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content AND NOT starts_with(coalesce(a.path, b.path), 'users/3/')""")
def history_restore_plan(spark, d):
    """What a restore to the eleventh day would write and delete, but for a protected folder."""
    return sync.restore_plan(_versions(spark, d), F.lit("2024-01-11").cast("timestamp"), "users", ["users/3"]).select("path", "action", "content")


@c.query(f"SELECT path, content FROM {_as_of_sql(f'ts <= {_THEN}')} WHERE content IS NOT NULL AND NOT starts_with(path, 'users/3/') UNION ALL SELECT path, content FROM {_as_of_sql('true')} WHERE content IS NOT NULL AND starts_with(path, 'users/3/')")
def history_restored(spark, d):
    """The files as they are after that restore."""
    versions = _versions(spark, d)
    return sync.as_of(sync.restore(versions, F.lit("2024-01-11").cast("timestamp"), F.lit("2024-03-01").cast("timestamp"), "users", ["users/3"], destructive=True))


# --- roots ----------------------------------------------------------------------------------------------------------------


@c.query(f"""WITH given AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN path WHEN 1 THEN 'first://' || path WHEN 2 THEN 'none://' || path WHEN 3 THEN '/v/../' || path WHEN 4 THEN 'C:' || path WHEN 5 THEN 'first://' ELSE '/v/' || path END AS raw, path FROM {c.PAGES} WHERE path <> ''),
  roots AS (SELECT DISTINCT '/v/' || split_part(path, '/', 1) AS root FROM given),
  found AS (SELECT g.*, (SELECT max(root) FROM roots WHERE raw = root OR starts_with(raw, root || '/')) AS root FROM given g)
SELECT page_id, CASE WHEN page_id % 9 > 5 THEN root WHEN page_id % 9 = 1 THEN 'first' END AS root,
  CASE WHEN page_id % 9 > 5 THEN substr(raw, length(root) + 2) WHEN page_id % 9 = 1 THEN path END AS relative,
  CASE page_id % 9 WHEN 0 THEN 'path/ambiguous-root' WHEN 2 THEN 'path/unknown-vault-name' WHEN 3 THEN 'path/outside-root' WHEN 4 THEN 'path/invalid-windows-path' WHEN 5 THEN 'path/empty-named-prefix' END AS code FROM found""")
def paths_to_roots(spark, d):
    """Paths of pages as users give them, and the folders of their first segments as roots."""
    pages = c._paged(c.read(spark, d, "pages")).where("path <> ''")
    n = F.col("page_id") % 9
    raw = F.when(n == 0, F.col("path")).when(n == 1, F.concat(F.lit("first://"), "path")).when(n == 2, F.concat(F.lit("none://"), "path")).when(n == 3, F.concat(F.lit("/v/../"), "path")).when(n == 4, F.concat(F.lit("C:"), "path")).when(n == 5, F.lit("first://")).otherwise(F.concat(F.lit("/v/"), "path"))
    roots = pages.select(F.concat(F.lit("/v/"), F.split_part("path", F.lit("/"), F.lit(1))).alias("path")).distinct().select(F.col("path").alias("name"), "path")
    roots = roots.unionByName(spark.createDataFrame([("first", "/first")], "name string, path string"))
    return paths.resolve(pages.select("page_id", raw.alias("raw")), "raw", roots).select("page_id", "root", "relative", "code")


# --- vectors, functions -----------------------------------------------------------------------------------------------------


@c.query(f"""WITH t AS (SELECT path, count(*) AS n, CAST(path AS BIGINT) AS id FROM {c._TURNS} GROUP BY path), stale AS (SELECT * FROM t WHERE id % 3 <> 0),
  taken AS (SELECT * FROM stale ORDER BY id DESC LIMIT 25)
SELECT count(*) AS paths_scanned, CAST(sum(n) AS BIGINT) AS embedded, 0 AS skipped, 0 AS failed, (SELECT count(*) FROM stale) - count(*) AS remaining FROM taken""")
def semantic_rebuild_budgeted(spark, d):
    """A rebuild's step over 25 of the conversations that have no vectors yet, the newest first."""
    chunks = c._turns(spark, d)
    stored = semantic.embed(chunks.where("CAST(path AS BIGINT) % 3 = 0"))
    return semantic.rebuild(stored, chunks, 25, priority=F.col("path").cast("long"))[1]


@c.query(f"SELECT x.b AS note, y.a AS source, 'link' AS kind, 1 AS n FROM (SELECT DISTINCT b FROM {c._TRADE} WHERE starts_with(b, 'n')) x JOIN {c._TRADE} y ON x.b = y.b")
def sql_table_functions(spark, d):
    """Backlinks of all nations by a registered function that SQL calls beside a table."""
    c._trade_nodes(spark, d).createOrReplaceTempView("graph_nodes")
    c._trade_graph(spark, d).createOrReplaceTempView("graph_edges")
    registry.install(spark, "note_backlinks", "notes_under")
    return spark.sql("SELECT x.note, f.source, f.kind, f.n FROM (SELECT DISTINCT `to` AS note FROM graph_edges WHERE startswith(`to`, 'n')) x, LATERAL note_backlinks(x.note) AS f")


# --- the moon -----------------------------------------------------------------------------------------------------------------


def _phase_sql(quarter: float) -> str:
    """Dynamical Julian day of a phase near lunation n - quarter, from a row with n."""
    sin, cos = (lambda x, f=f: f"{f}(radians({x}))" for f in ("sin", "cos"))
    m, mp, f = "(2.5534 + 29.10535670 * n)", "(201.5643 + 385.81693528 * n + 0.0107582 * t * t)", "(160.7108 + 390.67050284 * n - 0.0016118 * t * t)"
    e = "(1 - 0.002516 * t - 0.0000074 * t * t)"
    mean = "2451550.09766 + 29.530588861 * n + 0.00015437 * t * t"
    if quarter in (0, 0.5):
        a, b, c_, d = (-0.40720, 0.17241, 0.01608, 0.01039) if quarter == 0 else (-0.40614, 0.17302, 0.01614, 0.01043)
        return f"{mean} + {a} * {sin(mp)} + {b} * {e} * {sin(m)} + {c_} * {sin('2 * ' + mp)} + {d} * {sin('2 * ' + f)} + 0.0074 * {e} * {sin(mp + ' - ' + m)} - 0.00514 * {e} * {sin(mp + ' + ' + m)} + 0.00208 * {e} * {e} * {sin('2 * ' + m)}"
    w = f"(0.00306 - 0.00038 * {e} * {cos(m)} + 0.00026 * {cos(mp)})"
    rest = f"-0.62801 * {sin(mp)} + 0.17172 * {e} * {sin(m)} - 0.01183 * {e} * {sin(mp + ' + ' + m)} + 0.00862 * {sin('2 * ' + mp)} + 0.00804 * {sin('2 * ' + f)} + 0.00454 * {e} * {sin(mp + ' - ' + m)} + 0.00204 * {e} * {e} * {sin('2 * ' + m)}"
    return f"{mean} + {rest} {'+' if quarter == 0.25 else '-'} {w}"


_QUARTERS = {0: "near_new", 0.25: "near_first_quarter", 0.5: "near_full", 0.75: "near_last_quarter"}
_LUNATIONS = " UNION ALL ".join(f"SELECT day, jd, {q} AS q, {_phase_sql(q)} AS phase FROM (SELECT *, n / 1236.85 AS t FROM (SELECT *, k + i + {q} AS n FROM mean, (SELECT unnest([-1, 0, 1]) AS i)))" for q in _QUARTERS)


@c.query(f"""WITH mean AS (SELECT day, jd, floor((jd - 2451550.09766) / {astro.SYNODIC}) AS k FROM (SELECT day, date_diff('day', DATE '1970-01-01', day) + 2440587.5 AS jd FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))),
  lunations AS ({_LUNATIONS}),
  flags AS (SELECT day, any_value(jd) AS jd, max(phase) FILTER (q = 0 AND phase <= jd) AS new, {', '.join(f"min(abs(phase - jd)) FILTER (q = {q}) * 24 <= 12 AS {n}" for q, n in _QUARTERS.items())} FROM lunations GROUP BY day)
SELECT day, list_extract({list(astro.PHASES)}, 1 + CAST(floor((jd - new) / {astro.SYNODIC} * 8 + 0.5) AS INT) % 8) AS name, round(jd - new, 6) AS days_into_cycle, {', '.join(_QUARTERS.values())} FROM flags""")
def astro_moon_flags(spark, d):
    """The name of the moon's phase on days of orders, the days since the new moon, and which phases are within half a day."""
    days = c.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", astro.moon_phase(F.col("day")).alias("p")).select("day", "p.name", F.round("p.days_into_cycle", 6).alias("days_into_cycle"), *(f"p.{n}" for n in _QUARTERS.values()))
