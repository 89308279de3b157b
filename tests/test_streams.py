import datetime as dt

import pytest
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.operators import graph, paths, semantic, sync, vectors
from skerry.plans import registry
from skerry.streaming import events, ordered
from skerry.streaming.drain import drain, rocks, run_available, run_once


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str) if columns else [r.asDict(recursive=True) for r in df.collect()]


class Ticks:
    """A clock that goes on by one whenever it is read."""

    def __init__(self):
        self.now = 0

    def __call__(self):
        self.now += 1
        return self.now


def _work(path):
    if path.startswith("bad"):
        raise ValueError(f"no {path}")
    return path.upper()


def test_a_queue_is_drained_within_its_budget_and_resumes_after_a_restart(spark, tmp_path):
    schema = "lane int, path string, seq long"

    def put(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        with rocks(spark):
            run_once(drain(stream, "lane", "path", "seq", _work, 3, Ticks(), 1), f"{tmp_path}/out", f"{tmp_path}/check")
        return rows(spark.read.parquet(f"{tmp_path}/out"), "lane", "place", "path", "outcome", "detail", "waiting")

    # a budget of three ticks, of which a path takes one: the deadline is reached after the third
    put("1", [(1, "c", 3), (1, "a", 1), (1, "bad", 2), (1, "a", 9), (1, "d", 4), (1, "e", 5), (2, "x", 7), (1, None, 0)])
    first = run()
    assert first == [(1, 0, "a", "done", "A", 2), (1, 1, "bad", "failed", "no bad", 2), (1, 2, "c", "done", "C", 2), (2, 0, "x", "done", "X", 0)]
    # started anew from its checkpoint: d waits already and keeps its place, a may come again
    put("2", [(1, "a", 20), (1, "d", 21), (2, "y", 22), (2, "x", 23)])
    assert [x[:3] for x in run() if x not in first] == [(1, 3, "d"), (1, 4, "e"), (1, 5, "a"), (2, 1, "y"), (2, 2, "x")]


def test_at_least_one_path_is_worked_on(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "lane int, path string, seq long").write.parquet(f"{tmp_path}/in")
    with rocks(spark):
        run_once(drain(spark.readStream.schema("lane int, path string, seq long").parquet(f"{tmp_path}/in"), "lane", "path", "seq", _work, 0, Ticks()), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "path", "waiting") == [("a", 1)]


def _at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10, minute, second)


def test_live_commits_equal_the_batch_and_late_events_are_dropped(spark, tmp_path):
    schema = "event long, path string, at timestamp"
    batches = [
        [(1, "a", _at(0, 0)), (2, "a", _at(0, 20)), (3, "b", _at(0, 5))],
        [(4, "a", _at(0, 45)), (5, "b", _at(2, 0))],  # the burst of a goes on, b begins another
        [(6, "c", _at(20, 0))],  # the watermark passes all of these
        [(7, "a", _at(1, 0)), (8, "c", _at(20, 10))],  # too late; in time
        [(9, "d", _at(59, 0))],
    ]
    progress = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        live = events.commits(stream, "path", "at", "30 seconds", "5 minutes")
        progress += run_available(live, f"{tmp_path}/out", f"{tmp_path}/check").recentProgress
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "path", "began", "last_at", "n_events")
    kept = spark.createDataFrame([e for batch in batches for e in batch if e[0] != 7], schema)
    want = [r for r in rows(events.commits(kept, "path", "at", "30 seconds"), "path", "began", "last_at", "n_events") if r[0] != "d"]
    assert got == want and len(want) == 4
    states = [s for p in progress for s in p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1 and states[-1]["numRowsTotal"] == 1 and max(s["numRowsTotal"] for s in states) > 1


def test_a_live_queue_forgets_paths_behind_the_watermark(spark, tmp_path):
    schema, progress = "path string, at timestamp", []
    for n, batch in enumerate([[("a", _at(0)), ("a", _at(1))], [("a", _at(2)), ("b", _at(3))], [("c", _at(30))], [("a", _at(31))]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        progress += run_available(events.queue(stream, "path", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check").recentProgress
    assert [r[0] for r in rows(spark.read.parquet(f"{tmp_path}/out"), "path")] == ["a", "a", "b", "c"]
    assert [s for p in progress for s in p["stateOperators"]][-1]["numRowsTotal"] == 2


def test_rows_are_applied_in_order_up_to_a_failure_and_resumed(spark, tmp_path):
    data = [("p", n, "x") for n in range(5)] + [("q", 1, "x"), ("q", 2, "x"), (None, 3, "x"), ("r", None, "x")]
    table = spark.createDataFrame(data, "part string, seq long, text string").repartition(3)
    log = tmp_path / "log"
    log.mkdir()

    def sink(broken):
        def take(row):
            if (row["part"], row["seq"]) == broken:
                raise OSError("disk full")
            with open(log / row["part"], "a") as f:
                f.write(f"{row['seq']} ")

        return take

    buffer = ordered.RetryBuffer(spark, str(tmp_path / "positions"))
    columns = ("partition", "position", "applied", "waiting", "error")
    assert rows(buffer.flush(table, "part", "seq", sink(("p", 2))), *columns) == [("p", 1, 2, 3, "disk full"), ("q", 2, 2, 0, None)]
    assert rows(buffer.flush(table, "part", "seq", sink(("p", 2))), *columns) == [("p", 1, 0, 3, "disk full"), ("q", 2, 0, 0, None)]
    more = table.union(spark.createDataFrame([("q", 9, "x"), ("s", 1, "x")], table.schema))
    assert rows(buffer.flush(more, "part", "seq", sink(("s", 1))), *columns) == [("p", 4, 3, 0, None), ("q", 9, 1, 0, None), ("s", None, 0, 1, "disk full")]
    assert {f.name: f.read_text().split() for f in log.iterdir()} == {"p": list("01234"), "q": ["1", "2", "9"]}
    assert rows(buffer.flush(more.limit(0), "part", "seq", sink(None)), "partition", "position") == [("p", 4), ("q", 9)]


def test_restore_brings_paths_back_and_deletes_only_where_allowed(spark):
    data = [("a", 1, 1, "one"), ("a", 5, 2, "two"), ("b", 2, 3, "b"), ("b", 6, 4, None), ("c", 7, 5, "new"), ("d/x", 1, 6, "x"), ("d/x", 8, 7, "y"), (".git/h", 1, 8, "1"), (".git/h", 9, 9, "2"), ("same", 1, 10, "s"), ("same", 5, 11, "s")]
    versions = spark.createDataFrame([(p, _at(m), s, c) for p, m, s, c in data], "path string, at timestamp, seq long, content string")
    at = F.lit(_at(4))
    plan = {r["path"]: (r["action"], r["content"]) for r in rows(sync.restore_plan(versions, at))}
    assert plan == {"a": ("write", "one"), "b": ("write", "b"), "c": ("delete", None), "d/x": ("write", "x")}
    with pytest.raises(EngineError):
        sync.restore(versions, at, F.lit(_at(30)))
    scoped = sync.restore(versions, at, F.lit(_at(30)), scope="d")
    assert dict(rows(sync.as_of(scoped), "path", "content"))["d/x"] == "x" and dict(rows(sync.as_of(scoped), "path", "content"))["a"] == "two"
    whole = sync.restore(versions, at, F.lit(_at(30)), destructive=True)
    assert dict(rows(sync.as_of(whole), "path", "content")) == {"a": "one", "b": "b", "d/x": "x", ".git/h": "2", "same": "s"}
    assert sync.restore_plan(whole, at).isEmpty() and whole.count() == versions.count() + 4
    diff = {r["path"]: (r["status"], r["patch"].splitlines()[-2:]) for r in rows(sync.restore_diff(versions, at))}
    assert diff["a"] == ("changed", ["-two", "+one"]) and diff["b"][0] == "added" and diff["c"][0] == "removed"


def test_paths_are_resolved_to_the_longest_root(spark):
    roots = spark.createDataFrame([("home", "/v/home"), ("inner", "/v/home/inner/"), ("other", "/o")], "name string, path string")
    given = ["/v/home/a.md", "/v/home/inner/b/./c.md", "/v/homes/a", "/o", "/o//x/", "a.md", "home://a/b", "home:///v/home/q", "home:///o/x", "none://a", "home://", "home://.", "/v/home/../x", "a\\..\\b", "C:\\x", "\\\\srv\\x", "/o/a:b", "", None, "1x://a", "/"]
    got = {r["p"]: (r["root"], r["relative"], r["code"]) for r in rows(paths.resolve(spark.createDataFrame([(p,) for p in given], "p string"), "p", roots))}
    outside, windows = "path/outside-root", "path/invalid-windows-path"
    assert got == {
        "/v/home/a.md": ("home", "a.md", None), "/v/home/inner/b/./c.md": ("inner", "b/c.md", None), "/v/homes/a": (None, None, outside), "/o": ("other", "", None), "/o//x/": ("other", "x", None),
        "a.md": (None, None, "path/ambiguous-root"), "home://a/b": ("home", "a/b", None), "home:///v/home/q": ("home", "q", None), "home:///o/x": (None, None, outside), "none://a": (None, None, "path/unknown-vault-name"),
        "home://": (None, None, "path/empty-named-prefix"), "home://.": ("home", "", None), "/v/home/../x": (None, None, outside), "a\\..\\b": (None, None, outside), "C:\\x": (None, None, windows), "\\\\srv\\x": (None, None, windows),
        "/o/a:b": (None, None, windows), "": (None, None, "path/invalid"), None: (None, None, "path/invalid"), "1x://a": (None, None, windows), "/": (None, None, outside),
    }
    one = paths.resolve(spark.createDataFrame([("a//b",)], "p string"), "p", roots.where("name = 'other'")).first()
    assert (one["root"], one["relative"], one["code"]) == ("other", "a/b", None)
    assert paths.resolve(spark.createDataFrame([("/a",)], "p string"), "p", roots.limit(0)).first()["code"] == "path/invalid-root"


def test_a_rebuild_is_resumed_within_its_budget(spark, tmp_path):
    schema = "path string, ordinal int, heading_context array<string>, text string, content_hash string, mtime long"
    chunks = spark.createDataFrame([(f"p{n}", k, ["h"], f"text {n} {k}", f"h{n}{k}", n) for n in range(5) for k in range(2)], schema)
    stored = spark.createDataFrame([], "path string, ordinal int, heading_context array<string>, content_hash string, vector array<float>")
    reports, step = [], 0
    while not reports or reports[-1]["remaining"]:
        after, report = semantic.rebuild(stored, chunks, 2, priority=F.col("mtime"))
        reports.append(report.first().asDict())
        after.write.parquet(f"{tmp_path}/{step}")
        stored, step = spark.read.parquet(f"{tmp_path}/{step}"), step + 1
        if step == 1:
            assert [r[0] for r in rows(stored.select("path").distinct(), "path")] == ["p3", "p4"]
    assert [(r["paths_scanned"], r["embedded"], r["remaining"]) for r in reports] == [(2, 4, 3), (2, 4, 1), (1, 2, 0)]
    want = dict(rows(chunks.select(F.concat("path", "ordinal").alias("k"), vectors.hash_embedding(F.col("text")).alias("v")), "k", "v"))
    assert dict(rows(stored.select(F.concat("path", "ordinal").alias("k"), F.col("vector").alias("v")), "k", "v")) == want
    # one chunk changes, one path goes, one batch fails
    changed = chunks.where("path <> 'p0'").withColumns({"content_hash": F.when(F.expr("path = 'p1' AND ordinal = 0"), "new").otherwise(F.col("content_hash")), "text": F.when(F.expr("path = 'p1' AND ordinal = 0"), "fail").otherwise(F.col("text"))})

    def picky():
        def model(texts):
            if "fail" in texts:
                raise ValueError("refused")
            return semantic._hash_model()(texts)

        return model

    semantic.register_model("picky", picky)
    after, report = semantic.rebuild(stored, changed, name="picky")
    assert report.first().asDict() == {"paths_scanned": 2, "embedded": 0, "skipped": 1, "failed": 1, "remaining": 0}
    assert after.where("path = 'p0'").isEmpty() and after.count() == 7
    assert semantic.rebuild(after, changed, 1)[1].first()["paths_scanned"] == 1


def test_operations_are_table_functions_of_sql(spark):
    notes = spark.createDataFrame([("a.md", "A"), ("f/b.md", "B")], "path string, title string")
    links = spark.createDataFrame([("1", "a.md", "f/b", "link"), ("2", "a.md", "f/b", "link"), ("3", "f/b.md", "f/b", "embed")], "edge_id string, `from` string, target string, kind string")
    nodes, edges = graph.resolve(links, notes)
    nodes.createOrReplaceTempView("graph_nodes")
    edges.createOrReplaceTempView("graph_edges")
    registry.install(spark)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM note_backlinks('f/b.md')").collect()) == [("a.md", "link", 2), ("f/b.md", "embed", 1)]
    assert spark.sql("SELECT path FROM notes_under('f/')").first()["path"] == "f/b.md"
    spark.createDataFrame([(1, "see [[x|y]] and ![[p.png]]"), (2, "# H\nbody"), (3, None), (4, "[[open")], "id int, text string").createOrReplaceTempView("texts")
    assert sorted(tuple(r) for r in spark.sql("SELECT id, l.target, l.embed FROM texts, LATERAL note_links(text) AS l").collect()) == [(1, "p.png", True), (1, "x", False)]
    assert [tuple(r) for r in spark.sql("SELECT id, s.heading_context[0], s.body FROM texts, LATERAL note_sections(text) AS s WHERE id = 2").collect()] == [(2, "H", "body")]
    with pytest.raises(EngineError):
        registry.register_function("note_links", registry.TableFunction("a INT", "b INT", body="SELECT a"))
    with pytest.raises(EngineError):
        registry.install(spark, "unknown")
