import pytest

from skerry.operators import graph
from skerry.operators.graph_store import GraphStore

LINKS = "edge_id string, `from` string, target string, kind string"
NOTES = "path string, title string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def start(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "A"), ("b.md", "B"), ("c.md", "C")], NOTES)
    links = spark.createDataFrame([("a#1", "a.md", "b", "link"), ("a#2", "a.md", "b", "link"), ("b#1", "b.md", "ghost", "embed")], LINKS)
    log = GraphStore(spark, str(tmp_path / "g"))
    return log, *graph.resolve(links, notes)


def same(a, b):
    assert rows(a.nodes.select("path", "title", "phantom")) == rows(b.nodes.select("path", "title", "phantom")) and rows(a.edges.select("edge_id", "from", "to", "kind")) == rows(b.edges.select("edge_id", "from", "to", "kind"))
    assert a.generation == b.generation


def test_readers_replay_generations(spark, tmp_path):
    log, nodes, edges = start(spark, tmp_path)
    assert log.generation() == 0 and log.load().generation == 0
    assert log.rebuild(nodes, edges) == 1
    reader = log.load()
    assert len(rows(reader.edges)) == 3 and log.catch_up(reader)[1] == "none"  # parallel links stay apart
    two = log.upsert(spark.createDataFrame([("ghost.md", "Ghost")], NOTES), spark.createDataFrame([("g#1", "ghost.md", "a", "link")], LINKS))
    three = log.remove(spark.createDataFrame([("b.md",), ("nowhere.md",)], "path string"))
    assert (two, three) == (2, 3)
    want = graph.remove(*graph.upsert(nodes, edges, spark.createDataFrame([("ghost.md", "Ghost")], NOTES), spark.createDataFrame([("g#1", "ghost.md", "a", "link")], LINKS)), spark.createDataFrame([("b.md",)], "path string"))
    now, how = log.catch_up(reader)
    assert how == "partial" and rows(now.nodes) == rows(want[0]) and rows(now.edges) == rows(want[1])
    same(now, log.load())
    # replaying the same generations on a newer state changes nothing
    now.generation = 1
    same(log.catch_up(now)[0], log.load())
    # a generation holds only what it changes
    assert {r["kind"] for r in log.changes(2).collect()} <= {"upsert_node", "remove_node", "remove_edge"} and log.changes(2).count() <= 4
    assert log.remove(spark.createDataFrame([("nowhere.md",)], "path string")) == 3


def test_a_reset_and_a_reader_too_old_load_anew(spark, tmp_path):
    log, nodes, edges = start(spark, tmp_path)
    log.rebuild(nodes, edges)
    old = log.load()
    for n in range(3):
        log.upsert(spark.createDataFrame([("a.md", f"A{n}")], NOTES), spark.createDataFrame([(f"a#{n}", "a.md", "c", "link")], LINKS))
    middle = log.load()
    want = rows(middle.nodes), rows(middle.edges)
    assert log.catch_up(old, retention=2)[1] == "full_reload" and log.catch_up(old)[1] == "partial"
    log.trim(retention=2)
    assert log._numbers("changes") == [3, 4] and log._numbers("snapshot") == [4]
    now, how = log.catch_up(old)
    assert how == "full_reload" and (rows(now.nodes), rows(now.edges)) == want
    log.rebuild(nodes, edges.limit(0))
    now, how = log.catch_up(now)
    assert how == "full_reload" and rows(now.edges) == []
    log.upsert(spark.createDataFrame([("z.md", "Z")], NOTES), spark.createDataFrame([], LINKS))
    now, how = log.catch_up(now)
    assert how == "partial" and ("z.md", "Z", False) in rows(now.nodes)


def test_one_of_two_writers_fails(spark, tmp_path):
    log, nodes, edges = start(spark, tmp_path)
    log.rebuild(nodes, edges)
    with pytest.raises(Exception, match="(?i)exist"):
        log._append(log.changes(), 1)
    assert log.generation() == 1
