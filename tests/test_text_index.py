import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from skerry import store
from skerry.errors import EngineError
from skerry.operators import search
from skerry.operators.text_index import TextIndex

SCHEMA = "id long, title string, body string, v long"
BOOSTS = {"title": 2.0, "body": 1.0}
QUERIES = ["apple", "apple pear", '"apple pie"', "+apple -green", "title:apple body:pear", '"green apple" of', "nowhere", "pear of the apple"]


def stamp():
    return F.col("v").cast("string")


def table(spark, n=60):
    data = [(i, f"title {'apple' if i % 5 == 0 else 'pear'}", " ".join(["apple pie", "green apple", "pear", "the of"][j % 4] for j in range(i % 9 + 1)), i) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def same(index, df, k=15, texts=QUERIES):
    for text in texts:
        want = [(r["id"], round(r["score"], 9)) for r in search.search(df, "id", text, k, BOOSTS).collect()]
        assert [(r["id"], round(r["score"], 9)) for r in index.query(text, k, BOOSTS).collect()] == want, text


def files(spark, index):
    return {p for part in ("terms", "postings", "rows", "dead") for s in store.children(spark, f"{index.folder}/{part}") for p in (f"{part}/{s}/{x}" for x in store.children(spark, f"{index.folder}/{part}/{s}"))}


def test_updates_equal_a_scan_of_the_table(spark, tmp_path):
    index, df = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4), table(spark)
    with pytest.raises(EngineError):
        index.query("apple")
    index.upsert(df, stamp())
    same(index, df)
    before = files(spark, index)
    new = spark.createDataFrame([(7, "pie", "apple pie apple pie", 99), (99, None, "green apple", 1), (None, "no key", "apple", 1), (7, "old", "older", 98)], SCHEMA)
    index.upsert(new, stamp())
    df = df.where("id <> 7").union(new.where("v in (99, 1) and id is not null"))
    same(index, df)
    assert before < files(spark, index)  # nothing stored is written again
    index.remove(spark.createDataFrame([(3,), (4,), (12345,)], "id long"))
    index.remove(spark.createDataFrame([(3,)], "id long"))  # gone already: counted down once only
    df = df.where("id not in (3, 4)")
    same(index, df)
    terms = {(r["field"], r["term"]): r["df"] for r in index.dictionary().collect()}
    for f, w in (("title", "pie"), ("body", "apple"), ("title", "pear")):
        assert terms[f, w] == df.where(F.array_contains(search.tokens(F.col(f)), w)).count()
    index.upsert(spark.createDataFrame([(3, "back", "apple", 5)], SCHEMA), stamp())  # a removed key may come back
    df = df.union(spark.createDataFrame([(3, "back", "apple", 5)], SCHEMA))
    same(index, df, texts=["apple", "back"])
    index.compact(keep=1)
    assert len(index.segments()) == 2
    same(index, df)
    index.compact()
    assert len(index.segments()) == 1
    same(index, df)
    index.vacuum()
    assert len(files(spark, index)) == 3
    same(index, df, texts=["apple", "+apple -green"])


def test_refresh_takes_only_what_changed(spark, tmp_path):
    index, df = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4), table(spark)
    index.refresh(df, stamp())
    now = df.where("id <> 3").withColumns({"body": F.when(F.col("id") == 8, "pear pear").otherwise(F.col("body")), "v": F.when(F.col("id") == 8, 500).otherwise(F.col("v"))}).union(spark.createDataFrame([(70, "new", "apple", 1)], SCHEMA))
    index.refresh(now, stamp())
    same(index, now)
    taken = [spark.read.parquet(f"{index.folder}/rows/{s['name']}").count() for s in index.segments() if "rows" in s["parts"]]
    assert taken == [60, 2]
    stamps = {r["key"]: r["stamp"] for r in index.entries().collect()}
    assert len(stamps) == 60 and stamps[8] == "500" and 3 not in stamps


def test_a_filter_restricts_hits_and_not_the_statistics(spark, tmp_path):
    index, df = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4), table(spark)
    index.upsert(df, stamp())
    got = index.query("apple pear", 9, BOOSTS, where=df.where("id % 3 = 0").select("id"))
    want = search.search(df, "id", "apple pear", 9, BOOSTS, where=F.col("id") % 3 == 0)
    assert [(r["id"], round(r["score"], 9)) for r in got.collect()] == [(r["id"], round(r["score"], 9)) for r in want.collect()]


def test_low_levels_are_not_read_and_hits_stay_the_same(spark, tmp_path, monkeypatch):
    draw, data = random.Random(5), []
    for i in range(3000):
        body = ["common"] * draw.choice((1, 1, 1, 2, 8)) + [f"f{draw.randrange(400)}" for _ in range(draw.randrange(3, 120))] + (["rare"] if i % 97 == 0 else [])
        draw.shuffle(body)
        data.append((i, "t", " ".join(body), i))
    df = spark.createDataFrame(data, SCHEMA)
    index = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4)
    index.upsert(df.where("id < 2000"), stamp())
    index.upsert(df.where("id >= 1500"), stamp())
    whole = spark.read.parquet(f"{index.folder}/postings").where("term = 'common'").count()
    read, rows = [], index._rows
    monkeypatch.setattr(index, "_rows", lambda postings, *rest: read.append(postings) or rows(postings, *rest))
    same(index, df, 5, ["common", "common rare", "rare", "+common rare f7"])
    plan = index.query("common", 5, BOOSTS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,common)" in plan and whole == 3500
    assert read[-1].count() < whole // 4  # the second pass, for "common"
    assert index.query("common", 5000, BOOSTS).count() == 3000


def test_two_writers_of_one_version(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4)
    index.upsert(table(spark, 5), stamp())
    with pytest.raises(Exception, match="exist|EXIST"):
        index._publish(1, index.segments())
    assert index.version() == 1


def test_empty_tables_and_texts(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4)
    index.upsert(table(spark).limit(0), stamp())
    assert index.query("apple", 3, BOOSTS).count() == 0
    index.upsert(spark.createDataFrame([(1, None, None, 1), (2, "", "apple", None)], SCHEMA), stamp())
    assert [r["id"] for r in index.query("apple", 3, BOOSTS).collect()] == [2]
    index.refresh(table(spark).limit(0), stamp())
    assert index.query("apple", 3, BOOSTS).count() == 0 and index.entries().count() == 0


def test_an_index_is_built_by_one_shuffle_of_texts_terms(spark, tmp_path, monkeypatch):
    """A text goes into no shuffle, and of its terms each one goes once, not each of its words."""
    index = TextIndex(spark, str(tmp_path / "i"), "id", list(BOOSTS), 4)
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())) or write(self, path, *a, **b))
    index.upsert(table(spark), stamp())
    texts = [plan for path, plan in plans if "/rows/" in path]
    postings = [plan for path, plan in plans if "/postings/" in path]
    assert len(texts) == 1 and "Exchange" not in texts[0]
    assert len(postings) == 1 and postings[0].count("Exchange") == 1 and "Aggregate" not in postings[0]
    stored = spark.read.parquet(f"{index.folder}/postings")
    row = stored.where("key = 8 and field = 'body' and term = 'apple'").first()
    body = table(spark).where("id = 8").select(search.tokens(F.col("body")).alias("w")).first()["w"]
    assert row["at"] == [i for i, w in enumerate(body) if w == "apple"] and row["tf"] == len(row["at"]) and row["n"] == len(body)
