import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import helpers as h


def test_every_stage_acts_and_keeps_the_columns(spark, tmp_path):
    good, junk = [f"fine{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    import random

    def text(i, pool):
        draw = random.Random(i)
        return " ".join(draw.choice(pool) + (f" w{draw.randrange(5000)}" if k % 2 else "") for k in range(80))

    texts = [text(i, good if i % 3 else junk) for i in range(150)]
    item, passage = h.prose(1, 30), " ".join(x for k in range(60) for x in (good[k], f"p{k}"))
    texts += [texts[1], texts[2] + " end", text(901, good) + " " + item, *(text(902 + k, good) + " " + passage + " " + text(912 + k, good) for k in range(2)), None, ""]
    h.table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r for r in h.rows(docs)}
        assert name == "sentencepiece_codec" or docs.columns == columns
    classified = left["quality_classifier"]
    assert sum(i % 3 > 0 for i in classified if i < 150) >= 90 and sum(i % 3 == 0 for i in classified if i < 150) <= 5
    assert not {150, 151} & set(left["jaccard_join"]) and 1 in left["jaccard_join"]
    assert h.words(passage)[30] in h.words(left["suffix_dedup"][153]["text"]) and h.words(passage)[30] + " p15" not in left["suffix_dedup"][154]["text"]
    assert 152 in left["suffix_dedup"] and 152 not in left["decontamination"]
    encoded = left["sentencepiece_codec"]
    assert set(encoded) == set(left["decontamination"]) and all(r["round_trip"] and r["n_ids"] > 0 for r in encoded.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids"] for r in h.rows(whole)} == {i: r["ids"] for i, r in encoded.items()}
    assert corpus_pipeline.ORACLE_SQL is None and whole.where(F.col("ids").isNull()).count() == 0


def test_near_copies_of_five_word_shingles_go(spark):
    words = h.prose(1, 100).split()
    between = " ".join("edit" + w if i in (30, 70) else w for i, w in enumerate(words))
    a, b = (h.shingle_set(t, 3) for t in (" ".join(words), between))
    c, d = (h.shingle_set(t, 5) for t in (" ".join(words), between))
    assert 100 * len(a & b) < 90 * len(a | b) and 100 * len(c & d) >= 80 * len(c | d)
    kept = corpus_pipeline.keep_one_of_similar(spark, h.table(spark, [" ".join(words), between, h.prose(2, 100)]), "")
    assert sorted(r["doc_id"] for r in h.rows(kept)) == [0, 2]


def test_stages_of_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    spark.createDataFrame([(1, h.prose(1, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [" ".join([f"fine{i % 7}", f"good{i % 5}"] * 20) + " " + h.prose(100 + i, 60) for i in range(60)]
    rows = [*((i, good[i] if i % 2 else "junk junk buy " * 20 + h.prose(300 + i, 9)) for i in range(60))]
    # without an id, under one id, repeated rows, without a text
    rows += [(None, good[1]), (None, good[50] + " more"), (7, good[52]), (7, good[52]), (7, good[7]), (None, None), (8, ""), (9, None)]
    docs = h.table(spark, rows, more=h.CLASHING)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in h.rows(now)]
        if name == "jaccard_join":
            assert (1, good[1]) in left and (None, good[1]) not in left and left.count((7, good[52])) == 1 and left.count((7, good[7])) == 1 and (None, good[50] + " more") in left
    encoded = h.rows(corpus_pipeline.encode(spark, now, str(tmp_path)))
    assert len(encoded) == now.count() and {r["n_ids"] for r in encoded if not r["ids"]} <= {0}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.encode(spark, empty, str(tmp_path)).count() == 0


def test_results_outlive_the_stages_of_a_pipeline(spark):
    """A lazy result of another query is still there after a stage has released its own tables."""
    from skerry.llm import sharding

    lazy = sharding.shard(h.table(spark, [h.prose(i, 9) for i in range(20)]), shards=4)
    corpus_pipeline.keep_one_of_similar(spark, h.table(spark, ["a b c d e f", "x y z"]), "").count()
    corpus_pipeline.cut_repeated_passages(spark, h.table(spark, ["a b c d e f", "x y z"]), "").count()
    assert lazy.count() == 20
