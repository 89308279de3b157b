"""A training-corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. A stage deletes the working tables
of the stage before, as that one's result has been stored by then, and no others. All but the last return the columns of
documents, also further ones that documents may have; the last returns the token ids of each text that is left.

Defined results: an empty table stays one. Rows without an id, and different texts under one id, are rows of their own in
every stage. A null or an empty text is scored like any other; if it is kept, it has no copies, repeats or leaks, and its
ids are an empty list.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import common, decontamination, jaccard_join, quality_classifier, sentencepiece_codec, suffix_dedup

SCOPE = "corpus_pipeline"
#: The codec's cache in a worker: smaller than its own, as an executor's heap has grown in the stages before.
CACHE_BYTES = 24_000_000


@contextlib.contextmanager
def _fresh(spark: SparkSession) -> Iterator[None]:
    """The stages' own scope for working tables; those of the stage before are deleted."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        yield


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects, by a score under 0.7, go. Without usable labels every score is 0.5, so all go."""
    with _fresh(spark):
        return quality_classifier.keep(docs, quality_classifier.fit(docs, common.table(spark, sf_dir, "labels")))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of rows that links join, the one with the smallest id stays, without ids that of the smallest hash of its text.

    Sets of five-word shingles link at 0.8. Texts without a word are in no group and stay."""
    with _fresh(spark):
        return jaccard_join.keep_one(docs, jaccard_join.Settings(n=5, percent=80))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of 50 words or more that stand in an earlier place are cut; texts that this leaves without a word go.

    Other texts, null and empty ones among them, stay as they are; n_chars is counted anew where a text has changed."""
    with _fresh(spark):
        return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a test item, also an edited one, go. With an empty benchmark all stay."""
    with _fresh(spark):
        return decontamination.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every text becomes the ids of its subword pieces, a null one an empty list."""
    with _fresh(spark):
        return sentencepiece_codec.encode(docs, sentencepiece_codec.default_model(), CACHE_BYTES)


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_similar),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece_codec", encode),
]

#: SQL expresses neither trained models nor subword encoding; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{common.new_id()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
