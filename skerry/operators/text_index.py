"""A stored text index of immutable segments: upsert by key, removal, refresh, compaction, and ranked queries that read their terms alone.

    terms/segment=S/write=W/bucket=B      (field, term, df, levels): the dictionary. df counts rows; a segment that replaces or removes
                                  rows also has negative counts for the terms of the old ones, so that sums are those of live rows
    postings/segment=S/write=W/bucket=B   (field, term, level, key, tf, n, at): a term's rows by falling level, the impact of a posting
                                  in sixteen steps; n is the row's length in the field, so no query reads all rows' lengths
    rows/segment=S/write=W            (key, stamp, n_<field>, terms): each row's terms with their places. Postings are made from it, by one
                                  shuffle of a row for each term of a text, and updates count down the terms of rows that they replace
    dead/segment=S/write=W            (key): rows of earlier segments that this one replaces or removes
    manifest/V                    (segment, n_rows, sums): the live segments, written last; a reader takes the newest whole version

Every update writes one segment, in proportion to what it changes, and a manifest; nothing stored is written again until
compact() joins segments. Two writers of one version can't both succeed, as a manifest's folder is never overwritten; the
one that fails leaves a segment that no manifest names.

query() sums the dictionary's counts of the query's words and averages from the manifest. From each level's largest count
and smallest length it bounds the score that the level's postings can add. The best levels give a score that the k-th hit
reaches at least; levels whose bound, with the most that the other words can add, stays below it are not read. This is
exact. Queries with phrases or excluded words, or with a filter, read all levels of their words.

Defined results: rows without a key aren't indexed; of rows with one key in a batch that with the largest stamp counts
(ties: any one of them, whole); a null text has no words; k below 1 counts as 1.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry import store
from skerry.errors import EngineError
from skerry.operators import search

LEVELS = 16
#: Rows of a batch for which the postings of one term are sorted by one task.
SLICE_ROWS = 2_000_000
#: Rows whose words are grouped at a time.
BATCH_ROWS = 1000
#: Keys up to which a list of rows is broadcast, so that texts and terms aren't shuffled.
BROADCAST_KEYS = 200_000


class TextIndex:
    """An index in a shared folder; fields are text columns of the rows that it is given, key their unique column."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: list[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.fields, self.buckets = spark, folder.rstrip("/"), key, fields, buckets

    # --- segments and their manifest

    def version(self) -> int:
        """The newest whole version; 0 before the first."""
        names = store.children(self.spark, f"{self.folder}/manifest")
        whole = [n for n in names if n.isdigit() and "_SUCCESS" in store.children(self.spark, f"{self.folder}/manifest/{n}")]
        return max(map(int, whole), default=0)

    def segments(self, version: int | None = None) -> list[dict]:
        """Number, name, live rows added and lengths added by each live segment; their number is kept small by compact()."""
        version = self.version() if version is None else version
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/manifest/{version:08d}").collect()] if version else []

    def _publish(self, version: int, segments: list[dict]) -> None:
        lines = self.spark.createDataFrame([(json.dumps(s),) for s in segments], "value string")
        lines.coalesce(1).write.mode("error").text(f"{self.folder}/manifest/{version:08d}")

    def _schema(self, part: str, places: bool = False) -> T.StructType:
        kind = self.spark.read.schema("key string").json(f"{self.folder}/key").first()["key"]
        terms = "field string, term string"
        return T.StructType.fromDDL(
            {
                "terms": f"{terms}, df long, levels array<struct<level:int,n:long,max_tf:int,min_n:int>>, segment int, write string, bucket int",
                "postings": f"{terms}, level int, key {kind}, tf int, n int, at array<int>, segment int, write string, bucket int",
                "rows": f"key {kind}, stamp string, {', '.join(f'n_{i} int' for i in range(len(self.fields)))}, terms array<struct<field:string,term:string{',at:array<int>' if places else ''}>>, segment int, write string",
                "dead": f"key {kind}, segment int, write string",
            }[part]
        )

    def _read(self, part: str, segments: list[dict], places: bool = False) -> DataFrame:
        schema = self._schema(part, places)
        paths = [f"{self.folder}/{part}/{s['name']}" for s in segments if part in s["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{part}").parquet(*paths)

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows with key and segment, without those that a later segment replaces or removes."""
        dead = self._few(self._read("dead", segments).select("key", F.col("segment").alias("_by")))
        return rows.join(dead, (rows["key"] == dead["key"]) & (F.col("_by") > F.col("segment")), "left_anti")

    def _few(self, keys: DataFrame) -> DataFrame:
        """Stored keys, to be broadcast while there are few."""
        return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys

    # --- updates

    def upsert(self, rows: DataFrame, stamp: Column) -> None:
        """Index rows that are new or whose texts have changed."""
        taken = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), stamp.cast("string").alias("stamp"), *(F.col(f).alias(f"f_{i}") for i, f in enumerate(self.fields)))
        # texts are shuffled only where several rows have one key
        many = self._scratch(taken.groupBy("key").count().where("count > 1").select("key"))
        keys = self.spark.read.schema(T.StructType([taken.schema["key"]])).parquet(many)
        if not keys.isEmpty():
            rest, keys = F.struct("stamp", *(f"f_{i}" for i in range(len(self.fields)))), self._few(keys)
            best = taken.join(keys, "key", "left_semi").groupBy("key").agg(F.max_by(rest, F.coalesce("stamp", F.lit(""))).alias("r")).select("key", "r.*")
            taken = taken.join(keys, "key", "left_anti").unionByName(best)
        self._write(taken, None)
        store.remove(self.spark, many)

    def remove(self, keys: DataFrame) -> None:
        """Remove the rows with these keys; unknown ones change nothing."""
        self._write(None, keys.select(F.col(self.key).alias("key")).distinct())

    def refresh(self, rows: DataFrame, stamp: Column) -> None:
        """Bring the index up to date with a whole table: rows with another stamp than the index has are taken, absent ones removed."""
        stamped = rows.withColumn("_stamp", stamp.cast("string"))
        stored = self.entries().select(F.col("key").alias("_key"), F.col("stamp").alias("_old"))
        known = F.col(self.key) == F.col("_key")
        changed = stamped.join(stored, known & F.col("_stamp").eqNullSafe(F.col("_old")), "left_anti")
        gone = stored.join(rows.select(self.key), known, "left_anti").select(F.col("_key").alias(self.key))
        if self.version():
            path = self._scratch(gone)
            self.upsert(changed, F.col("_stamp"))
            self.remove(self.spark.read.schema(gone.schema).parquet(path))
            store.remove(self.spark, path)
        else:
            self.upsert(changed, F.col("_stamp"))

    def entries(self) -> DataFrame:
        """key and stamp of every live row."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], "key string, stamp string")
        return self._live(self._read("rows", segments).select("key", "stamp", "segment"), segments).select("key", "stamp")

    def _scratch(self, df: DataFrame) -> str:
        path = store.new_path(self.spark, "index-step")
        df.write.parquet(path)
        return path

    def _write(self, rows: DataFrame | None, gone: DataFrame | None) -> None:
        version, segments = self.version(), self.segments()
        if rows is not None and not version:
            self.spark.createDataFrame([(rows.schema["key"].dataType.simpleString(),)], "key string").coalesce(1).write.mode("ignore").json(f"{self.folder}/key")
        if not segments and rows is None:
            return
        number, own = max((s["segment"] for s in segments), default=0) + 1, uuid.uuid4().hex
        segment = {"segment": number, "name": f"segment={number}/write={own}", "parts": ["terms"], "n_rows": 0, "sums": [0] * len(self.fields)}
        found = terms = None
        if rows is not None:
            self._analysed(rows).write.parquet(f"{self.folder}/rows/{segment['name']}")
            segment["parts"].append("rows")
            gone = self._read("rows", [segment]).select("key")
        used = []
        if segments:
            # the live rows that this segment replaces: their terms are counted down
            stored = self._read("rows", segments)
            used.append(self._scratch(self._live(stored.select("key", "segment").join(gone, "key", "left_semi"), segments)))
            keys = self.spark.read.schema(T.StructType([stored.schema["key"], stored.schema["segment"]])).parquet(used[0])
            if not keys.isEmpty():
                used.append(self._scratch(stored.join(self._few(keys), ["key", "segment"], "left_semi").select(stored.columns)))
                old = self.spark.read.schema(stored.schema).parquet(used[1])
                self._add(segment, *self._counted(old, -1))
                terms = old.select(F.explode("terms").alias("t")).select("t.field", "t.term", F.lit(-1).alias("one"))
                old.select("key").repartition(self._shares(-segment["n_rows"])).write.parquet(f"{self.folder}/dead/{segment['name']}")
                segment["parts"].append("dead")
        if rows is not None:
            found = self._post(segment)
        if found is not None or terms is not None:
            self._write_terms(found, terms, segment["name"])
            self._publish(version + 1, [*segments, segment])
        for path in used:
            store.remove(self.spark, path)

    def _add(self, segment: dict, n: int, sums: list[int]) -> None:
        segment["n_rows"] += n
        segment["sums"] = [a + b for a, b in zip(segment["sums"], sums, strict=True)]

    def _shares(self, n: int) -> int:
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000 + 1))

    def _analysed(self, rows: DataFrame) -> DataFrame:
        """key, stamp, n_<field> and terms: the distinct words of each field with their places, found within a batch of rows, without a shuffle."""
        fields, n = self.fields, len(self.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BATCH_ROWS):
                    b = batch.slice(low, BATCH_ROWS)
                    found = [_runs(b.column(2 + i)) for i in range(n)]
                    row = np.concatenate([f[0] for f in found])
                    order = pa.array(np.argsort(row, kind="stable"))
                    field = pa.array(fields).take(pa.array(np.repeat(np.arange(n), [len(f[0]) for f in found])))
                    runs = [field, *(pa.concat_arrays([f[i] for f in found]) for i in (1, 2))]
                    terms = pa.StructArray.from_arrays([x.take(order) for x in runs], ["field", "term", "at"])
                    edges = pa.array(np.append(0, np.bincount(row, minlength=b.num_rows).cumsum()), pa.int32())
                    lengths = [pc.list_value_length(b.column(2 + i)).cast(pa.int32()) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lengths, pa.ListArray.from_arrays(edges, terms)], ["key", "stamp", *(f"n_{i}" for i in range(n)), "terms"])

        whole = [x for x in self._schema("rows", places=True).fields if x.name not in ("segment", "write")]
        return rows.select("key", "stamp", *(search.tokens(F.col(f"f_{i}")) for i in range(n))).mapInArrow(run, T.StructType(whole))

    def _counted(self, rows: DataFrame, sign: int) -> tuple[int, list[int]]:
        row = rows.agg(F.count("*").alias("n"), *(F.sum(f"n_{i}").alias(f"s_{i}") for i in range(len(self.fields)))).first()  # one row
        return sign * row["n"], [sign * (row[f"s_{i}"] or 0) for i in range(len(self.fields))]

    def _post(self, segment: dict) -> DataFrame:
        """Write the postings of a segment's stored rows, dealt out by bucket, and those of one bucket by key in slices; its rows and lengths are counted in."""
        rows = self._read("rows", [segment], places=True)
        n, sums = self._counted(rows, 1)
        self._add(segment, n, sums)
        segment["parts"].append("postings")
        rows = rows.select("key", *(f"n_{i}" for i in range(len(self.fields))), F.explode("terms").alias("t"))
        length = F.coalesce(*(F.when(F.col("t.field") == f, F.col(f"n_{i}")) for i, f in enumerate(self.fields)))
        words = rows.select("key", "t.field", "t.term", "t.at", length.alias("n"))
        bucket, slice_ = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"), F.pmod(F.xxhash64("key"), F.lit(n // SLICE_ROWS + 1)).cast("int")
        tf, avg = F.size("at"), F.coalesce(*(F.when(F.col("field") == f, F.lit((sums[i] / n if n else 0.0) or 1.0)) for i, f in enumerate(self.fields)))
        impact = tf / (tf + search.K1 * (1 - search.B + search.B * F.col("n") / avg))
        level = F.least(F.floor(impact * LEVELS), F.lit(LEVELS - 1)).cast("int")
        found = words.repartition(bucket, slice_).select("field", "term", level.alias("level"), "key", tf.alias("tf"), "n", "at", bucket.alias("bucket"))
        found.sortWithinPartitions("bucket", "term", "field", F.desc("level"), "key").write.partitionBy("bucket").parquet(f"{self.folder}/postings/{segment['name']}")
        return self._read("postings", [segment])

    def _write_terms(self, found: DataFrame | None, gone: DataFrame | None, name: str) -> None:
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        rows = []
        if found is not None:
            # postings lie in the order of their terms, so those of a batch are summed before the only shuffle
            summed = found.select("bucket", "field", "term", "level", "tf", "n").mapInArrow(_summed, "bucket int, field string, term string, level int, n long, max_tf int, min_n int")
            levels = summed.repartition("bucket").groupBy("bucket", "field", "term", "level").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_n").alias("min_n"))
            rows.append(levels.groupBy("bucket", "field", "term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("level", "n", "max_tf", "min_n")).alias("levels")))
        if gone is not None:
            empty = F.array().cast("array<struct<level:int,n:bigint,max_tf:int,min_n:int>>")
            rows.append(gone.groupBy("field", "term").agg(F.sum("one").cast("long").alias("df"), empty.alias("levels")).withColumn("bucket", bucket).repartition("bucket"))
        for part in rows:
            dealt = part.select("field", "term", "df", "levels", "bucket").sortWithinPartitions("bucket", "term", "field")
            dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/terms/{name}")

    def compact(self, keep: int = 0) -> None:
        """Join all segments after the first `keep` into one, without what is dead; texts aren't read again."""
        version, segments = self.version(), self.segments()
        before, joined = segments[:keep], segments[keep:]
        if len(joined) < 2:
            return
        number, own = max(s["segment"] for s in segments), uuid.uuid4().hex
        segment = {"segment": number, "name": f"segment={number}/write={own}", "parts": ["terms", "rows"], "n_rows": 0, "sums": [0] * len(self.fields)}
        self._live(self._read("rows", joined, places=True), joined).drop("segment", "write").write.parquet(f"{self.folder}/rows/{segment['name']}")
        found = self._post(segment)
        gone = None
        if before:  # what the joined segments replace or remove of those before is still dead there
            self._read("dead", joined).select("key").distinct().write.parquet(f"{self.folder}/dead/{segment['name']}")
            segment["parts"].append("dead")
            counted = self._read("terms", joined).groupBy("field", "term").agg(F.sum("df").alias("df"))
            own_df = found.groupBy("field", "term").agg(F.count("*").alias("own"))
            less = counted.join(own_df, ["field", "term"], "left").select("field", "term", (F.col("df") - F.coalesce("own", F.lit(0))).alias("one"))
            gone = less.where("one <> 0")
        self._write_terms(found, gone, segment["name"])
        # with what they replace or remove of the segments before
        segment |= {"n_rows": sum(s["n_rows"] for s in joined), "sums": [sum(s["sums"][i] for s in joined) for i in range(len(self.fields))]}
        self._publish(version + 1, [*before, segment])

    def vacuum(self) -> None:
        """Delete the files of segments and versions that the newest version doesn't name; no reader of an older one may be left."""
        version, live = self.version(), {s["name"] for s in self.segments()}
        for part in ("terms", "postings", "rows", "dead"):
            for segment in store.children(self.spark, f"{self.folder}/{part}"):
                for own in store.children(self.spark, f"{self.folder}/{part}/{segment}"):
                    if f"{segment}/{own}" not in live:
                        store.remove(self.spark, f"{self.folder}/{part}/{segment}/{own}")
        for old in store.children(self.spark, f"{self.folder}/manifest"):
            if old.isdigit() and int(old) < version:
                store.remove(self.spark, f"{self.folder}/manifest/{old}")

    # --- queries

    def dictionary(self) -> DataFrame:
        """(field, term, df) of every term that a live row has."""
        return self._read("terms", self.segments()).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def query(self, text: str, k: int = 20, boosts: dict[str, float] | None = None, where: DataFrame | None = None) -> DataFrame:
        """The k best rows: key and score, ties by key; with `where` only rows with one of its keys."""
        boosts = boosts or {f: search.BOOSTS.get(f, 1.0) for f in self.fields}
        q, segments, k = search.parse(text, list(boosts)), self.segments(), max(k, 1)
        if not segments:
            raise EngineError("index/missing", self.folder)
        used = search.used(q, boosts)
        words = sorted({w for c in q.clauses for w in c.words})
        asked = self.spark.createDataFrame([(w,) for w in words], "term string")
        buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        own = F.col("bucket").isin(buckets) & F.col("term").isin(words) & F.col("field").isin(list(boosts))
        # at most sixteen numbers for each word, field and segment
        known = self._read("terms", segments).where(own).select("segment", "field", "term", "df", "levels").collect()
        df: dict[tuple[str, str], int] = defaultdict(int)
        for r in known:
            df[r.field, r.term] += r.df
        n_rows = sum(s["n_rows"] for s in segments)
        avg = {f: sum(s["sums"][i] for s in segments) / n_rows if n_rows else 0.0 for i, f in enumerate(self.fields)}
        postings = self._read("postings", segments).where(own)
        simple = where is None and all(len(c.words) == 1 and c.sign != "-" for c in q.clauses)
        if simple and n_rows:
            wanted = self._wanted(known, used, boosts, df, n_rows, avg, k, postings, segments, q)
            postings = postings.where(wanted)
        rows = self._rows(postings, segments, words, boosts, used, where)
        stats = self._stats(rows, used, df, n_rows, avg, boosts)
        return search.best(rows, stats, q, used, boosts, ["key"], "key", k).withColumnRenamed("key", self.key)

    def _rows(self, postings: DataFrame, segments: list[dict], words: list[str], boosts: dict[str, float], used: list, where: DataFrame | None) -> DataFrame:
        """A row for each key of the postings, with lengths and counts of the query's clauses."""
        live = self._live(postings, segments)
        if where is not None:
            live = live.join(where.select(F.col(self.key).alias("key")), "key", "left_semi")
        placed = {w for _, _, c in used if len(c.words) > 1 for w in c.words}
        this = {(f, w): (F.col("field") == f) & (F.col("term") == w) for f in boosts for w in words}
        found = live.groupBy("key").agg(
            *(F.max(F.when(F.col("field") == f, F.col("n"))).alias(f"l_{f}") for f in boosts),
            *(F.max(F.when(this[f, w], F.col("tf"))).alias(f"tf_{f}_{n}") for f in boosts for n, w in enumerate(words)),
            *(F.max(F.when(this[f, w], F.col("at"))).alias(f"at_{f}_{n}") for f in boosts for n, w in enumerate(words) if w in placed),
        )

        def count(clause: search.Clause, f: str) -> Column:
            if len(clause.words) == 1:
                return F.coalesce(F.col(f"tf_{f}_{words.index(clause.words[0])}"), F.lit(0))
            first, *rest = (F.coalesce(F.col(f"at_{f}_{words.index(w)}"), F.array().cast("array<int>")) for w in clause.words)
            for n, other in enumerate(rest, 1):
                first = F.array_intersect(first, _less(other, n))
            return F.size(first)

        return found.select("key", *(F.coalesce(f"l_{f}", F.lit(0)).alias(f"_n_{f}") for f in boosts), *(count(c, f).alias(f"_tf_{i}_{f}") for i, f, c in used))

    def _stats(self, rows: DataFrame, used: list, df: dict, n_rows: int, avg: dict, boosts: dict[str, float]) -> DataFrame:
        """One row of statistics; a phrase's rows are counted among those that hold its words."""
        fixed = [F.lit(n_rows).alias("_rows"), *(F.lit(avg[f] or 1.0).alias(f"_avg_{f}") for f in boosts)]
        single = [F.lit(df[f, c.words[0]]).alias(f"_df_{i}_{f}") for i, f, c in used if len(c.words) == 1]
        phrases = [F.count_if(F.col(f"_tf_{i}_{f}") > 0).alias(f"_df_{i}_{f}") for i, f, c in used if len(c.words) > 1]
        base = rows.agg(*phrases) if phrases else self.spark.range(1)
        return base.select("*", *fixed, *single).drop("id")

    def _wanted(self, known: list, used: list, boosts: dict, df: dict, n_rows: int, avg: dict, k: int, postings: DataFrame, segments: list[dict], q: search.Query) -> Column:
        """Which levels of the words' postings can hold one of the k best rows."""
        times: dict[tuple[str, str], float] = defaultdict(float)
        for _, f, c in used:
            times[f, c.words[0]] += boosts[f]

        def bound(f: str, w: str, level) -> float:
            n = max(df[f, w], 0)
            # as F.ln(1 + ...) of the score, and for the shortest row with the largest count of the level
            idf = math.log(1 + (n_rows - n + 0.5) / (n + 0.5))
            return times[f, w] * idf * level.max_tf * (search.K1 + 1) / (level.max_tf + search.K1 * (1 - search.B + search.B * level.min_n / (avg[f] or 1.0)))

        bounds = {(r.segment, r.field, r.term, x.level): (bound(r.field, r.term, x), x.n) for r in known for x in r.levels if times[r.field, r.term]}
        most: dict[tuple[str, str], float] = defaultdict(float)
        for (_, f, w, _), (b, _) in bounds.items():
            most[f, w] = max(most[f, w], b)
        # the best levels of each word that hold some 4 k postings, as a few may be dead
        first = []
        for f, w in most:
            got = 0
            for _, key in sorted(((-b, key) for key, (b, _) in bounds.items() if key[1:3] == (f, w)), key=lambda x: (x[0], str(x[1]))):
                if got >= 4 * k:
                    break
                first.append(key)
                got += bounds[key][1]
        if len(first) == len(bounds):
            return F.lit(True)
        rows = self._rows(postings.where(_among(first)), segments, sorted({w for _, w in times}), boosts, used, None)
        stats = self._stats(rows, used, df, n_rows, avg, boosts)
        reached = search.best(rows, stats, q, used, boosts, ["key"], "key", k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()  # one row
        least = reached["score"] * (1 - 1e-9) if reached["n"] >= k else 0.0
        return _among([key for key, (b, _) in bounds.items() if b + sum(x for other, x in most.items() if other != key[1:3]) >= least])


def _runs(words: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """Row, term and places of each distinct word of each row."""
    lengths = pc.list_value_length(words).to_numpy()
    row, coded = np.repeat(np.arange(len(words)), lengths), words.flatten().dictionary_encode()
    at = np.arange(len(row)) - np.repeat(lengths.cumsum() - lengths, lengths)
    code = coded.indices.to_numpy()
    both = row * max(1, len(coded.dictionary)) + code
    order = np.argsort(both, kind="stable")
    low = np.flatnonzero(np.diff(both[order], prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(low, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
    return row[order[low]], coded.dictionary.take(pa.array(code[order[low]])), places


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, largest count and smallest length of the postings of each term and level of a batch."""
    for b in batches:
        keys = ["bucket", "field", "term", "level"]
        got = pa.Table.from_batches([b]).group_by(keys, use_threads=False).aggregate([("tf", "count"), ("tf", "max"), ("n", "min")])
        got = got.select([*keys, "tf_count", "tf_max", "n_min"]).rename_columns([*keys, "n", "max_tf", "min_n"])
        yield from got.combine_chunks().to_batches()


def _less(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _among(keys: list[tuple[int, str, str, int]]) -> Column:
    """A condition that Parquet can apply to whole groups of rows: for each segment, field and term its levels."""
    levels: dict[tuple[int, str, str], list[int]] = defaultdict(list)
    for segment, f, w, level in keys:
        levels[segment, f, w].append(level)
    out = F.lit(False)
    for (segment, f, w), own in levels.items():
        out = out | ((F.col("segment") == segment) & (F.col("field") == f) & (F.col("term") == w) & F.col("level").isin(own))
    return out
