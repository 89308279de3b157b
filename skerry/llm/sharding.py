"""Operator 5: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get gapless numbers 0..n-1 in the order of doc_id (nulls first, then checksum and size): key ranges are sorted in
parallel and each range starts at the prefix sum of the ranges before it. A Feistel network over the pairs (x mod a,
x div a), with a * b >= n just above n, permutes the numbers; a result of n or more walks on along its cycle until it is
below n, at most a * b - n steps, which about one row in sqrt(n) takes. From the permuted number p, shard = p mod shards
and slot = p div shards, so both can be computed from a row number alone, and shards' row counts differ by one at most.
Equal texts are rows like others and may be in different shards.

Only built-in expressions are used. Defined results: a null text has size 16 and checksum 0; a null doc_id sorts first;
equal rows take neighbouring numbers in any order; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import materialize, small_lookup, table

ROUNDS = 8
PRIME = 2**31 - 1


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0..n-1; the same expressions for Spark, for SQL and for numbers."""

    n: int
    seed: int = 0

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(0, self.n - 1)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        draw = random.Random(self.seed)
        return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]

    def number(self, x: int) -> int:
        """The permuted number of x, for readers that look up one row."""
        while True:
            left, right = x % self.a, x // self.a
            for r, (k1, k2, k3) in enumerate(self.keys):
                v = right if r % 2 == 0 else left
                t = (v % PRIME * k1 + k2) % PRIME
                t = (t * t + k3) % PRIME
                if r % 2 == 0:
                    left = (left + t) % self.a
                else:
                    right = (right + t) % self.b
            x = left + self.a * right
            if x < self.n:
                return x

    def _step(self, x: Column) -> Column:
        a, b, prime = (F.lit(v).cast("long") for v in (self.a, self.b, PRIME))
        rounds = F.array(*(F.struct(F.lit(r % 2 == 0).alias("left"), *(F.lit(k).cast("long").alias(f"k{i}") for i, k in enumerate(ks, 1))) for r, ks in enumerate(self.keys)))

        def mixed(v: Column, k: Column) -> Column:
            t = (v % prime * k["k1"] + k["k2"]) % prime
            return F.transform(F.array(t), lambda u: (u * u + k["k3"]) % prime)[0]

        def one(s: Column, k: Column) -> Column:
            return F.when(k["left"], F.struct(((s["l"] + mixed(s["r"], k)) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], k)) % b).alias("r")))

        start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))  # exact below 2**53
        return F.aggregate(rounds, start, one, lambda s: s["l"] + s["r"] * a)

    def column(self, x: Column) -> Column:
        """The permuted number as an expression."""
        n, outside = F.lit(self.n).cast("long"), self.a * self.b - self.n
        if not outside:
            return self._step(x)

        def walked(p: Column) -> Column:
            return F.when(p < n, p).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(outside)), p, lambda q, _: F.when(q < n, q).otherwise(self._step(q))))

        return F.transform(F.array(self._step(x)), walked)[0]


def row_numbers(rows: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """rows with gapless numbers from 0 in the given order: ranges sorted in parallel, and prefix sums over the ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(ranged, "ranged").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(2**33 - 1))})
    # as many rows as there are ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return small_lookup(stored, bases, ["_part"]).withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered = row_numbers(rows, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    n = numbered.count()
    p = Feistel(n, seed).column(F.col("row"))
    out = numbered.withColumn("_p", p)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def oracle(shards: int = 40, seed: int = 0) -> str:
    """The same in SQL: row_number, one subquery a round, and a recursive walk."""
    keys = Feistel(1, seed).keys
    step = "SELECT row, x % a AS l, x // a AS r, n, a, b FROM {source}"
    for r, (k1, k2, k3) in enumerate(keys):
        v = "r" if r % 2 == 0 else "l"
        step = f"SELECT *, (({v} % {PRIME}) * {k1} + {k2}) % {PRIME} AS t FROM ({step})"
        step = f"SELECT row, {'(l + (t * t + %d) %% %d) %% a AS l, r' % (k3, PRIME) if v == 'r' else 'l, (r + (t * t + %d) %% %d) %% b AS r' % (k3, PRIME)}, n, a, b FROM ({step})"
    step = f"SELECT row, l + r * a AS x, n, a, b FROM ({step})"
    return f"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY v) AS crc_table FROM (
  SELECT v, list_reduce(list_concat([v], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS v))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
checked AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
    lambda c, byte: xor(c >> 8, crc_table[CAST(xor(c & 255, byte) + 1 AS INT)])), 4294967295) AS text_crc32 FROM sized, bits),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row FROM checked),
total AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)),
begun AS (SELECT row, row AS x, n, a, b FROM numbered, total),
walk AS ({step.format(source="begun")} UNION ALL ({step.format(source="(SELECT * FROM walk WHERE x >= n)")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INT) AS shard, x // {shards} AS slot, CAST(NULL AS INT) AS grown_shard, row
FROM walk JOIN numbered USING (row) WHERE x < n"""
