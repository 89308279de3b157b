"""Operator 3: quality rules, with robust multivariate outliers by minimum covariance determinant.

Words are runs without ASCII white space. Base rules reject a text of fewer than 10 words, or one where words in repeated
5-word windows are over 20 % of all. Of the texts that pass, a vector of four transformed statistics is tested against
its pool: log words, log mean word length, log symbols per 1000 word characters, log of repeated words and lines per 100.

Each pool, a language and source, has a robust centre and scatter. From three starts (medians with median deviations, mean
with covariance, medians with the correlations of squashed values) concentration steps take the three quarters of the
pool's rows that are nearest by Mahalanobis distance and compute their mean and covariance again, until no determinant
falls any more; of the starts the least determinant stays. Rows in the last bin of distances that belongs to the three
quarters in part all count in that part, so the weights always add up to it. The scatter is made consistent for normal
data. Then a pool of n rows is drawn to the estimate of its language, made alike, as if that had `prior` rows, and the
language to all rows: a pool of any size has an estimate, which is all but its own once it has many rows. Vectors beyond a
high quantile of chi-squared go.

Vectors are whole numbers (thousandths), so sums of squares are exact and don't depend on how rows are dealt out; medians
are over such numbers, and distances are ordered in bins of 0.05 %, of which there are a bounded number however many rows a
pool has. A floor on each variance keeps statistics that are constant in a pool from rejecting what differs by a trifle.

Only built-in expressions are used; the text is read once, and each step is one aggregation of a stored table of a few
numbers a row, with map-side combining.
Defined results: a null text has no words and fails the base rules; null language and source form a pool like others, with
empty ones; repeated rows count each; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import let, materialize, small_lookup, table

DIMS = 4
SCALE = 1000


@dataclass(frozen=True)
class Settings:
    share: float = 0.75
    #: Rows for which an estimate one level up counts.
    prior: int = 50
    #: Concentration steps end when no logarithm of a determinant falls by more than this, or after so many.
    least: float = 1e-4
    steps: int = 40
    #: Share of normal data beyond the cutoff; tiny, as the statistics' tails are heavier than normal ones.
    tail: float = 1e-20
    #: Least standard deviation of each statistic, in thousandths.
    floors: tuple[int, ...] = (400, 60, 300, 500)


def chi2_tail(x: float, dof: int) -> float:
    """Share beyond x, for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_bound(tail: float, dof: int) -> float:
    """The x that has this share beyond it."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return high


def _repeat_words(hashes: Column, size: int = 5) -> Column:
    """Words that lie in windows whose hash occurs twice or more; hashes has one for each window, in order."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, i: (e["h"] == F.get(pairs, i - 1)["h"]) | (e["h"] == F.get(pairs, i + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(places, zero, lambda s, p: F.struct((p + size).alias("end"), (s["total"] + p + size - F.greatest(p, s["end"])).alias("total")), lambda s: s["total"])

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return let(hashes, counted)


def _windows(words: Column) -> Column:
    """xxhash64 of every five neighbouring words."""

    def of(h: Column) -> Column:
        return F.when(F.size(h) < 5, F.array().cast("array<long>")).otherwise(
            F.transform(F.slice(h, F.lit(1), F.size(h) - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed and the vector x1..x4 of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("_text"), words.alias("_words"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(_windows(F.col("_words"))).cast("long").alias("n_repeat_words"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    vector = [F.ln(n), F.ln(chars / n), F.ln(1 + 1000 * F.col("n_symbols") / chars), F.ln(1 + 100 * (F.col("n_repeat_words") + 10 * F.col("n_dup_lines")) / n)]
    return rows.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.floor(SCALE * v + 0.5).cast("long")) for i, v in enumerate(vector, 1)})


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """(name, expression) of the lower triangle, row by row; each refers to the names before it."""
    out = []
    for i in range(1, DIMS + 1):
        for j in range(1, i + 1):
            left = cov[i, j]
            for k in range(1, j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out.append((f"l{i}{j}", F.sqrt(left) if i == j else left / F.col(f"l{j}{j}")))
    return out


def distance(mean: str = "m") -> Column:
    """Squared Mahalanobis distance of x1..x4 to the estimate in m1..m4 and l11..l44, by forward substitution."""
    ys: list[Column] = []
    for i in range(1, DIMS + 1):
        left = F.col(f"x{i}") - F.col(f"{mean}{i}")
        for k, y in enumerate(ys, 1):
            left = left - F.col(f"l{i}{k}") * y
        ys.append(left / F.col(f"l{i}{i}"))
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


#: Distances as whole numbers of a bounded range.
def _binned(d: Column) -> Column:
    return F.floor(2000 * F.ln(1 + d)).cast("long")


KEY = ["level", "lang", "source"]
X = range(1, DIMS + 1)
PAIRS = [(i, j) for i in X for j in range(1, i + 1)]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row in the pool of all rows, in that of its language and in that of its language and source."""
    none = F.lit("")
    levels = F.array(*(F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in ((0, none, none), (1, F.col("lang"), none), (2, F.col("lang"), F.col("source")))))
    return rows.select(F.explode(levels).alias("_k"), *(f"x{i}" for i in X)).select("_k.*", *(f"x{i}" for i in X))


def _factored(rows: DataFrame) -> DataFrame:
    """rows with c11..c44 and, of that matrix, the Cholesky factor l11..l44 and the logarithm of the determinant."""
    for name, value in _cholesky({(i, j): F.col(f"c{i}{j}") for i, j in PAIRS}):
        rows = rows.withColumn(name, value)
    logdet = 2 * F.ln(F.col("l11"))
    for i in X[1:]:
        logdet = logdet + 2 * F.ln(F.col(f"l{i}{i}"))
    return rows.withColumn("logdet", logdet)


def _estimate(rows: DataFrame, keys: list[str], s: Settings, factor: float) -> DataFrame:
    """keys, m1..m4, c11..c44, l11..l44 and logdet from the sums w, s1..s4 and s11..s44."""
    rows = rows.withColumns({f"m{i}": F.col(f"s{i}") / F.col("w") for i in X})
    cov = {f"c{i}{j}": factor * (F.col(f"s{i}{j}") / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}")) + (float(s.floors[i - 1] ** 2) if i == j else 0.0) for i, j in PAIRS}
    return _factored(rows.withColumns(cov)).select(*keys, *(f"m{i}" for i in X), *cov, *(f"l{i}{j}" for i, j in PAIRS), "logdet")


def _sums(values: list[Column]) -> list[Column]:
    return [*(F.sum(v).alias(f"s{i}") for i, v in enumerate(values, 1)), *(F.sum(values[i - 1] * values[j - 1]).alias(f"s{i}{j}") for i, j in PAIRS)]


def _starts(rows: DataFrame, s: Settings) -> DataFrame:
    """Three estimates of each pool, start 0 to 2, and its number n of rows."""
    x = [F.col(f"x{i}") for i in X]
    medians = materialize(rows.groupBy(KEY).agg(F.count("*").alias("n"), *(F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in X)), "medians")
    spread = small_lookup(rows, medians, KEY, "inner").groupBy(*KEY, "n", *(f"m{i}" for i in X)).agg(*(F.expr(f"percentile(abs(x{i} - m{i}), 0.5)").alias(f"d{i}") for i in X))
    scaled = {f"d{i}": F.greatest(1.4826 * F.col(f"d{i}"), F.lit(float(s.floors[i - 1]))) for i in X}
    spread = materialize(spread.withColumns(scaled), "spread")
    middle = [*KEY, "n", *(f"m{i}" for i in X)]
    plain = _factored(spread.withColumns({f"c{i}{j}": F.col(f"d{i}") ** 2 if i == j else F.lit(0.0) for i, j in PAIRS})).withColumn("start", F.lit(0))
    whole = _estimate(rows.groupBy(KEY).agg(F.count("*").alias("n"), F.count("*").cast("double").alias("w"), *_sums(x)), [*KEY, "n"], s, 1.0).withColumn("start", F.lit(1))
    squashed = small_lookup(rows, spread, KEY, "inner").select(*middle, *(f"d{i}" for i in X), *(F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"y{i}") for i in X))
    sums = squashed.groupBy(*middle, *(f"d{i}" for i in X)).agg(*_sums([F.col(f"y{i}") for i in X]))
    # a tenth of the identity keeps the correlations of few rows regular
    spare = {(i, j): F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2 + (0.1 if i == j else 0.0) for i, j in PAIRS}
    tanh = _factored(sums.withColumns({f"c{i}{j}": F.col(f"d{i}") * F.col(f"d{j}") * spare[i, j] / F.sqrt(spare[i, i] * spare[j, j]) for i, j in PAIRS})).withColumn("start", F.lit(2))
    names = [*KEY, "start", "n", *(f"m{i}" for i in X), *(f"c{i}{j}" for i, j in PAIRS), *(f"l{i}{j}" for i, j in PAIRS), "logdet"]
    return plain.select(names).union(whole.select(names)).union(tanh.select(names))


def _concentrated(rows: DataFrame, now: DataFrame, s: Settings, factor: float) -> DataFrame:
    """One concentration step of every start."""
    keys = [*KEY, "start", "n"]
    near = small_lookup(rows, now.select(*keys, *(f"m{i}" for i in X), *(f"l{i}{j}" for i, j in PAIRS)), KEY, "inner").withColumn("_q", _binned(distance()))
    bins = near.groupBy(*keys, "_q").agg(F.count("*").alias("c"), *_sums([F.col(f"x{i}") for i in X]))
    # over the bins of one pool
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.lit(1.0), (F.ceil(s.share * F.col("n")) - before) / F.col("c"))
    names = [f"s{i}" for i in X] + [f"s{i}{j}" for i, j in PAIRS]
    full = F.col("w") == 1.0

    def weighted(c: str) -> Column:
        # whole bins add up exactly, and one bin at most counts in part
        return F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0)) + F.coalesce(F.sum(F.when(~full, F.col("w") * F.col(c))), F.lit(0.0))

    taken = bins.withColumn("w", part).where("w > 0").groupBy(*keys)
    sums = taken.agg(F.ceil(s.share * F.max("n")).cast("double").alias("w"), *(weighted(c).alias(c) for c in names))
    return _estimate(sums, keys, s, factor)


def estimates(rows: DataFrame, s: Settings) -> DataFrame:
    """n, m1..m4, c11..c44 and l11..l44 of each pool of every level, by the best of the starts; not yet drawn to others."""
    rows = _levels(rows)
    factor = s.share / (1 - chi2_tail(chi2_bound(1 - s.share, DIMS), DIMS + 2))
    now = materialize(_starts(rows, s), "starts")
    for k in range(s.steps):
        new = materialize(_concentrated(rows, now, s, factor), "estimates")
        falls = now.select(*KEY, "start", F.col("logdet").alias("_old")).join(new, [*KEY, "start"]).where(F.col("_old") - F.col("logdet") > s.least)
        # a start isn't yet the estimate of three quarters of the rows
        done = k and falls.isEmpty()
        now = new
        if done:
            break
    rest = [c for c in now.columns if c not in KEY]
    return materialize(now.groupBy(KEY).agg(F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("_b")).select(*KEY, "_b.*"), "best")


def drawn(found: DataFrame, s: Settings) -> DataFrame:
    """(lang, source) and the estimate of each pool, drawn to that of its language, and that to the one of all rows."""
    values = [f"m{i}" for i in X] + [f"c{i}{j}" for i, j in PAIRS]

    def joined(own: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        up = above.select(*on, *(F.col(v).alias(f"_{v}") for v in values))
        both = small_lookup(own, up, on) if on else own.crossJoin(F.broadcast(up))  # one row
        return both.withColumns({v: (F.col("n") * F.col(v) + s.prior * F.col(f"_{v}")) / (F.col("n") + s.prior) for v in values}).drop(*(f"_{v}" for v in values))

    level = [found.where(F.col("level") == k).drop("level") for k in range(3)]
    langs = materialize(joined(level[1].drop("source"), level[0].drop("lang", "source"), []), "languages")
    return materialize(_factored(joined(level[2], langs, ["lang"])).select("lang", "source", *(f"m{i}" for i in X), *(f"l{i}{j}" for i, j in PAIRS)), "pools")


def judge(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance (squared Mahalanobis; null where it isn't tested) of every row."""
    s = settings or Settings()
    rows = materialize(statistics(docs), "statistics")
    found = drawn(estimates(rows.where(~F.col("base_failed")).select("lang", "source", *(f"x{i}" for i in X)), s), s)
    out = small_lookup(rows, found, ["lang", "source"]).withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_bound(s.tail, DIMS))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance", 3).alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
