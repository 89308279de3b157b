"""Calendar functions as column expressions: personal-year periods, seasons, the wheel of the year and phases of the moon.

Seasons and phases use published truncated series (Meeus, Astronomical Algorithms, chapters 27, 48 and 49): good to about
a minute for seasons and a few minutes for phases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = 365.25 / 7
SYNODIC = 29.530588861
# Rulers of the seven periods; names of the eight points and of the eight phases.
PLANETS = ["Sun", "Moon", "Mars", "Mercury", "Jupiter", "Venus", "Saturn"]
WHEEL = ["Imbolc", "SpringEquinox", "Beltane", "SummerSolstice", "Lughnasadh", "AutumnEquinox", "Samhain", "WinterSolstice"]
PHASES = ["New", "WaxingCrescent", "FirstQuarter", "WaxingGibbous", "Full", "WaningGibbous", "LastQuarter", "WaningCrescent"]
EVENTS = ["MarchEquinox", "JuneSolstice", "SeptemberEquinox", "DecemberSolstice"]
# Mean instants in powers of (year - 2000) / 1000, and the periodic terms A, B, C of A cos(B + C T).
SEASONS = [
    [2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057],
    [2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030],
    [2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078],
    [2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032],
]
TERMS = [
    (485, 324.96, 1934.136), (203, 337.23, 32964.467), (199, 342.08, 20.186), (182, 27.85, 445267.112), (156, 73.14, 45036.886), (136, 171.52, 22518.443),
    (77, 222.54, 65928.934), (74, 296.72, 3034.906), (70, 243.58, 9037.513), (58, 119.81, 33718.147), (52, 297.17, 150.678), (50, 21.02, 2281.226),
    (45, 247.54, 29929.562), (44, 325.15, 31555.956), (29, 60.93, 4443.417), (18, 155.12, 67555.328), (17, 288.79, 4562.452), (16, 198.04, 62894.029),
    (14, 199.76, 31436.921), (12, 95.39, 14577.848), (12, 287.11, 31931.756), (12, 320.81, 34777.259), (9, 227.73, 1222.114), (8, 15.45, 16859.074),
]


def _cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def _sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def delta_t(year: Column) -> Column:
    """Dynamical minus universal time in seconds, by the usual polynomials for 1900 to 2150."""
    t, u = year - 2000, (year - 1820) / 100
    return (
        F.when(year.between(2005, 2049), 62.92 + 0.32217 * t + 0.005589 * t * t)
        .when(year.between(1986, 2004), 63.86 + 0.3345 * t - 0.060374 * t * t + 0.0017275 * t * t * t)
        .when(year.between(1961, 1985), 45.45 + 1.067 * (year - 1975) - (year - 1975) * (year - 1975) / 260)
        .when(year.between(1900, 1960), 29.07 + 0.407 * (year - 1950) - (year - 1950) * (year - 1950) / 233)
        .otherwise(-20 + 32 * u * u)
    )


def _instant(jd: Column, year: Column) -> Column:
    """A dynamical Julian day as a timestamp of whole seconds in universal time."""
    return F.timestamp_seconds(F.round((jd - 2440587.5) * 86400 - delta_t(year)))


def season_instant(year: Column, event: int) -> Column:
    """The instant of one of EVENTS in a year."""
    y = (year - 2000) / 1000
    jde = F.lit(0.0)
    for c in reversed(SEASONS[event]):
        jde = jde * y + c

    def refined(jde0: Column) -> Column:
        t = (jde0 - 2451545.0) / 36525
        w = 35999.373 * t - 2.47
        total = F.lit(0.0)
        for a, b, c in TERMS:
            total = total + a * _cos(b + c * t)
        return jde0 + 0.00001 * total / (1 + 0.0334 * _cos(w) + 0.0007 * _cos(2 * w))

    return _instant(F.transform(F.array(jde), refined)[0], year)


def solar_events(df: DataFrame, year: str) -> DataFrame:
    """df with a row for each of the four events of its year: event, instant."""
    rows = F.array(*(F.struct(F.lit(name).alias("event"), season_instant(F.col(year).cast("double"), i).alias("instant")) for i, name in enumerate(EVENTS)))
    return df.withColumn("_e", F.explode(rows)).select(*df.columns, "_e.event", "_e.instant")


def wheel_of_year(df: DataFrame, year: str, southern: bool = False) -> DataFrame:
    """df with a row for each of the eight points of its year, in order: name, role, instant. In the south names move by half the wheel."""
    fixed = {0: "02-01", 2: "05-01", 4: "08-01", 6: "10-31"}
    rows = []
    for i in range(8):
        name = WHEEL[(i + 4) % 8 if southern else i]
        day = F.to_timestamp(F.concat_ws("-", F.col(year).cast("string"), F.lit(fixed[i]))) if i in fixed else season_instant(F.col(year).cast("double"), i // 2)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit("Checkpoint" if i in fixed else "Boundary").alias("role"), day.alias("instant")))
    return df.withColumn("_e", F.explode(F.array(*rows))).select(*df.columns, "_e.name", "_e.role", "_e.instant")


def personal_year(birth: Column, on: Column, tolerance_days: float = 2.0) -> Column:
    """struct(period_number, ruling_planet, transition) on a date, counted from the last birthday; a 29 February is a 28th in other years."""

    def birthday(year: Column) -> Column:
        last = F.dayofmonth(F.last_day(F.make_date(year, F.month(birth), F.lit(1))))
        return F.make_date(year, F.month(birth), F.least(F.dayofmonth(birth), last))

    this = birthday(F.year(on))
    start = F.when(this <= on, this).otherwise(birthday(F.year(on) - 1))
    days = F.datediff(on, start).cast("double")
    index = F.least(F.greatest(F.floor(days / PERIOD), F.lit(0)), F.lit(6)).cast("int")
    near = (F.abs(days - index * PERIOD) <= tolerance_days) | (F.abs(days - (index + 1) * PERIOD) <= tolerance_days)
    return F.struct((index + 1).alias("period_number"), F.element_at(F.array(*map(F.lit, PLANETS)), index + 1).alias("ruling_planet"), near.alias("transition"))


def _phase_jd(k: Column, quarter: float) -> Column:
    """Dynamical Julian day of a phase near lunation k (a whole number plus the quarter)."""
    n = k + quarter
    t = n / 1236.85
    e = 1 - 0.002516 * t - 0.0000074 * t * t
    m, mp, f = 2.5534 + 29.10535670 * n, 201.5643 + 385.81693528 * n + 0.0107582 * t * t, 160.7108 + 390.67050284 * n - 0.0016118 * t * t
    jd = 2451550.09766 + 29.530588861 * n + 0.00015437 * t * t
    if quarter in (0, 0.5):
        a, b, c, d = (-0.40720, 0.17241, 0.01608, 0.01039) if quarter == 0 else (-0.40614, 0.17302, 0.01614, 0.01043)
        return jd + a * _sin(mp) + b * e * _sin(m) + c * _sin(2 * mp) + d * _sin(2 * f) + 0.0074 * e * _sin(mp - m) - 0.00514 * e * _sin(mp + m) + 0.00208 * e * e * _sin(2 * m)
    w = 0.00306 - 0.00038 * e * _cos(m) + 0.00026 * _cos(mp)
    common = -0.62801 * _sin(mp) + 0.17172 * e * _sin(m) - 0.01183 * e * _sin(mp + m) + 0.00862 * _sin(2 * mp) + 0.00804 * _sin(2 * f) + 0.00454 * e * _sin(mp - m) + 0.00204 * e * e * _sin(2 * m)
    return jd + common + (w if quarter == 0.25 else -w)


def moon_phase(day: Column, tolerance_hours: float = 12.0) -> Column:
    """struct(name, illumination_fraction, days_into_cycle, near_new, near_first_quarter, near_full, near_last_quarter) at midnight UTC."""
    jd = F.datediff(day, F.lit("1970-01-01").cast("date")) + 2440587.5
    k = F.floor((jd - 2451550.09766) / SYNODIC)

    def nearest(quarter: float) -> Column:
        found = [_phase_jd(k + i, quarter) for i in (-1, 0, 1)]
        return F.array_min(F.array(*(F.struct(F.abs(x - jd).alias("gap"), x.alias("jd")) for x in found)))

    new = F.array_max(F.filter(F.array(*(_phase_jd(k + i, 0) for i in (-1, 0, 1))), lambda x: x <= jd))

    def made(new_jd: Column) -> Column:
        days = jd - new_jd
        arc = F.pmod(F.floor(days / SYNODIC * 8 + 0.5), F.lit(8)).cast("int")
        flags = [(nearest(q)["gap"] * 24 <= tolerance_hours).alias(n) for q, n in ((0, "near_new"), (0.25, "near_first_quarter"), (0.5, "near_full"), (0.75, "near_last_quarter"))]
        return F.struct(F.element_at(F.array(*map(F.lit, PHASES)), arc + 1).alias("name"), _illumination(jd).alias("illumination_fraction"), days.alias("days_into_cycle"), *flags)

    return F.transform(F.array(new), made)[0]


def _illumination(jd: Column) -> Column:
    """Lit fraction of the disc from the moon's elongation, chapter 48."""
    t = (jd - 2451545.0) / 36525
    d = 297.8501921 + 445267.1114034 * t
    m, mp = 357.5291092 + 35999.0502909 * t, 134.9633964 + 477198.8675055 * t
    i = 180 - d - 6.289 * _sin(mp) + 2.100 * _sin(m) - 1.274 * _sin(2 * d - mp) - 0.658 * _sin(2 * d) - 0.214 * _sin(2 * mp) - 0.110 * _sin(d)
    return (1 + _cos(i)) / 2


def boundaries(spark, start: str, end: str, birth: str | None = None, southern: bool = False) -> DataFrame:
    """(instant, kind, name) between two dates, in order: primary moon phases, points of the wheel and, with a birth date, period starts."""
    first, last = int(start[:4]), int(end[:4])
    years = spark.range(first - 1, last + 2).withColumnRenamed("id", "year")
    wheel = wheel_of_year(years, "year", southern).select("instant", F.lit("wheel").alias("kind"), "name")
    k = spark.range(math.floor((first - 2000) * 12.3685) - 2, math.ceil((last + 1 - 2000) * 12.3685) + 3).withColumnRenamed("id", "k")
    moons = [k.select(_instant(_phase_jd(F.col("k"), q), 2000 + F.floor(F.col("k") / 12.3685)).alias("instant"), F.lit("moon").alias("kind"), F.lit(PHASES[int(q * 8)]).alias("name")) for q in (0, 0.25, 0.5, 0.75)]
    out = wheel
    for m in moons:
        out = out.unionByName(m)
    if birth:
        year, month, day = birth.split("-")
        on = F.make_date("year", F.lit(int(month)), F.least(F.lit(int(day)), F.dayofmonth(F.last_day(F.make_date("year", F.lit(int(month)), F.lit(1))))))
        starts = years.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"), on.alias("on"))
        starts = starts.select(F.timestamp_seconds(F.unix_timestamp(F.col("on").cast("timestamp")) + F.round(F.col("i") * PERIOD * 86400)).alias("instant"), F.lit("personal-year").alias("kind"), F.element_at(F.array(*map(F.lit, PLANETS)), F.col("i") + 1).alias("name"))
        out = out.unionByName(starts)
    return out.where((F.col("instant") >= F.lit(start).cast("timestamp")) & (F.col("instant") <= F.lit(end).cast("timestamp"))).orderBy("instant", "kind")
