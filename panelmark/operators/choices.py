"""Orders, sets and seminars: what reports put first, ids in common, attendance in season windows, comparisons of pools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark.functions.scoring import rounded
from panelmark.functions.stats import t_two_sided


def newest_first(date: Column, season: Column, name: Column) -> list[Column]:
    """The order of competitions: the newest first, without a date last, then season as text and name in any case."""
    return [F.desc_nulls_last(date), F.asc(season.cast("string")), F.asc(F.lower(name))]


def activity_order(start: Column, end: Column, season: Column, *names: Column) -> list[Column]:
    """The order of activity: by the end, else the start, the newest first and null last; a season of digits as a number, others as 0; names."""
    return [F.desc_nulls_last(F.coalesce(end, start)), F.desc(F.when(season.rlike("^[0-9]+$"), season.cast("int")).otherwise(0)), *map(F.asc, names)]


def in_common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def unused(available: Column, used: Column) -> Column:
    return F.array_sort(F.array_except(available, used))


def with_total(counts: DataFrame, key: str, n: str = "n", label: str = "Total") -> DataFrame:
    """counts (key, n) in order of n, with the running share in percent, and last a total row."""
    own = counts.withColumn(key, F.col(key).cast("string"))
    all_ = own.agg(F.sum(n).alias("all"))
    run = F.sum(n).over(Window.orderBy(F.desc(n), key))  # a row a value of the key
    rows = own.crossJoin(F.broadcast(all_)).select(key, n, rounded(100.0 * run / F.col("all"), 4).alias("running"))  # one row
    return rows.unionByName(all_.select(F.lit(label).alias(key), F.col("all").alias(n), F.lit(100.0).alias("running")))


def attended(seminars: DataFrame, last_season: int, window: int, in_person: bool | None = None) -> Column:
    """Whether a seminar (season, in_person) is in the window of seasons that ends with last_season, and of that delivery."""
    own = (F.col("season") <= last_season) & (F.col("season") > last_season - window)
    return own if in_person is None else own & (F.col("in_person") == in_person)


def seminar_counts(seminars: DataFrame, last_season: int, window: int, least: int, in_person: bool | None = None) -> DataFrame:
    """By official: seminars that count, and whether they are enough. Officials without any seminar have no row."""
    own = F.sum(F.when(attended(seminars, last_season, window, in_person), 1).otherwise(0))
    return seminars.groupBy("official_id").agg(own.cast("long").alias("n")).withColumn("met", F.col("n") >= least)


def seminar_alternatives(seminars: DataFrame, last_season: int, alternatives: Sequence[Mapping]) -> DataFrame:
    """By official: the label of the first alternative all requirements of which (window, min, in_person) are met, else null.

    alternatives are configuration: [{label, requirements: [{season_window, min, in_person}]}]. A requirement without a window is not met.
    """
    sums, ways = {}, []
    for i, a in enumerate(alternatives):
        met = F.lit(True)
        for j, r in enumerate(a.get("requirements") or []):
            window = int(r.get("season_window") or 0)
            counts = attended(seminars, last_season, window, r.get("in_person")) if window > 0 else F.lit(False)
            sums[f"n_{i}_{j}"] = F.sum(F.when(counts, 1).otherwise(0))
            met = met & ((F.col(f"n_{i}_{j}") >= int(r.get("min") or 1)) if window > 0 else F.lit(False))
        ways.append((met, str(a.get("label") or "Option")))
    own = seminars.groupBy("official_id").agg(F.count(F.lit(1)).alias("n_seminars"), *[v.alias(k) for k, v in sums.items()])
    label = F.lit(None).cast("string")
    for met, name in reversed(ways):
        label = F.when(met, F.lit(name)).otherwise(label)
    return own.select("official_id", "n_seminars", label.alias("way"), label.isNotNull().alias("met"))


def compared_pools(marks: DataFrame, keys: Sequence[str], value: str, second: Column) -> DataFrame:
    """By keys, of values with second false (x) and true (y): sizes, U of x with ties as halves, the greatest gap of both distributions, Student's t
    with the pooled variance. All from counts by value, so that no group is gathered; a key with one pool only has null statistics."""
    marks = marks.where(F.col(value).isNotNull()).withColumn("__y", second)
    by = marks.groupBy(*keys, value).agg(F.sum((~F.col("__y")).cast("long")).alias("x"), F.sum(F.col("__y").cast("long")).alias("y"))
    before = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    run = by.withColumns({"ry": F.sum("y").over(before), "rx": F.sum("x").over(before), "nx": F.sum("x").over(whole), "ny": F.sum("y").over(whole)})
    v, sq = F.col(value), F.col(value) * F.col(value)
    g = run.groupBy(*keys).agg(
        F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum(F.col("x") * (F.col("ry") - F.col("y") / 2)).alias("u"), F.max(F.abs(F.col("rx") / F.nullif("nx", F.lit(0)) - F.col("ry") / F.nullif("ny", F.lit(0)))).alias("d"),
        F.sum(F.col("x") * v).alias("sx"), F.sum(F.col("y") * v).alias("sy"), F.sum(F.col("x") * sq).alias("qx"), F.sum(F.col("y") * sq).alias("qy"),
    )
    rest = lambda q, s, n: F.col(q) - F.col(s) * F.col(s) / F.nullif(n, F.lit(0))
    pooled = (rest("qx", "sx", "nx") + rest("qy", "sy", "ny")) / F.nullif(F.col("nx") + F.col("ny") - 2, F.lit(0))
    t = (F.col("sx") / F.nullif("nx", F.lit(0)) - F.col("sy") / F.nullif("ny", F.lit(0))) / F.nullif(F.sqrt(pooled * (1 / F.nullif("nx", F.lit(0)) + 1 / F.nullif("ny", F.lit(0)))), F.lit(0.0))
    both = (F.col("nx") > 0) & (F.col("ny") > 0)
    return g.select(*keys, "nx", "ny", F.when(both, rounded("u", 1)).alias("u"), F.when(both, rounded("d", 6)).alias("d"), F.when(both, rounded(t, 6)).alias("t"))


@F.pandas_udf(T.DoubleType())
def slope_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """The two-sided p of a correlation of n pairs; null below three or without a correlation."""

    def one(x: float, k: int) -> float | None:
        if x is None or x != x or k < 3:
            return None
        return 0.0 if abs(x) >= 1 else t_two_sided(x * ((k - 2) / (1 - x * x)) ** 0.5, k - 2)

    return pd.Series([one(x, int(k)) for x, k in zip(r, n)], dtype="float64")


def trends(yearly: DataFrame, key: str, value: str = "value", year: str = "season_start") -> DataFrame:
    """By key: years, slope, Pearson's r with the year, and its two-sided p."""
    spread = F.stddev_pop(value) * F.stddev_pop(year)  # corr() divides by zero where one of them does not vary
    own = yearly.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(value).alias("n_years"), F.regr_slope(value, year).alias("slope"), (F.covar_pop(value, year) / F.nullif(spread, F.lit(0.0))).alias("r"))
    return own.select(key, "n_years", rounded("slope").alias("slope"), rounded("r").alias("r"), slope_p(F.col("r"), F.col("n_years")).alias("p"))


def wide_triples(sheet: DataFrame, key: str, triples: Sequence[tuple[str, str, str]], names: tuple[str, str, str] = ("judge", "score", "note")) -> DataFrame:
    """A row for each of the triples of columns that a sheet's row repeats, numbered from 1; triples without a first cell are left out."""
    cells = F.array(*[F.struct(*[F.col(c).cast("string").alias(n) for c, n in zip(t, names)]) for t in triples])
    out = sheet.select(key, F.posexplode(cells).alias("at", "cell")).select(key, (F.col("at") + 1).alias("position"), "cell.*")
    return out.where(F.coalesce(F.trim(names[0]), F.lit("")) != "")


def valid_rows(rows: DataFrame, needed: Sequence[str], flag: str = "row_ok") -> DataFrame:
    """Rows of a landed list whose needed cells are there and whose flag, if there is one, does not say no."""
    ok = F.lit(True)
    for c in needed:
        ok = ok & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows.where(ok & (~F.lower(F.coalesce(F.trim(F.col(flag).cast("string")), F.lit("yes"))).isin("no", "false", "0", "n") if flag in rows.columns else F.lit(True)))
