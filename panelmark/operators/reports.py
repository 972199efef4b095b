"""Composite reports: roles and competitions of officials, years of service, summaries by event, ratings, mixed rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions import classify
from panelmark.functions.scoring import rounded


def sorted_list(column: str) -> Column:
    return F.concat_ws(", ", F.array_sort(F.collect_set(column)))


def officials_of(panels: DataFrame, key: str = "competition_id") -> DataFrame:
    """panels (competition_id, official_id, role): by competition and official the roles held, shortened, as a sorted list."""
    own = panels.withColumn("label", classify.role_label(F.col("role")))
    return own.groupBy(key, "official_id").agg(sorted_list("label").alias("roles"), F.count(F.lit(1)).alias("n_panels"))


def competitions_of(scored: DataFrame, panels: DataFrame) -> DataFrame:
    """(official_id, competition_id) that was scored or is in the protocol, with where it was found."""
    both = scored.select("official_id", "competition_id", F.lit(1).alias("s"), F.lit(0).alias("p")).union(panels.select("official_id", "competition_id", F.lit(0), F.lit(1)))
    flags = both.groupBy("official_id", "competition_id").agg(F.max("s").alias("s"), F.max("p").alias("p"))
    return flags.select("official_id", "competition_id", F.when((F.col("s") == 1) & (F.col("p") == 1), "both").when(F.col("s") == 1, "scored").otherwise("protocol").alias("found"))


def years_of(service: DataFrame, condition: Column) -> DataFrame:
    """By official: how many years have a row that meets the condition, and the years."""
    own = service.where(condition).groupBy("official_id")
    return own.agg(F.countDistinct("year").alias("n_years"), F.concat_ws(", ", F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string"))).alias("years"))


def lower_only_years(service: DataFrame, lower: Column) -> DataFrame:
    """By official: years in which all service was at a lower level."""
    by = service.groupBy("official_id", "year").agg(F.bool_and(lower).alias("lower"))
    return by.where("lower").groupBy("official_id").agg(F.count(F.lit(1)).alias("n_years"))


def appointed_between(appointments: DataFrame, first: int, last: int) -> DataFrame:
    """Appointments achieved in a range of years; of an official's the earliest of each kind."""
    own = appointments.where(F.col("achieved_year").between(first, last))
    return own.groupBy("official_id", "appointment_type_id").agg(F.min("achieved_year").alias("achieved_year"))


def event_matrix(service: DataFrame, events: Sequence[str]) -> DataFrame:
    """service (official_id, name, year): by official, for each major event the years served, a column an event."""
    own = service.withColumn("event", classify.major_event(F.col("name"))).where("event IS NOT NULL").select("official_id", "event", "year").distinct()
    wide = own.groupBy("official_id").pivot("event", list(events)).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string"))))
    return wide.fillna("", list(events))


def summary_by_event(excess_rows: DataFrame) -> DataFrame:
    """excess_rows (competition_id, judge_id, observed, over): totals by competition, most excess first in rank."""
    own = excess_rows.groupBy("competition_id").agg(F.sum("observed").cast("long").alias("n_anomalies"), F.sum("over").cast("long").alias("n_excess"), F.count(F.lit(1)).alias("n_judges"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_excess"), "competition_id")).cast("long"))  # a row a competition


def split_rates(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys: shares of marks above and below the panel's average, in percent."""
    n = F.count(F.lit(1))
    share = lambda c: F.round(100.0 * F.count(F.when(c, 1)) / n, 2)
    return marks.groupBy(*keys).agg(n.alias("n_marks"), share(F.col("deviation") > 0).alias("high_rate"), share(F.col("deviation") < 0).alias("low_rate"))


def distribution(frame: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = frame.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), q.alias("q"))
    return own.select(*keys, "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), *[rounded(F.get("q", F.lit(i))).alias(k) for i, k in enumerate(("q25", "median", "q75"))])


def rated(scores: DataFrame, fair: float, poor: float) -> DataFrame:
    """scores (key, marking_score) with rating: N/A below 0.1, Good below fair, Fair below poor, else Poor."""
    s = F.col("marking_score")
    return scores.withColumn("rating", F.when(s.isNull() | (s < 0.1), "N/A").when(s < fair, "Good").when(s < poor, "Fair").otherwise("Poor"))


def overall_rating(ratings: DataFrame, key: str) -> DataFrame:
    """Of several ratings of a key: any N/A gives N/A, two Poor Poor, one Poor Fair, all Good Good, else Fair/Good."""
    n = lambda r: F.count(F.when(F.col("rating") == r, 1))
    own = ratings.groupBy(key).agg(n("N/A").alias("na"), n("Poor").alias("poor"), n("Good").alias("good"), F.count(F.lit(1)).alias("all"))
    return own.select(key, F.when(F.col("na") > 0, "N/A").when(F.col("poor") >= 2, "Poor").when(F.col("good") == F.col("all"), "Good").when(F.col("poor") == 1, "Fair").otherwise("Fair/Good").alias("overall"))


def reload_candidates(marks: DataFrame, merged: DataFrame) -> DataFrame:
    """merged (judge_id, identity): competitions with marks of a judge id that was merged into another."""
    moved = merged.where("judge_id <> identity")
    return marks.join(F.broadcast(moved), "judge_id").groupBy("competition_id").agg(F.countDistinct("judge_id").alias("n_judges"), F.count(F.lit(1)).alias("n_marks"))  # a row a judge


def mix_met(service: DataFrame, total: int, requirements: Sequence[tuple[Column, int]]) -> DataFrame:
    """By official: distinct competitions, of them those that meet each condition, and whether total and all minima are met."""
    counts = [F.countDistinct(F.when(c, F.col("competition_id"))).alias(f"n{i}") for i, (c, _) in enumerate(requirements)]
    own = service.groupBy("official_id").agg(F.countDistinct("competition_id").alias("total"), *counts)
    met = F.col("total") >= total
    for i, (_, least) in enumerate(requirements):
        met = met & (F.col(f"n{i}") >= least)
    return own.withColumn("met", met)


def full_years(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of two kinds of marks side by side, zero where one has none."""
    a, b = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left")), right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    return a.join(b, list(keys), "full_outer").fillna(0, ["n_left", "n_right"])


def linked_only(rankings: DataFrame, linked: DataFrame) -> DataFrame:
    """Rankings of judges that have a link, ranked again."""
    own = rankings.join(linked.select("judge_id").distinct(), "judge_id", "left_semi")
    return own.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))
