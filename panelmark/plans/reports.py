"""Queries of the composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions.scoring import ELEMENT_ANOMALY, allowed_anomalies, is_anomaly
from panelmark.operators import identity, reports, sigma
from panelmark.plans.catalog import _ERR, _LINKS, _SERVICE, appointments, panel_marks, query, scored_marks, service
from panelmark.sources.tables import MARKS_SQL, judge_links, marks, table

_ROLE = "CASE o_orderkey % 4 WHEN 0 THEN 'Judge 3' WHEN 1 THEN 'Assistant Technical Specialist' WHEN 2 THEN 'Event Referee' ELSE 'Music' END"


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    role = F.when(k == 0, "Judge 3").when(k == 1, "Assistant Technical Specialist").when(k == 2, "Event Referee").otherwise("Music")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("official_id"), (F.col("o_orderkey") % 50).alias("competition_id"), role.alias("role"))


@query(f"SELECT competition_id, official_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS roles, count(*) AS n_panels FROM (SELECT o_orderkey % 50 AS competition_id, o_custkey AS official_id, CASE {_ROLE} WHEN 'Judge 3' THEN 'Judge' WHEN 'Music' THEN 'Music' WHEN 'Event Referee' THEN 'Referee' ELSE 'Technical Specialist' END AS label FROM orders) GROUP BY ALL")
def competition_officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.officials_of(panels(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS official_id, o_orderkey % 50 AS competition_id FROM orders WHERE o_totalprice > 200000), p AS (SELECT DISTINCT o_custkey AS official_id, o_orderkey % 50 AS competition_id FROM orders WHERE o_orderkey % 4 = 0)
SELECT official_id, competition_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'scored' ELSE 'protocol' END AS found FROM (SELECT official_id, competition_id, bool_or(k = 0) AS a, bool_or(k = 1) AS b FROM (SELECT *, 0 AS k FROM s UNION ALL SELECT *, 1 FROM p) GROUP BY ALL)""")
def official_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("official_id"), (F.col("o_orderkey") % 50).alias("competition_id"))
    return reports.competitions_of(scored, panels(spark, sf_dir).where("role = 'Judge 3'"))


@query(_SERVICE + "SELECT official_id, count(DISTINCT year) AS n_years, array_to_string(list_sort(list(DISTINCT year)), ', ') AS years FROM service WHERE international GROUP BY official_id")
def chief_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.years_of(service(spark, sf_dir), F.col("international"))


@query(_SERVICE + "SELECT official_id, count(*) AS n_years FROM (SELECT official_id, year, bool_and(NOT qualifying) AS lower FROM service GROUP BY ALL) WHERE lower GROUP BY official_id")
def lower_level_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lower_only_years(service(spark, sf_dir), ~F.col("qualifying"))


@query(_SERVICE + "SELECT official_id, appointment_type_id, min(achieved_year) AS achieved_year FROM appointments WHERE achieved_year BETWEEN 1995 AND 1997 GROUP BY ALL")
def appointments_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.appointed_between(appointments(spark, sf_dir), 1995, 1997)


@query(_SERVICE + """, e AS (SELECT DISTINCT official_id, year, CASE competition_id % 4 WHEN 0 THEN 'worlds' WHEN 1 THEN 'junior_worlds' WHEN 2 THEN 'europeans' END AS event FROM service)
SELECT official_id, coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (event = 'worlds'), '') AS worlds, coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (event = 'junior_worlds'), '') AS junior_worlds, coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (event = 'europeans'), '') AS europeans FROM e WHERE event IS NOT NULL GROUP BY official_id""")
def major_event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("competition_id") % 4
    name = F.when(k == 0, "ISU World  Championships").when(k == 1, "World Junior Championships").when(k == 2, "European Championship").otherwise("City Open")
    return reports.event_matrix(service(spark, sf_dir).withColumn("name", name), ["worlds", "junior_worlds", "europeans"])


@query(MARKS_SQL + """, e AS (SELECT competition_id, segment_id, count(DISTINCT skater_segment_id) AS entries FROM panel GROUP BY ALL), o AS (SELECT competition_id, segment_id, judge_id, count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) AS observed FROM panel GROUP BY ALL),
g AS (SELECT competition_id, CAST(sum(observed) AS BIGINT) AS n_anomalies, CAST(sum(greatest(0, observed - CASE WHEN entries <= 10 THEN 1 WHEN entries <= 20 THEN 2 ELSE 3 END)) AS BIGINT) AS n_excess, count(*) AS n_judges FROM o JOIN e USING (competition_id, segment_id) GROUP BY competition_id)
SELECT *, row_number() OVER (ORDER BY n_excess DESC, competition_id) AS rank FROM g""")
def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panel_marks(spark, sf_dir)
    fields = own.groupBy("competition_id", "segment_id").agg(F.countDistinct("skater_segment_id").alias("entries"))
    anomaly = is_anomaly(F.col("deviation"), F.col("is_rule_error"), ELEMENT_ANOMALY)
    each = own.groupBy("competition_id", "segment_id", "judge_id").agg(F.count(F.when(anomaly, 1)).alias("observed")).join(fields, ["competition_id", "segment_id"])
    return reports.summary_by_event(each.withColumn("over", F.greatest(F.lit(0), F.col("observed") - allowed_anomalies(F.col("entries")))))


@query(MARKS_SQL + "SELECT judge_id, discipline_type_id, count(*) AS n_marks, round(100.0 * count(*) FILTER (deviation > 0) / count(*), 2) AS high_rate, round(100.0 * count(*) FILTER (deviation < 0) / count(*), 2) AS low_rate FROM panel GROUP BY ALL")
def high_low_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.split_rates(panel_marks(spark, sf_dir), ["judge_id", "discipline_type_id"])


@query(MARKS_SQL + "SELECT season_start, count(deviation) AS n, round(avg(deviation), 6) + 0.0 AS mean, round(stddev_samp(deviation), 6) AS std, round(quantile_cont(deviation, 0.25), 6) + 0.0 AS q25, round(quantile_cont(deviation, 0.5), 6) + 0.0 AS median, round(quantile_cont(deviation, 0.75), 6) + 0.0 AS q75 FROM panel GROUP BY season_start")
def deviation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(panel_marks(spark, sf_dir), ["season_start"], "deviation")


@query(_ERR + """, d AS (SELECT judge_id, discipline_type_id, round(sqrt(avg(m * m)), 6) AS s FROM m GROUP BY ALL), r AS (SELECT judge_id, CASE WHEN s IS NULL OR s < 0.1 THEN 'N/A' WHEN s < 0.98 THEN 'Good' WHEN s < 1.02 THEN 'Fair' ELSE 'Poor' END AS rating FROM d)
SELECT judge_id, CASE WHEN count(*) FILTER (rating = 'N/A') > 0 THEN 'N/A' WHEN count(*) FILTER (rating = 'Poor') >= 2 THEN 'Poor' WHEN count(*) FILTER (rating = 'Good') = count(*) THEN 'Good' WHEN count(*) FILTER (rating = 'Poor') = 1 THEN 'Fair' ELSE 'Fair/Good' END AS overall FROM r GROUP BY judge_id""")
def judge_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = sigma.summary(scored_marks(spark, sf_dir), ["judge_id", "discipline_type_id"])
    return reports.overall_rating(reports.rated(by, 0.98, 1.02), "judge_id")


@query(MARKS_SQL.replace("WITH kept", _LINKS.rstrip() + ", kept", 1) + ", ids AS (SELECT x AS judge_id, min(y) AS identity FROM reach GROUP BY x) SELECT competition_id, count(DISTINCT judge_id) AS n_judges, count(*) AS n_marks FROM marks JOIN ids USING (judge_id) WHERE judge_id <> identity GROUP BY competition_id")
def reload_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reload_candidates(marks(spark, sf_dir), identity.identities(judge_links(spark, sf_dir)))


@query(_SERVICE + """, g AS (SELECT official_id, count(DISTINCT competition_id) AS total, count(DISTINCT competition_id) FILTER (scope = 'BUILDING') AS n0, count(DISTINCT competition_id) FILTER (season_code = 2000) AS n1 FROM service GROUP BY ALL)
SELECT *, total >= 5 AND n0 >= 2 AND n1 >= 1 AS met FROM g""")
def mixed_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mix_met(service(spark, sf_dir), 5, [(F.col("scope") == "BUILDING", 2), (F.col("season_code") == 2000, 1)])


@query(MARKS_SQL + "SELECT judge_id, season_start, count(*) FILTER (k = 0) AS n_left, count(*) FILTER (k = 1) AS n_right FROM (SELECT judge_id, season_start, 0 AS k FROM marks WHERE judge_score > 3 UNION ALL SELECT judge_id, season_start, 1 FROM marks WHERE pcs_score > 9.5) GROUP BY ALL")
def full_outer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir)
    return reports.full_years(own.where("judge_score > 3"), own.where("pcs_score > 9.5"), ["judge_id", "season_start"])


@query(_ERR + """, r AS (SELECT judge_id, n_marks, marking_score, row_number() OVER (ORDER BY marking_score, judge_id) AS rank FROM summary)
SELECT judge_id, n_marks, marking_score, row_number() OVER (ORDER BY rank) AS rank FROM r WHERE judge_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def linked_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = judge_links(spark, sf_dir).where("official LIKE 'i%'")
    return reports.linked_only(sigma.ranked(sigma.summary(scored_marks(spark, sf_dir))).select("judge_id", "n_marks", "marking_score", "rank"), linked)
