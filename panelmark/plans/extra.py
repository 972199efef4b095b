"""More of the library's queries: functions of text and dates, sinks, windows of events, calibration, field sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmark.functions import classify, scoring, seasons, stats
from panelmark.functions.scoring import rounded
from panelmark.operators import activity, sinks
from panelmark.plans.catalog import QUERIES, component_marks, panel_marks, query, scored_marks
from panelmark.sources import protocols
from panelmark.sources.tables import MARKS_SQL, marks, table
from panelmark.streaming import ingest

_ = QUERIES  # registered by the decorator


@query("""SELECT o_orderkey, CAST(((y % 100) * 100 + (y + 1) % 100) AS INTEGER) AS season, CAST(2002 - yy - CASE WHEN mm > 7 OR (mm = 7 AND dd > 1) THEN 1 ELSE 0 END AS INTEGER) AS age, CASE WHEN CAST(o_orderdate AS DATE) = DATE '2002-07-01' THEN 1 WHEN f > 2002 THEN 0 ELSE CAST(2002 - f + 1 AS INTEGER) END AS years
FROM (SELECT *, year(o_orderdate) AS yy, month(o_orderdate) AS mm, day(o_orderdate) AS dd, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS f FROM orders)""")
def season_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, listing = F.to_date("o_orderdate"), F.lit(203)  # the season that begins in 2002
    return table(spark, sf_dir, "orders").select("o_orderkey", seasons.of_date(d).alias("season"), seasons.age_at(d, listing).alias("age"), seasons.years_in_grade(d, listing).alias("years"))


@query("""SELECT p_partkey, CASE WHEN n LIKE '%WOMEN%' THEN 'Singles' WHEN n LIKE '%DANCE%' THEN 'Ice Dance' WHEN n LIKE '%PAIR%' THEN 'Pairs' ELSE 'Uncategorized' END AS discipline,
CASE WHEN n LIKE '%SENIOR%' THEN 'Senior' WHEN n LIKE '%JUNIOR%' THEN 'Junior' ELSE 'Unspecified' END AS level FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SENIOR WOMEN' WHEN 1 THEN 'JUNIOR  PAIRS' WHEN 2 THEN '151JUNIOR ICE-DANCE' ELSE 'OTHER' END AS n FROM part)""")
def segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Senior Women - Free").when(k == 1, "Junior  Pairs").when(k == 2, "151Junior Ice-Dance").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", classify.discipline(name).alias("discipline"), classify.level(name).alias("level"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(u), '/index\\.(asp|htm|html)$') THEN lower(u) WHEN regexp_matches(lower(u), '/leaderboard/results/[0-9]{4}/[0-9]+$') THEN lower(u) || '/index.asp' ELSE lower(u) || '/index.htm' END AS url_key FROM (SELECT page_id, regexp_replace(trim(url), '/+$', '') AS u FROM pages)""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", classify.url_key(F.col("url")).alias("url_key"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", protocols.title(F.col("html")).alias("title"))


@query(None)
def protocol_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocols.protocols(table(spark, sf_dir, "pages"))


@query(MARKS_SQL + """, t AS (SELECT element_id, min(judge_score) AS lo, max(judge_score) AS hi FROM marks GROUP BY element_id), s AS (SELECT judge_id, CASE WHEN lo = hi AND lo = pcs_score - 5 THEN 'In Range' WHEN pcs_score - 5 < lo - 1 THEN 'Low- out of range with allowance' WHEN pcs_score - 5 < lo THEN 'Low- out of range'
WHEN pcs_score - 5 = lo THEN 'Low- thrown out' WHEN pcs_score - 5 > hi + 1 THEN 'High- out of range with allowance' WHEN pcs_score - 5 > hi THEN 'High- out of range' WHEN pcs_score - 5 = hi THEN 'High- thrown out' ELSE 'In Range' END AS state FROM marks JOIN t USING (element_id))
SELECT judge_id, state, count(*) AS n FROM s GROUP BY ALL""")
def trial_range_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir)
    panel = Window.partitionBy("element_id")
    state = classify.range_state(F.col("pcs_score") - 5, F.min("judge_score").over(panel), F.max("judge_score").over(panel))
    return own.select("judge_id", state.alias("state")).groupBy("judge_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query(MARKS_SQL + """, f AS (SELECT skater_segment_id, element_id, max(CASE WHEN judge_score <= -5 THEN 1 ELSE 0 END) AS falls FROM marks GROUP BY ALL), g AS (SELECT skater_segment_id, sum(falls) AS falls FROM f GROUP BY ALL)
SELECT element_id, judge_id, CASE WHEN falls >= 2 THEN pcs_score > 8.75 WHEN falls = 1 THEN pcs_score > 9.5 ELSE is_rule_error END AS is_rule_error FROM marks JOIN g USING (skater_segment_id)""")
def fall_cap_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir)
    notes = F.when(F.col("judge_score") <= -5, "F")
    falls = own.groupBy("skater_segment_id", "element_id").agg(F.max(F.coalesce(scoring.falls(notes), F.lit(0))).alias("falls"))
    caps = falls.groupBy("skater_segment_id").agg(scoring.fall_cap(F.sum("falls")).alias("cap"))
    return sinks.reflagged(own, caps, "skater_segment_id", "pcs_score").select("element_id", "judge_id", "is_rule_error")


@query(MARKS_SQL + """, b AS (SELECT discipline_type_id AS d, element_type_id AS e, segment_id AS s, grouping(discipline_type_id, element_type_id, segment_id) AS g, count(*) AS n, stddev_samp(deviation) AS sd FROM panel GROUP BY GROUPING SETS ((discipline_type_id, element_type_id, segment_id), (discipline_type_id, element_type_id), (discipline_type_id)) HAVING count(*) >= 30),
z AS (SELECT judge_id, deviation / coalesce(b1.sd, b2.sd, b3.sd) AS z FROM panel LEFT JOIN b b1 ON b1.g = 0 AND b1.d = discipline_type_id AND b1.e = element_type_id AND b1.s = segment_id LEFT JOIN b b2 ON b2.g = 1 AND b2.d = discipline_type_id AND b2.e = element_type_id LEFT JOIN b b3 ON b3.g = 3 AND b3.d = discipline_type_id)
SELECT judge_id, count(z) AS n_marks, round(avg(z), 6) + 0.0 AS mean_z, round(avg(abs(z)), 6) AS mean_abs_z FROM z GROUP BY judge_id""")
def calibrated_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations in units of the best benchmark there is: of discipline, type and segment, else of the first two, else of the first."""
    own = panel_marks(spark, sf_dir)
    keys = ["discipline_type_id", "element_type_id", "segment_id"]
    sets = own.groupingSets([[F.col(k) for k in keys[:n]] for n in (3, 2, 1)], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.stddev_samp("deviation").alias("sd")).where("n >= 30")
    for n, g in ((3, 0), (2, 1), (1, 3)):
        own = own.join(sets.where(F.col("g") == g).select(*keys[:n], F.col("sd").alias(f"sd{n}")), keys[:n], "left")
    z = own.select("judge_id", (F.col("deviation") / F.coalesce("sd3", "sd2", "sd1")).alias("z"))
    return z.groupBy("judge_id").agg(F.count("z").alias("n_marks"), rounded(F.avg("z")).alias("mean_z"), rounded(F.avg(F.abs("z"))).alias("mean_abs_z"))


@query(MARKS_SQL + """, s AS (SELECT competition_id, segment_id, any_value(discipline_type_id) AS k, count(DISTINCT skater_segment_id) AS entries, count(DISTINCT skater_segment_id % 7) AS countries, bool_or(competition_type_id >= 15) AS i FROM marks GROUP BY ALL)
SELECT competition_id, segment_id, entries, countries, NOT i OR entries = 0 OR (entries >= 6 AND (countries = 0 OR countries >= 2)) AS eligible FROM s""")
def field_size_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir).groupBy("competition_id", "segment_id").agg(F.countDistinct("skater_segment_id").alias("entries"), F.countDistinct(F.col("skater_segment_id") % 7).alias("countries"), F.bool_or(F.col("competition_type_id") >= 15).alias("i"))
    return own.select("competition_id", "segment_id", "entries", "countries", activity.field_size_ok(F.col("entries"), F.col("countries"), F.lit("singles"), F.col("i")).alias("eligible"))


@query("SELECT CAST(o_custkey AS BIGINT) AS key, o_orderkey AS version, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"))
    return sinks.upserted(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["key"], "version")


@query("SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return sinks.insert_ignored(table(spark, sf_dir, "supplier").where("s_nationkey < 10").select("s_suppkey"), new, ["s_suppkey"])


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) + 0.0 AS total, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long").k)
    out = own.groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"), F.sum("k").alias("k"))
    return out.select("event_type", "hour", "n", "total", "k")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS begins, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", F.col("session_window.start").alias("begins"), "n")


@query(None)
def significance_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bias_tests(panel_marks(spark, sf_dir))


@query(MARKS_SQL + "SELECT competition_id, judge_id, count(*) AS n, round(avg(pcs_score - pcs), 6) + 0.0 AS bias FROM (SELECT *, avg(pcs_score) OVER (PARTITION BY element_id) AS pcs FROM marks) WHERE competition_type_id IN (4, 8) GROUP BY ALL")
def championship_pcs_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = component_marks(spark, sf_dir).where(F.col("competition_type_id").isin(4, 8))
    return own.groupBy("competition_id", "judge_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("deviation")).alias("bias"))


@query(None)
def championship_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spread for all, then each championship ranked by it; one row a championship."""
    own = scored_marks(spark, sf_dir).where(F.col("competition_type_id").isin(4, 8))
    by = own.groupBy("competition_id", "judge_id").agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("score"))
    return by.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n_judges"), *[rounded(f).alias(n) for n, f in (("least", F.min("score")), ("median", F.percentile("score", F.lit(0.5))), ("mean", F.avg("score")), ("most", F.max("score")), ("std", F.stddev_pop("score")))])
