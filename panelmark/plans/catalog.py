"""The library's own queries on the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions import predicates, scoring
from panelmark.functions.scoring import rounded, with_panel
from panelmark.operators import activity, identity, profiles, rates, rules, sigma
from panelmark.sources.tables import MARKS_SQL, judge_links, judges, marks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FIVE = """count(*) AS n_marks, count(*) FILTER (thrown_out) AS n_thrown, count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) AS n_anomalies,
    count(*) FILTER (is_rule_error) AS n_rule_errors, round(avg(deviation), 6) + 0.0 AS avg_deviation"""


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def panel_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_panel(marks(spark, sf_dir))


def component_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component marks: the panel of a mark is its order."""
    return with_panel(marks(spark, sf_dir), "pcs_score")


_PCS = MARKS_SQL + """, pcs AS (
    SELECT *, median(pcs_score) OVER (PARTITION BY element_id) AS pcs_control, pcs_score - median(pcs_score) OVER (PARTITION BY element_id) AS pcs_error FROM marks
)"""
_ERR = MARKS_SQL + """, err AS (SELECT *, judge_score - control_score AS error, CAST(round_even(control_score, 0) AS INTEGER) AS control_bin FROM panel),
bins AS (SELECT discipline_type_id, element_type_id, control_bin, count(*) AS n_marks, stddev_samp(error) AS sigma FROM err GROUP BY ALL HAVING count(*) >= 30 AND stddev_samp(error) > 0),
scope AS (SELECT greatest(0.05, coalesce(stddev_samp(error), 0)) AS fallback FROM err),
hat AS (
    SELECT err.*, coalesce(b0.sigma, b1.sigma, b2.sigma, b3.sigma, b4.sigma) AS found, fallback,
        CASE WHEN b0.sigma IS NOT NULL THEN 'fitted' WHEN coalesce(b1.sigma, b2.sigma, b3.sigma, b4.sigma) IS NOT NULL THEN 'neighbor' ELSE 'fallback' END AS sigma_source
    FROM err CROSS JOIN scope
    LEFT JOIN bins b0 ON err.discipline_type_id = b0.discipline_type_id AND err.element_type_id = b0.element_type_id AND err.control_bin = b0.control_bin
    LEFT JOIN bins b1 ON err.discipline_type_id = b1.discipline_type_id AND err.element_type_id = b1.element_type_id AND err.control_bin - 1 = b1.control_bin
    LEFT JOIN bins b2 ON err.discipline_type_id = b2.discipline_type_id AND err.element_type_id = b2.element_type_id AND err.control_bin + 1 = b2.control_bin
    LEFT JOIN bins b3 ON err.discipline_type_id = b3.discipline_type_id AND err.element_type_id = b3.element_type_id AND err.control_bin - 2 = b3.control_bin
    LEFT JOIN bins b4 ON err.discipline_type_id = b4.discipline_type_id AND err.element_type_id = b4.element_type_id AND err.control_bin + 2 = b4.control_bin
), m AS (SELECT *, greatest(0.05, coalesce(found, fallback)) AS sigma_hat, error / greatest(0.05, coalesce(found, fallback)) AS m FROM hat),
summary AS (
    SELECT judge_id, count(*) AS n_marks, round(sqrt(avg(m * m)), 6) AS marking_score, round(avg(error), 6) + 0.0 AS mean_error, round(avg(abs(error)), 6) AS mean_abs_error,
        round(avg(sigma_hat), 6) AS mean_sigma_hat, round(avg(abs(m)), 6) AS mean_abs_m FROM m GROUP BY judge_id
)"""


def scored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element marks with error, sigma_hat and m."""
    own = sigma.with_error(panel_marks(spark, sf_dir))
    return sigma.with_sigma(own, sigma.element_bins(own), sigma.fallback(own))


# W0, W1


@query(MARKS_SQL + "SELECT element_id, judge_id, judge_score, round(panel_average, 6) + 0.0 AS panel_average, round(deviation, 6) + 0.0 AS deviation, control_score, panel_size, thrown_out FROM panel")
def panel_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panel_marks(spark, sf_dir)
    return own.select("element_id", "judge_id", "judge_score", rounded(F.col("panel_average")).alias("panel_average"), rounded(F.col("deviation")).alias("deviation"), "control_score", "panel_size", "thrown_out")


@query(MARKS_SQL + f"SELECT judge_id, {_FIVE} FROM panel GROUP BY judge_id")
def judge_five_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.five_measures(panel_marks(spark, sf_dir), ["judge_id"])


@query(MARKS_SQL + f"SELECT competition_id, judge_id, {_FIVE} FROM panel WHERE competition_type_id IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND event_date BETWEEN DATE '1996-07-01' AND DATE '2000-06-30' GROUP BY ALL")
def competition_judge_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicates.narrowed(panel_marks(spark, sf_dir), "sectionals_and_championships", "1996-07-01", "2000-06-30")
    return rates.five_measures(own, ["competition_id", "judge_id"])


@query(MARKS_SQL + f"SELECT judge_id, season_start, {_FIVE} FROM panel WHERE discipline_type_id IN (1, 2, 3) GROUP BY ALL")
def judge_season_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.five_measures(predicates.narrowed(panel_marks(spark, sf_dir), disciplines=[1, 2, 3]), ["judge_id", "season_start"])


@query(MARKS_SQL + "SELECT competition_id, discipline_type_id, judge_id, count(*) AS n_marks, count(*) FILTER (thrown_out) AS n_thrown, count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) AS n_anomalies, count(*) FILTER (is_rule_error) AS n_rule_errors, round(sum(deviation), 6) + 0.0 AS sum_deviation, round(sum(abs(deviation)), 6) + 0.0 AS sum_abs_deviation FROM panel GROUP BY ALL")
def competition_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.shards(panel_marks(spark, sf_dir))


@query(MARKS_SQL + "SELECT judge_id, count(*) AS n_marks, count(*) FILTER (thrown_out) AS n_thrown, count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) AS n_anomalies, count(*) FILTER (is_rule_error) AS n_rule_errors, round(avg(deviation), 4) + 0.0 AS avg_deviation FROM panel GROUP BY ALL")
def measures_from_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.from_shards(rates.shards(panel_marks(spark, sf_dir)), ["judge_id"])


@query(MARKS_SQL + f""", f AS (SELECT judge_id, {_FIVE} FROM panel GROUP BY judge_id)
SELECT judge_id, 'throwout_rate' AS metric, round(100.0 * n_thrown / n_marks, 2) AS value FROM f UNION ALL SELECT judge_id, 'anomaly_rate', round(100.0 * n_anomalies / n_marks, 2) FROM f
UNION ALL SELECT judge_id, 'rule_errors', CAST(n_rule_errors AS DOUBLE) FROM f WHERE n_rule_errors <> 0 UNION ALL SELECT judge_id, 'avg_deviation', round(abs(avg_deviation), 4) + 0.0 FROM f""")
def heatmap_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rates.five_measures(panel_marks(spark, sf_dir), ["judge_id"])
    first, *rest = (rates.heatmap(own, m).select("judge_id", "metric", "value") for m in rates.METRICS)
    for r in rest:
        first = first.unionByName(r)
    return first


@query(MARKS_SQL + "SELECT count(*) AS n_marks, round(100.0 * count(*) FILTER (thrown_out) / count(*), 2) AS throwout_rate, round(100.0 * count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) / count(*), 2) AS anomaly_rate, count(*) FILTER (is_rule_error) AS n_rule_errors, round(avg(abs(deviation)), 4) AS mean_abs_deviation FROM panel")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.pooled(panel_marks(spark, sf_dir))


@query(MARKS_SQL + """, e AS (SELECT competition_id, segment_id, count(DISTINCT skater_segment_id) AS entries FROM panel GROUP BY ALL),
o AS (SELECT competition_id, segment_id, judge_id, count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) AS observed FROM panel GROUP BY ALL)
SELECT judge_id, CAST(sum(observed) AS BIGINT) AS n_anomalies, CAST(sum(greatest(0, observed - CASE WHEN entries <= 10 THEN 1 WHEN entries <= 20 THEN 2 ELSE 3 END)) AS BIGINT) AS n_excess, count(*) AS n_segments FROM o JOIN e USING (competition_id, segment_id) GROUP BY judge_id""")
def excess_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.excess(panel_marks(spark, sf_dir))


@query(MARKS_SQL + "SELECT discipline_type_id, panel_size, count(*) AS n_marks, round(100.0 * count(*) FILTER (thrown_out) / count(*), 3) AS throwout_rate, round(100.0 * count(*) FILTER (abs(deviation) >= 2 OR is_rule_error) / count(*), 3) AS anomaly_rate FROM panel WHERE panel_size BETWEEN 3 AND 12 GROUP BY ALL")
def panel_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.panel_benchmark(panel_marks(spark, sf_dir))


@query(MARKS_SQL + "SELECT element_id, judge_id, judge_score, CAST(NULL AS DOUBLE) AS pcs_score, 'element' AS kind FROM panel WHERE is_rule_error UNION ALL SELECT element_id, judge_id, NULL, pcs_score, 'pcs' FROM panel WHERE is_rule_error")
def rule_error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir).select("element_id", "judge_id", "judge_score", "pcs_score", "is_rule_error")
    return rates.rule_error_list(own.drop("pcs_score"), own.drop("judge_score")).select("element_id", "judge_id", "judge_score", "pcs_score", "kind")


@query("SELECT coalesce(r_name, 'not linked') AS kind, count(*) AS n FROM supplier LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON s_nationkey = n_nationkey GROUP BY 1")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_id"), F.col("r_name").alias("kind"))
    return rates.type_breakdown(judges(spark, sf_dir), linked, "nation_id")


_YEARS = MARKS_SQL + ", y AS (SELECT judge_id, season_start, round(avg(abs(deviation)), 2) AS value, count(*) AS n_marks FROM panel GROUP BY ALL)"


@query(_YEARS + "SELECT season_start, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) + 0.0 AS std, count(*) AS n_judges FROM y GROUP BY season_start")
def overall_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.overall_trend(rates.yearly(panel_marks(spark, sf_dir)))


@query(_YEARS + """, g AS (SELECT judge_id, count(*) AS n_years, round(regr_slope(value, season_start), 6) + 0.0 AS slope, var_pop(value) AS v, max(value) - min(value) AS s FROM y GROUP BY judge_id)
SELECT judge_id, n_years, CASE WHEN n_years >= 2 THEN slope END AS slope, CASE WHEN n_years < 2 THEN 'insufficient_data' WHEN abs(slope) < 0.1 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
CASE WHEN n_years >= 2 THEN round(CASE WHEN s = 0 THEN 100.0 ELSE greatest(0, 100 - v / (s * s / 4) * 100) END, 2) + 0.0 END AS consistency FROM g""")
def consistency_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.consistency(rates.yearly(panel_marks(spark, sf_dir)))


@query(MARKS_SQL + """, z AS (SELECT *, abs((deviation - avg(deviation) OVER j) / stddev_pop(deviation) OVER j) AS z FROM panel WINDOW j AS (PARTITION BY judge_id)),
g AS (SELECT judge_id, count(*) AS n, avg(deviation) AS m, stddev_samp(deviation) AS s, count(*) FILTER (thrown_out) AS k, count(*) FILTER (z > 2.58) AS o FROM z GROUP BY judge_id)
SELECT judge_id, n, round(m / (s / sqrt(n)), 4) + 0.0 AS t, round((k - 0.05 * n) ** 2 / (0.05 * n) + (0.05 * n - k) ** 2 / (0.95 * n), 4) + 0.0 AS chi2, round(100.0 * o / n, 4) AS outlier_rate FROM g""")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.significance(panel_marks(spark, sf_dir))


@query(MARKS_SQL + "SELECT DISTINCT judge_id, competition_id FROM marks WHERE judge_score > 3 UNION SELECT DISTINCT judge_id, competition_id FROM marks WHERE pcs_score > 9")
def judge_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir)
    return rates.appearances(own.where("judge_score > 3"), own.where("pcs_score > 9"))


# W2


@query(_ERR + "SELECT discipline_type_id, element_type_id, control_bin, n_marks, round(sigma, 6) AS sigma FROM bins")
def element_sigma_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.element_bins(sigma.with_error(panel_marks(spark, sf_dir))).withColumn("sigma", rounded(F.col("sigma")))


@query(_ERR + "SELECT element_id, judge_id, sigma_source, round(sigma_hat, 6) AS sigma_hat, round(m, 6) + 0.0 AS m FROM m")
def element_sigma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_marks(spark, sf_dir).select("element_id", "judge_id", "sigma_source", rounded(F.col("sigma_hat")).alias("sigma_hat"), rounded(F.col("m")).alias("m"))


@query(_ERR + "SELECT *, row_number() OVER (ORDER BY marking_score, judge_id) AS rank FROM summary WHERE n_marks >= 10")
def element_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.ranked(sigma.summary(scored_marks(spark, sf_dir)), 10)


@query(_ERR + "SELECT judge_id, discipline_type_id, element_type_id, count(*) AS n_marks, round(sqrt(avg(m * m)), 6) AS marking_score, round(avg(error), 6) + 0.0 AS mean_error, round(avg(abs(error)), 6) AS mean_abs_error, round(avg(sigma_hat), 6) AS mean_sigma_hat, round(avg(abs(m)), 6) AS mean_abs_m FROM m GROUP BY ALL")
def judge_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.summary(scored_marks(spark, sf_dir), ["judge_id", "discipline_type_id", "element_type_id"])


@query(_ERR + "SELECT * FROM summary")
def merged_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judges' summaries from partial ones by season and discipline."""
    parts = sigma.partial_summary(scored_marks(spark, sf_dir), ["judge_id", "season_start", "discipline_type_id"])
    return sigma.finished(parts)


@query(_ERR + """, r AS (SELECT *, row_number() OVER (ORDER BY marking_score, judge_id) AS rank FROM summary), n AS (SELECT *, count(*) OVER () AS n, ceil(count(*) OVER () * 0.30) AS top, ceil(count(*) OVER () * 0.10) AS bottom FROM r)
SELECT judge_id, rank, CASE WHEN rank <= top THEN 'top' WHEN rank > n - bottom THEN 'bottom' WHEN rank <= top + ceil((n - top - bottom) / 2) THEN 'middle_high' ELSE 'middle_low' END AS tier FROM n""")
def judge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.tiers(sigma.ranked(sigma.summary(scored_marks(spark, sf_dir)))).select("judge_id", "rank", "tier")


@query(_ERR + "SELECT count(m) AS n, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max, round(quantile_cont(m, 0.25), 6) + 0.0 AS q25, round(quantile_cont(m, 0.5), 6) + 0.0 AS q50, round(quantile_cont(m, 0.75), 6) + 0.0 AS q75 FROM m")
def described_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.described(scored_marks(spark, sf_dir), "m")


@query(MARKS_SQL + "SELECT sha256(concat_ws(':', count(*), max(element_id), count(DISTINCT competition_id), CAST(sum(CAST(round(judge_score * 100) AS BIGINT)) AS BIGINT))) AS fingerprint FROM marks")
def data_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.fingerprint(marks(spark, sf_dir))


@query(_ERR + """, r AS (SELECT *, row_number() OVER (ORDER BY marking_score, judge_id) AS best, row_number() OVER (ORDER BY marking_score DESC, judge_id) AS worst FROM summary WHERE n_marks >= 10)
SELECT judge_id, CASE WHEN best <= 3 THEN 'best' ELSE 'worst' END AS side, printf('judge %d: score %.3f over %d marks', judge_id, marking_score, n_marks) AS takeaway FROM r WHERE best <= 3 OR worst <= 3""")
def ranking_takeaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigma.takeaways(sigma.summary(scored_marks(spark, sf_dir)), 10)


_PCS_BINS = _PCS + ", pb AS (SELECT discipline_type_id, pcs_type_id, round_even(pcs_control / 0.25, 0) * 0.25 AS control_bin, count(*) AS n_marks, avg(pcs_control) AS x, var_samp(pcs_error) AS variance FROM pcs GROUP BY ALL HAVING count(*) >= 10 AND var_samp(pcs_error) > 0)"


@query(_PCS_BINS + "SELECT discipline_type_id, pcs_type_id, control_bin, n_marks, round(x, 6) AS x, round(variance, 6) AS variance FROM pb")
def pcs_sigma_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sigma.pcs_bins(sigma.with_error(component_marks(spark, sf_dir), "pcs_score"))
    return own.withColumns({"x": rounded(F.col("x")), "variance": rounded(F.col("variance"))})


@query(_PCS_BINS + """, d AS (SELECT greatest(0.05, coalesce(stddev_samp(pcs_error), 0)) AS fallback FROM pcs),
h AS (SELECT pcs.*, greatest(0.05, coalesce(sqrt(variance), fallback)) AS s FROM pcs CROSS JOIN d LEFT JOIN pb ON pcs.discipline_type_id = pb.discipline_type_id AND pcs.pcs_type_id = pb.pcs_type_id AND round_even(pcs_control / 0.25, 0) * 0.25 = pb.control_bin),
g AS (SELECT judge_id, count(*) AS n_marks, round(sqrt(avg((pcs_error / s) ** 2)), 6) AS marking_score FROM h GROUP BY judge_id)
SELECT *, row_number() OVER (ORDER BY marking_score, judge_id) AS rank FROM g""")
def pcs_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sigma.with_error(component_marks(spark, sf_dir), "pcs_score")
    scored = sigma.with_pcs_sigma(own, sigma.pcs_bins(own), sigma.fallback(own))
    return sigma.ranked(sigma.summary(scored)).select("judge_id", "n_marks", "marking_score", "rank")


_FIT = _PCS + """, pb AS (SELECT discipline_type_id, pcs_type_id, round_even(pcs_control / 0.125, 0) * 0.125 AS control_bin, count(*) AS n_marks, avg(pcs_control) AS x, var_samp(pcs_error) AS variance FROM pcs GROUP BY ALL HAVING count(*) >= 10 AND var_samp(pcs_error) > 0),
s AS (SELECT discipline_type_id, pcs_type_id, count(*) AS n_bins, sum(n_marks * n_marks * (x - 5) ** 4) AS s4, sum(n_marks * n_marks * (x - 5) ** 3) AS s3, sum(n_marks * n_marks * (x - 5) ** 2) AS s2, sum(n_marks * n_marks * (x - 5)) AS s1, sum(CAST(n_marks * n_marks AS DOUBLE)) AS s0,
    sum(n_marks * n_marks * (x - 5) ** 2 * variance) AS t2, sum(n_marks * n_marks * (x - 5) * variance) AS t1, sum(n_marks * n_marks * variance) AS t0 FROM pb GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det, t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS da,
    s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS db, s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2) AS dc FROM s),
fit AS (SELECT discipline_type_id, pcs_type_id, n_bins, da / det AS a, db / det - 10 * (da / det) AS b, dc / det - 5 * (db / det) + 25 * (da / det) AS c FROM k WHERE det <> 0)"""


@query(_FIT + "SELECT discipline_type_id, pcs_type_id, n_bins, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(c, 4) + 0.0 AS c FROM fit")
def pcs_quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sigma.with_error(component_marks(spark, sf_dir), "pcs_score")
    fit = sigma.quadratics(sigma.pcs_bins(own, 0.125))
    return fit.withColumns({k: rounded(F.col(k), 4) for k in "abc"})


@query(_FIT + """, d AS (SELECT greatest(0.05, coalesce(stddev_samp(pcs_error), 0)) AS fallback FROM pcs),
h AS (SELECT pcs.*, CASE WHEN a IS NOT NULL THEN sqrt(greatest(0.0025, a * pcs_control * pcs_control + b * pcs_control + c)) ELSE fallback END AS s FROM pcs CROSS JOIN d LEFT JOIN fit USING (discipline_type_id, pcs_type_id))
SELECT judge_id, count(*) AS n_marks, round(sqrt(avg((pcs_error / s) ** 2)), 4) AS marking_score FROM h GROUP BY judge_id""")
def pcs_quadratic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sigma.with_error(component_marks(spark, sf_dir), "pcs_score")
    scored = sigma.with_quadratic_sigma(own, sigma.quadratics(sigma.pcs_bins(own, 0.125)), sigma.fallback(own))
    return sigma.finished(sigma.partial_summary(scored), digits=4).select("judge_id", "n_marks", "marking_score")


@query(_ERR + """, a AS (SELECT judge_id, marking_score AS s, CAST(rank() OVER (ORDER BY marking_score) AS DOUBLE) AS r FROM summary),
b0 AS (SELECT judge_id, round(sqrt(avg((error / fallback) ** 2)), 6) AS s FROM m GROUP BY judge_id), b AS (SELECT judge_id, s, CAST(rank() OVER (ORDER BY s) AS DOUBLE) AS r FROM b0)
SELECT count(*) AS n_judges, round(corr(a.s, b.s), 4) AS pearson, round(corr(a.r, b.r), 4) AS spearman, round(avg(abs(a.s - b.s)), 4) AS mean_gap, round(max(abs(a.s - b.s)), 4) AS max_gap FROM a JOIN b USING (judge_id)""")
def sigma_pool_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted bins against one spread for all marks."""
    own = scored_marks(spark, sf_dir)
    flat = own.withColumn("sigma_hat", sigma.fallback(own)).withColumn("m", F.col("error") / F.col("sigma_hat"))
    return sigma.compared(sigma.summary(own), sigma.summary(flat))


# W3

_PROFILE = _PCS + """, line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY judge_id, discipline_type_id, pcs_type_id, segment_id, skater_segment_id ORDER BY element_id) AS rn FROM pcs) WHERE rn = 1),
ranks AS (SELECT *, rank() OVER (PARTITION BY judge_id, discipline_type_id, pcs_type_id, segment_id ORDER BY pcs_score) + (count(*) OVER (PARTITION BY judge_id, discipline_type_id, pcs_type_id, segment_id, pcs_score) - 1) / 2.0 AS rj,
    rank() OVER (PARTITION BY judge_id, discipline_type_id, pcs_type_id, segment_id ORDER BY pcs_control) + (count(*) OVER (PARTITION BY judge_id, discipline_type_id, pcs_type_id, segment_id, pcs_control) - 1) / 2.0 AS rp FROM line),
rho AS (SELECT judge_id, discipline_type_id, pcs_type_id, segment_id, corr(rj, rp) AS rho FROM ranks GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(rj) > 0 AND stddev_pop(rp) > 0),
score AS (SELECT judge_id, discipline_type_id, pcs_type_id, avg(greatest(0, least(1, (rho - 0.7) / (1 - 0.7)))) AS ranking_score FROM rho GROUP BY ALL),
sums AS (SELECT judge_id, discipline_type_id, pcs_type_id, count(*) AS n_marks, avg(pcs_error) AS bias, CASE WHEN count(*) > 1 THEN greatest(0, sum(pcs_score * pcs_score) - sum(pcs_score) ** 2 / count(*)) / (count(*) - 1) END AS vj,
    CASE WHEN count(*) > 1 THEN greatest(0, sum(pcs_control * pcs_control) - sum(pcs_control) ** 2 / count(*)) / (count(*) - 1) END AS vp FROM pcs GROUP BY ALL),
comp AS (SELECT judge_id, discipline_type_id, pcs_type_id, n_marks, round(coalesce(ranking_score, 0), 6) + 0.0 AS ranking_score, round(bias, 6) + 0.0 AS bias, round(greatest(0, least(1, 1 - abs(bias) / 0.5)), 6) + 0.0 AS bias_score,
    round(CASE WHEN vp > 0 THEN vj / vp END, 6) + 0.0 AS variance_ratio, round(CASE WHEN vp > 0 AND vj > 0 THEN greatest(0, least(1, 1 - abs(ln(vj / vp)))) END, 6) + 0.0 AS diff_score FROM sums LEFT JOIN score USING (judge_id, discipline_type_id, pcs_type_id))"""


@query(_PROFILE + "SELECT * FROM comp")
def component_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.component_profiles(component_marks(spark, sf_dir))


@query(_PROFILE + """, disc AS (SELECT judge_id, discipline_type_id, sum(n_marks) AS n, avg(ranking_score) AS r, avg(bias_score) AS bs, avg(diff_score) AS ds, CASE WHEN count(bias) = count(*) THEN sum(bias * n_marks) / sum(n_marks) END AS b, CASE WHEN count(variance_ratio) = count(*) THEN sum(variance_ratio * n_marks) / sum(n_marks) END AS v FROM comp GROUP BY ALL),
j AS (SELECT judge_id, CAST(sum(n) AS BIGINT) AS n_marks, round(sum(r * n) / sum(n) FILTER (r IS NOT NULL), 4) + 0.0 AS ranking_score, round(sum(bs * n) / sum(n) FILTER (bs IS NOT NULL), 4) + 0.0 AS bias_score, round(sum(ds * n) / sum(n) FILTER (ds IS NOT NULL), 4) + 0.0 AS diff_score,
    round(CASE WHEN count(b) = count(*) THEN sum(b * n) / sum(n) END, 4) + 0.0 AS bias, round(CASE WHEN count(v) = count(*) THEN sum(v * n) / sum(n) END, 4) + 0.0 AS variance_ratio FROM disc GROUP BY judge_id)
SELECT *, CASE WHEN bias > 0.05 THEN 'high' WHEN bias < -0.05 THEN 'low' ELSE 'neutral' END AS bias_tendency, CASE WHEN variance_ratio > 1.1 THEN 'wider' WHEN variance_ratio < 0.9 THEN 'narrower' WHEN variance_ratio IS NOT NULL THEN 'similar' END AS spread_tendency FROM j""")
def judge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.judge_profiles(profiles.component_profiles(component_marks(spark, sf_dir)))


# Identity

_LINKS = """WITH RECURSIVE links AS (SELECT s_suppkey AS judge_id, 'u' || (s_nationkey * 3 + s_suppkey % 3) AS official FROM supplier UNION ALL SELECT s_suppkey, 'i' || (s_suppkey % 40) FROM supplier WHERE s_suppkey % 2 = 0),
edges AS (SELECT DISTINCT a.judge_id AS x, b.judge_id AS y FROM links a JOIN links b USING (official)), reach AS (SELECT DISTINCT judge_id AS x, judge_id AS y FROM links UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
"""


@query(_LINKS + "SELECT x AS judge_id, min(y) AS identity FROM reach GROUP BY x")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identities(judge_links(spark, sf_dir))


@query(MARKS_SQL.replace("WITH kept", _LINKS.rstrip() + ", kept", 1) + f""", ids AS (SELECT x AS judge_id, min(y) AS identity FROM reach GROUP BY x), f AS (SELECT judge_id, {_FIVE} FROM panel GROUP BY judge_id)
SELECT identity, CAST(sum(n_marks) AS BIGINT) AS n_marks, CAST(sum(n_thrown) AS BIGINT) AS n_thrown, CAST(sum(n_anomalies) AS BIGINT) AS n_anomalies, CAST(sum(n_rule_errors) AS BIGINT) AS n_rule_errors, round(sum(avg_deviation * n_marks) / sum(n_marks), 4) + 0.0 AS avg_deviation FROM f JOIN ids USING (judge_id) GROUP BY identity""")
def merged_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.merged(rates.five_measures(panel_marks(spark, sf_dir), ["judge_id"]), identity.identities(judge_links(spark, sf_dir)))


@query(MARKS_SQL + """, c AS (SELECT judge_id, count(*) AS n_marks FROM marks GROUP BY ALL), j AS (SELECT s_suppkey AS judge_id, 'nation ' || s_nationkey AS name_key, coalesce(n_marks, 0) AS n FROM supplier LEFT JOIN c ON s_suppkey = judge_id)
SELECT judge_id, name_key, first_value(judge_id) OVER (PARTITION BY name_key ORDER BY n DESC, judge_id) AS canonical_id, count(*) OVER (PARTITION BY name_key) AS group_size FROM j""")
def canonical_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = judges(spark, sf_dir).select("judge_id", identity.name_key(F.concat(F.lit("Mr. Nation, "), F.col("nation_id").cast("string"))).alias("name_key"))
    return identity.canonical(own, marks(spark, sf_dir).groupBy("judge_id").agg(F.count(F.lit(1)).alias("n_marks")))


# W4: a customer is an official, an order is service, the segment of the market is the event


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    return orders.select(
        F.col("o_custkey").alias("official_id"), year.alias("year"), (year - (F.month("o_orderdate") < 7).cast("int")).alias("season_code"), (F.col("o_orderkey") % 400).alias("competition_id"),
        (F.col("o_orderkey") % 1600).alias("segment_id"), (F.col("o_orderkey") % 400 % 17 + 1).cast("int").alias("competition_type_id"), (F.col("o_orderstatus") == "P").alias("international"),
        (F.col("o_orderkey") % 400 % 3 > 0).alias("qualifying"), (F.col("o_orderkey") % 400 % 5 == 0).alias("nqs"), F.col("c_mktsegment").alias("scope"),
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("official_id"), (1994 + F.col("c_custkey") % 6).cast("int").alias("achieved_year"), (1 + F.col("c_custkey") % 3).cast("int").alias("appointment_type_id"), (1994 + F.col("c_custkey") % 6).cast("int").alias("achieved_season"))


_SERVICE = """WITH service AS (
    SELECT o_custkey AS official_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INTEGER) AS season_code, o_orderkey % 400 AS competition_id, o_orderkey % 1600 AS segment_id,
        CAST(o_orderkey % 400 % 17 + 1 AS INTEGER) AS competition_type_id, o_orderstatus = 'P' AS international, o_orderkey % 400 % 3 > 0 AS qualifying, o_orderkey % 400 % 5 = 0 AS nqs, c_mktsegment AS scope
    FROM orders JOIN customer ON o_custkey = c_custkey
), appointments AS (SELECT c_custkey AS official_id, CAST(1994 + c_custkey % 6 AS INTEGER) AS achieved_year, CAST(1 + c_custkey % 3 AS INTEGER) AS appointment_type_id FROM customer)
"""
YEARS = (1998, 1999, 2000)


@query(_SERVICE + """, n AS (SELECT official_id, year, count(DISTINCT competition_id) AS n FROM service GROUP BY ALL)
SELECT official_id, achieved_year, coalesce(max(n) FILTER (year = 1998), 0) AS y1998, coalesce(max(n) FILTER (year = 1999), 0) AS y1999, coalesce(max(n) FILTER (year = 2000), 0) AS y2000, count(*) FILTER (year > achieved_year) AS years_served,
    2001 - achieved_year AS years_in_grade, greatest(0, 2001 - greatest(1995, achieved_year + 1) + 1) AS eligible_years FROM appointments LEFT JOIN n USING (official_id) GROUP BY official_id, achieved_year""")
def activity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.matrix(service(spark, sf_dir), appointments(spark, sf_dir), YEARS, 2001, 1995)


_BUCKET = "CASE WHEN international THEN 'international' WHEN qualifying AND competition_type_id IN (4, 8) THEN 'championships' WHEN qualifying AND competition_type_id IN (1, 2, 3, 5, 6, 7, 9) THEN 'sectionals' WHEN nqs THEN 'nqs' WHEN NOT qualifying THEN 'non_qualifying' ELSE 'other' END"


@query(_SERVICE + f""", one AS (SELECT DISTINCT official_id, season_code, competition_id, segment_id, bool_or(international) OVER (PARTITION BY official_id, season_code, competition_id, segment_id) AS i, qualifying, nqs, competition_type_id FROM service),
b AS (SELECT official_id, season_code, competition_id, {_BUCKET.replace("international THEN", "i THEN")} AS bucket FROM one)
SELECT official_id, season_code, bucket, count(*) AS n_segments, count(DISTINCT competition_id) AS n_competitions FROM b GROUP BY GROUPING SETS ((official_id, season_code, bucket), (official_id, season_code), (official_id))""")
def total_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = service(spark, sf_dir)
    keys = ["official_id", "season_code", "competition_id", "segment_id", "qualifying", "nqs", "competition_type_id"]
    one = own.groupBy(*keys).agg(F.bool_or("international").alias("international"))
    return activity.total_activity(one).drop("grouping")


@query(_SERVICE + "SELECT official_id, " + ", ".join(f"count(DISTINCT competition_id) FILTER (season_code = {y}) AS s{y}" for y in YEARS) + " FROM service GROUP BY official_id")
def nqs_season_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.season_pivot(service(spark, sf_dir), YEARS)


@query(_SERVICE + "SELECT official_id, count(DISTINCT competition_id) AS n_competitions, count(DISTINCT competition_id) FILTER (international) AS n_international FROM service GROUP BY official_id")
def segment_competition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.segment_counts(service(spark, sf_dir))


@query(_SERVICE + """, y AS (SELECT official_id, count(DISTINCT year) AS n, array_to_string(list_sort(list(DISTINCT year)), ', ') AS years FROM service WHERE year > 1997 AND year <= 2001 GROUP BY ALL)
SELECT official_id, achieved_year, CAST(coalesce(n, 0) AS INTEGER) AS n_years, coalesce(years, '') AS years, round(coalesce(n, 0) / greatest(1, least(4, greatest(0, 2001 - achieved_year))), 3) AS normalised FROM appointments LEFT JOIN y USING (official_id)""")
def referee_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.referee_report(service(spark, sf_dir), appointments(spark, sf_dir), 2001, 4)


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, linked) AS official_id, o_orderpriority AS name_key FROM orders
LEFT JOIN (SELECT 'n' || c_nationkey AS name_key, min(c_custkey) AS linked FROM customer GROUP BY ALL) l ON l.name_key = 'n' || (o_orderkey % 30)""".replace("o_orderpriority AS name_key", "'n' || (o_orderkey % 30) AS name_key"))
def lateral_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("official_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")).alias("name_key"))
    links = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name_key"), F.col("c_custkey").alias("official_id"))
    return activity.attributed(rows, links).select("o_orderkey", "official_id", "name_key")


@query("""WITH f AS (SELECT user_id AS member, max(ts) AS stamp FROM events GROUP BY ALL), w AS (SELECT DISTINCT user_id AS member, CASE WHEN event_type = 'view' THEN ' Available ' WHEN event_type = 'click' THEN 'No' WHEN event_type = 'error' THEN '' WHEN event_type = 'signup' THEN 'maybe' ELSE 'does not apply' END AS a, event_type AS b FROM events JOIN f ON user_id = member AND ts = stamp)
SELECT member, prompt, raw, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'no_reply' WHEN regexp_matches(lower(raw), 'does not apply|n/a') THEN 'not_applicable' WHEN regexp_matches(lower(trim(raw)), 'not available|unavailable|^no\\b') THEN 'unavailable' WHEN regexp_matches(lower(raw), 'maybe|if needed') THEN 'if_needed' WHEN regexp_matches(lower(trim(raw)), 'available|^yes\\b') THEN 'available' ELSE 'other' END AS code
FROM w UNPIVOT (raw FOR prompt IN (a, b))""")
def availability_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    answer = F.when(kind == "view", " Available ").when(kind == "click", "No").when(kind == "error", "").when(kind == "signup", "maybe").otherwise("does not apply")
    forms = table(spark, sf_dir, "events").select(F.col("user_id").alias("member"), F.col("ts").alias("stamp"), answer.alias("a"), kind.alias("b"))
    return activity.availability(forms, ["a", "b"])


@query("SELECT bin, n, round(100.0 * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 2) AS running FROM (SELECT CAST(CASE WHEN p_size >= 45 THEN 45 ELSE 45 - ceil((45 - p_size) / 5.0) * 5 END AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1)")
def age_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.tenure_bins(table(spark, sf_dir, "part"), "p_size", 5, 45)


# W5

RULES = [
    (1, "maintain", 1, "competitions", 3, 3, '{"scope": "BUILDING"}'), (1, "maintain", 1, "years_in_grade", 2, 0, "{}"), (2, "promote", 2, "years_in_grade", 4, 0, "{}"),
    (2, "promote", 2, "competitions", 4, 4, "{}"),
    (3, "promote", 3, "alternatives", 0, 4, '{"alternatives": [{"label": "x", "requirements": [{"scope": "MACHINERY", "min": 6}]}, {"label": "y", "requirements": [{"scope": "BUILDING", "min": 2}, {"scope": "BUILDING", "min": 3}]}]}'),
]
_RULES = _SERVICE + """, n AS (SELECT official_id, scope, count(DISTINCT competition_id) FILTER (season_code > 1997) AS n3, count(DISTINCT competition_id) FILTER (season_code > 1996) AS n4 FROM service WHERE season_code <= 2000 GROUP BY ALL),
t AS (SELECT official_id, count(DISTINCT competition_id) FILTER (season_code > 1996 AND season_code <= 2000) AS n4 FROM service GROUP BY ALL),
x AS (SELECT a.*, achieved_year AS y, coalesce(b.n3, 0) AS b3, coalesce(b.n4, 0) AS b4, coalesce(m.n4, 0) AS m4, coalesce(t.n4, 0) AS t4 FROM appointments a LEFT JOIN n b ON a.official_id = b.official_id AND b.scope = 'BUILDING' LEFT JOIN n m ON a.official_id = m.official_id AND m.scope = 'MACHINERY' LEFT JOIN t ON a.official_id = t.official_id),
r AS (SELECT official_id, 1 AS rule_set_id, 'maintain' AS purpose, 'competitions' AS metric, CAST(b3 AS INTEGER) AS actual, b3 >= 3 AS met FROM x WHERE appointment_type_id = 1
UNION ALL SELECT official_id, 1, 'maintain', 'years_in_grade', 2000 - y, 2000 - y >= 2 FROM x WHERE appointment_type_id = 1 UNION ALL SELECT official_id, 2, 'promote', 'years_in_grade', 2000 - y, 2000 - y >= 4 FROM x WHERE appointment_type_id = 2
UNION ALL SELECT official_id, 2, 'promote', 'competitions', CAST(t4 AS INTEGER), t4 >= 4 FROM x WHERE appointment_type_id = 2
UNION ALL SELECT official_id, 3, 'promote', 'alternatives', CAST(greatest(m4, 2 * b4) AS INTEGER), m4 >= 6 OR b4 >= 3 FROM x WHERE appointment_type_id = 3)
"""


@query(_RULES + "SELECT official_id, rule_set_id, metric, actual, met FROM r")
def requirement_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules.parsed(spark.createDataFrame(RULES, rules.RULE))
    return rules.evaluated(own, appointments(spark, sf_dir), service(spark, sf_dir), 2000).select("official_id", "rule_set_id", "metric", "actual", "met")


@query(_RULES + "SELECT official_id, rule_set_id, purpose, bool_and(met) AS met, count(*) AS n_rules, count(*) FILTER (met) AS n_met FROM r GROUP BY ALL")
def requirement_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules.parsed(spark.createDataFrame(RULES, rules.RULE))
    return rules.sets_met(rules.evaluated(own, appointments(spark, sf_dir), service(spark, sf_dir), 2000))


@query(_SERVICE + "SELECT official_id, CAST(appointment_type_id AS INTEGER) AS rule_set_id, achieved_year + CASE WHEN appointment_type_id = 1 THEN 2 ELSE 4 END AS first_season FROM appointments WHERE appointment_type_id IN (1, 2)")
def promote_first_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_season(spark.createDataFrame(RULES, rules.RULE), appointments(spark, sf_dir))
