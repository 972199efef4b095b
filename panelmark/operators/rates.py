"""W1: rates, heatmaps, benchmarks, excess, trends. Marks carry the panel columns of scoring.with_panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.scoring import ELEMENT_ANOMALY, PCS_ANOMALY, allowed_anomalies, half_up, is_anomaly, rounded, settled

METRICS = ("throwout_rate", "anomaly_rate", "rule_errors", "avg_deviation")


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def five_measures(marks: DataFrame, keys: Sequence[str], anomaly: float = ELEMENT_ANOMALY) -> DataFrame:
    """By keys: marks, throw-outs, anomalies, rule errors and the signed mean deviation."""
    return marks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_marks"), _sum(F.col("thrown_out")).alias("n_thrown"), _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), anomaly)).alias("n_anomalies"),
        _sum(F.col("is_rule_error")).alias("n_rule_errors"), rounded(F.avg("deviation")).alias("avg_deviation"),
    )


def shards(marks: DataFrame, anomaly: float = ELEMENT_ANOMALY) -> DataFrame:
    """Partial aggregates by competition, discipline and judge; sums stay doubles and a null discipline stays a key."""
    return marks.groupBy("competition_id", "discipline_type_id", "judge_id").agg(
        F.count(F.lit(1)).alias("n_marks"), _sum(F.col("thrown_out")).alias("n_thrown"), _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), anomaly)).alias("n_anomalies"),
        _sum(F.col("is_rule_error")).alias("n_rule_errors"), rounded(F.sum("deviation")).alias("sum_deviation"), rounded(F.sum(F.abs("deviation"))).alias("sum_abs_deviation"),
    )


def from_shards(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The five measures again from shards."""
    return parts.groupBy(*keys).agg(
        F.sum("n_marks").alias("n_marks"), F.sum("n_thrown").alias("n_thrown"), F.sum("n_anomalies").alias("n_anomalies"), F.sum("n_rule_errors").alias("n_rule_errors"),
        rounded(F.sum("sum_deviation") / F.sum("n_marks"), 4).alias("avg_deviation"),
    )


def heatmap(measures: DataFrame, metric: str) -> DataFrame:
    """measures with `value`; rates are percentages of two digits, zero counts of rule errors are left out."""
    value = {
        "throwout_rate": F.round(100.0 * F.col("n_thrown") / F.col("n_marks"), 2), "anomaly_rate": F.round(100.0 * F.col("n_anomalies") / F.col("n_marks"), 2),
        "rule_errors": F.col("n_rule_errors").cast("double"), "avg_deviation": rounded(F.abs("avg_deviation"), 4),
    }[metric]
    out = measures.where("n_marks > 0").withColumn("metric", F.lit(metric)).withColumn("value", value)
    return out.where("value <> 0") if metric == "rule_errors" else out


def merged(measures: DataFrame, identities: DataFrame) -> DataFrame:
    """measures by judge_id summed over identities (judge_id, identity); the signed average is weighted by marks."""
    own = measures.join(F.broadcast(identities), "judge_id", "left").withColumn("identity", F.coalesce("identity", "judge_id"))  # a row a judge
    return own.groupBy("identity").agg(
        F.sum("n_marks").alias("n_marks"), F.sum("n_thrown").alias("n_thrown"), F.sum("n_anomalies").alias("n_anomalies"), F.sum("n_rule_errors").alias("n_rule_errors"),
        rounded(F.sum(F.col("avg_deviation") * F.col("n_marks")) / F.sum("n_marks"), 4).alias("avg_deviation"),
    )


def pooled(marks: DataFrame, anomaly: float = ELEMENT_ANOMALY) -> DataFrame:
    """Over all marks, each with equal weight; mean_abs_deviation is the mean of sizes, unlike the heatmap's size of the mean."""
    return marks.agg(
        F.count(F.lit(1)).alias("n_marks"), F.round(100.0 * _sum(F.col("thrown_out")) / F.count(F.lit(1)), 2).alias("throwout_rate"),
        F.round(100.0 * _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), anomaly)) / F.count(F.lit(1)), 2).alias("anomaly_rate"),
        _sum(F.col("is_rule_error")).alias("n_rule_errors"), F.round(F.avg(F.abs("deviation")), 4).alias("mean_abs_deviation"),
    )


def excess(marks: DataFrame, anomaly: float = ELEMENT_ANOMALY) -> DataFrame:
    """By judge: anomalies above what a segment's field allows, summed over the judge's segments in a competition."""
    fields = marks.groupBy("competition_id", "segment_id").agg(F.countDistinct("skater_segment_id").alias("entries"))
    own = marks.groupBy("competition_id", "segment_id", "judge_id").agg(_sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), anomaly)).alias("observed"))
    over = own.join(fields, ["competition_id", "segment_id"]).withColumn("over", F.greatest(F.lit(0), F.col("observed") - allowed_anomalies(F.col("entries"))))
    return over.groupBy("judge_id").agg(F.sum("observed").cast("long").alias("n_anomalies"), F.sum("over").cast("long").alias("n_excess"), F.count(F.lit(1)).alias("n_segments"))


def panel_benchmark(marks: DataFrame, anomaly: float = ELEMENT_ANOMALY) -> DataFrame:
    """By discipline and panel size 3 to 12: marks, throw-out and anomaly rates in percent with three digits."""
    own = marks.where("panel_size BETWEEN 3 AND 12").groupBy("discipline_type_id", "panel_size")
    return own.agg(
        F.count(F.lit(1)).alias("n_marks"), F.round(100.0 * _sum(F.col("thrown_out")) / F.count(F.lit(1)), 3).alias("throwout_rate"),
        F.round(100.0 * _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), anomaly)) / F.count(F.lit(1)), 3).alias("anomaly_rate"),
    )


def rule_error_list(elements: DataFrame, components: DataFrame) -> DataFrame:
    """Rule errors of both kinds of marks, columns that one kind lacks are null."""
    return elements.where("is_rule_error").withColumn("kind", F.lit("element")).unionByName(components.where("is_rule_error").withColumn("kind", F.lit("pcs")), allowMissingColumns=True)


def type_breakdown(judges: DataFrame, linked: DataFrame, key: str, label: str = "not linked") -> DataFrame:
    """Rows of `linked` (key, kind) counted by kind, and under label what judges has without a link."""
    own = judges.join(linked, key, "left")
    return own.groupBy(F.coalesce("kind", F.lit(label)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def yearly(marks: DataFrame, value: str = "deviation") -> DataFrame:
    return marks.groupBy("judge_id", "season_start").agg(settled(F.avg(F.abs(value)), 2).alias("value"), F.count(F.lit(1)).alias("n_marks"))


def overall_trend(years: DataFrame) -> DataFrame:
    """By season over judges: mean, median and population standard deviation of their yearly values."""
    return years.groupBy("season_start").agg(
        settled(F.avg("value"), 4).alias("mean"), rounded(F.percentile("value", F.lit(0.5)), 4).alias("median"), settled(F.stddev_pop("value"), 4).alias("std"), F.count(F.lit(1)).alias("n_judges")
    )


def consistency(years: DataFrame) -> DataFrame:
    """By judge: slope, correlation, trend (stable below a slope of 0.1) and the consistency score of yearly values."""
    spread = F.max("value") - F.min("value")
    own = years.groupBy("judge_id").agg(
        F.count("value").alias("n_years"), settled(F.regr_slope("value", "season_start"), 6).alias("slope"), F.var_pop("value").alias("var"), spread.alias("spread")
    )
    score = F.when(F.col("spread") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("var") / (F.col("spread") * F.col("spread") / 4) * 100))
    trend = F.when(F.col("n_years") < 2, "insufficient_data").when(F.abs("slope") < 0.1, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return own.select("judge_id", "n_years", F.when(F.col("n_years") >= 2, F.col("slope")).alias("slope"), trend.alias("trend"), F.when(F.col("n_years") >= 2, settled(score, 2)).alias("consistency"))


def significance(marks: DataFrame) -> DataFrame:
    """By judge: t statistic of deviations against 0, chi-square of throw-outs against 5 percent, share of |z| > 2.58."""
    z = Window.partitionBy("judge_id")
    own = marks.withColumn("z", F.abs((F.col("deviation") - F.avg("deviation").over(z)) / F.stddev_pop("deviation").over(z)))
    g = own.groupBy("judge_id").agg(F.count(F.lit(1)).alias("n"), F.avg("deviation").alias("m"), F.stddev_samp("deviation").alias("s"), _sum(F.col("thrown_out")).alias("k"), _sum(F.col("z") > 2.58).alias("o"))
    chi = F.pow(F.col("k") - 0.05 * F.col("n"), 2) / (0.05 * F.col("n")) + F.pow(0.05 * F.col("n") - F.col("k"), 2) / (0.95 * F.col("n"))
    return g.select("judge_id", "n", rounded(F.col("m") / (F.col("s") / F.sqrt("n")), 4).alias("t"), rounded(chi, 4).alias("chi2"), F.round(100.0 * F.col("o") / F.col("n"), 4).alias("outlier_rate"))


def appearances(elements: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (judge, competition) of either kind of marks."""
    return elements.select("judge_id", "competition_id").union(components.select("judge_id", "competition_id")).distinct()


def by_kind(elements: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys and score type (element, pcs, both): marks, throw-outs, anomalies, rule errors, the size of the mean deviation, excess anomalies.

    Of both kinds together the mean deviations' sizes are weighted by marks. A type without marks has no row.
    """

    def one(marks: DataFrame, least: float, name: str) -> DataFrame:
        own = marks.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_marks"), _sum(F.col("thrown_out")).alias("n_thrown"), _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), least)).alias("n_anomalies"),
            _sum(F.col("is_rule_error")).alias("n_rule_errors"), F.abs(F.avg("deviation")).alias("size"),
        )
        places = list(dict.fromkeys([*keys, "competition_id", "segment_id", "judge_id"]))
        fields = marks.groupBy("competition_id", "segment_id").agg(F.countDistinct("skater_segment_id").alias("entries"))
        seen = marks.groupBy(*places).agg(_sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), least)).alias("observed")).join(fields, ["competition_id", "segment_id"])
        over = seen.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("observed") - allowed_anomalies(F.col("entries")))).cast("long").alias("n_excess"))
        return own.join(over, list(keys)).withColumn("score_type", F.lit(name))

    two = one(elements, ELEMENT_ANOMALY, "element").unionByName(one(components, PCS_ANOMALY, "pcs"))
    sums = [F.sum(c).alias(c) for c in ("n_marks", "n_thrown", "n_anomalies", "n_rule_errors")]
    both = two.groupBy(*keys).agg(*sums, (F.sum(F.col("size") * F.col("n_marks")) / F.sum("n_marks")).alias("size"), F.sum("n_excess").alias("n_excess")).withColumn("score_type", F.lit("both"))
    return two.unionByName(both)


def heatmap_grid(kinds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """by_kind() as a row a key, score type and metric of six: rates in percent and counts; counts of nothing are left out."""
    share = lambda c: F.round(100.0 * F.col(c) / F.col("n_marks"), 2)
    values = {
        "throwout_rate": share("n_thrown"), "anomaly_rate": share("n_anomalies"), "rule_error_rate": share("n_rule_errors"), "rule_errors": F.nullif(F.col("n_rule_errors"), F.lit(0)).cast("double"),
        "excess_anomalies": F.nullif(F.col("n_excess"), F.lit(0)).cast("double"), "avg_deviation": half_up(F.col("size"), 4),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])
    return kinds.select(*keys, "score_type", "n_marks", F.inline(rows)).where("value IS NOT NULL")


def benchmark_by_kind(elements: DataFrame, components: DataFrame, bucket: Column) -> DataFrame:
    """By discipline bucket, panel size 3 to 12, score type and benchmark (throwout, anomaly): marks, hits and their rate in percent, three digits."""

    def one(marks: DataFrame, least: float, name: str) -> DataFrame:
        own = marks.where("panel_size BETWEEN 3 AND 12").withColumn("discipline", bucket).where("discipline IS NOT NULL").groupBy("discipline", "panel_size")
        hits = own.agg(F.count(F.lit(1)).alias("total_scores"), _sum(F.col("thrown_out")).alias("throwout"), _sum(is_anomaly(F.col("deviation"), F.col("is_rule_error"), least)).alias("anomaly"))
        return hits.select("discipline", "panel_size", F.lit(name).alias("score_type"), "total_scores", F.stack(F.lit(2), F.lit("throwout"), F.col("throwout"), F.lit("anomaly"), F.col("anomaly")).alias("benchmark", "hits"))

    two = one(elements, ELEMENT_ANOMALY, "Element").unionByName(one(components, PCS_ANOMALY, "PCS"))
    return two.withColumn("rate_pct", F.round(100.0 * F.col("hits") / F.col("total_scores"), 3))
