"""W3: profiles of component marks: rank correlation, bias and spread by judge. Marks carry control_score of their panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.scoring import clamp, rounded

LEAST_SKATERS, RHO_FROM, BIAS_FULL = 3, 0.7, 0.5
KEYS = ("judge_id", "discipline_type_id", "pcs_type_id")


def _mean_rank(column: str, keys: tuple[str, ...]):
    """The rank that ties share: the mean of their places."""
    low = F.rank().over(Window.partitionBy(*keys).orderBy(column))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2.0


def segment_correlations(marks: DataFrame) -> DataFrame:
    """Spearman's rho of a judge's marks and the panel medians by segment, of segments with enough skaters and some spread of both.

    Of several marks of an identity for one skater the one with the smallest element_id counts.
    """
    keys = (*KEYS, "segment_id")
    line = Window.partitionBy(*keys, "skater_segment_id").orderBy("element_id")
    own = marks.withColumn("rn", F.row_number().over(line)).where("rn = 1")
    own = own.withColumns({"rj": _mean_rank("pcs_score", keys), "rp": _mean_rank("control_score", keys)})
    g = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rj").alias("sj"), F.stddev_pop("rp").alias("sp"), F.covar_pop("rj", "rp").alias("c"))
    rho = F.try_divide(F.col("c"), F.col("sj") * F.col("sp"))  # corr() itself raises for groups without spread in ANSI mode
    return g.where((F.col("n") >= LEAST_SKATERS) & (F.col("sj") > 0) & (F.col("sp") > 0)).select(*keys, rho.alias("rho"))


def sums(marks: DataFrame) -> DataFrame:
    """Sums of marks and medians by judge, discipline and component; they merge by adding."""
    x, p = F.col("pcs_score"), F.col("control_score")
    return marks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_marks"), F.sum(x - p).alias("sd"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(p).alias("sp"), F.sum(p * p).alias("spp"))


def component_profiles(marks: DataFrame) -> DataFrame:
    """Ranking, bias and differentiation scores by judge, discipline and component."""
    rho = segment_correlations(marks).groupBy(*KEYS).agg(F.avg(clamp((F.col("rho") - RHO_FROM) / (1 - RHO_FROM))).alias("ranking_score"))
    n = F.col("n_marks")
    var = lambda s, ss: F.when(n > 1, F.greatest(F.lit(0.0), F.col(ss) - F.col(s) * F.col(s) / n) / (n - 1))
    own = sums(marks).join(rho, list(KEYS), "left").withColumns({"bias": F.col("sd") / n, "ratio": F.when(var("sp", "spp") > 0, var("sx", "sxx") / var("sp", "spp"))})
    return own.select(
        *KEYS, "n_marks", rounded(F.coalesce("ranking_score", F.lit(0.0))).alias("ranking_score"), rounded(F.col("bias")).alias("bias"),
        rounded(clamp(1 - F.abs("bias") / BIAS_FULL)).alias("bias_score"), rounded(F.col("ratio")).alias("variance_ratio"),
        rounded(F.when(F.col("ratio") > 0, clamp(1 - F.abs(F.log("ratio"))))).alias("diff_score"),
    )


def judge_profiles(components: DataFrame) -> DataFrame:
    """Disciplines are plain means of components (bias and ratio weighted by marks), judges means of disciplines weighted by marks.

    A component without a variance ratio leaves its judge without one, and without a tendency.
    """
    n = F.col("n_marks")
    weighed = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c) * n) / F.sum(n))
    by_discipline = components.groupBy("judge_id", "discipline_type_id").agg(
        F.sum("n_marks").alias("marks"), F.avg("ranking_score").alias("ranking_score"), F.avg("bias_score").alias("bias_score"), F.avg("diff_score").alias("diff_score"),
        weighed("bias").alias("bias"), weighed("variance_ratio").alias("variance_ratio"),
    ).withColumnRenamed("marks", "n_marks")
    mean = lambda c: rounded(F.sum(F.col(c) * n) / F.sum(F.when(F.col(c).isNotNull(), n)), 4)
    own = by_discipline.groupBy("judge_id").agg(
        F.sum("n_marks").alias("marks"), mean("ranking_score").alias("ranking_score"), mean("bias_score").alias("bias_score"), mean("diff_score").alias("diff_score"),
        rounded(weighed("bias"), 4).alias("bias"), rounded(weighed("variance_ratio"), 4).alias("variance_ratio"),
    ).withColumnRenamed("marks", "n_marks")
    bias = F.when(F.col("bias") > 0.05, "high").when(F.col("bias") < -0.05, "low").otherwise("neutral")
    spread = F.when(F.col("variance_ratio") > 1.1, "wider").when(F.col("variance_ratio") < 0.9, "narrower").when(F.col("variance_ratio").isNotNull(), "similar")
    return own.withColumns({"bias_tendency": bias, "spread_tendency": spread})
