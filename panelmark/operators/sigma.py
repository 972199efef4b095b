"""W2: deviations in units of the spread expected for a mark. Marks carry control_score, the panel's median."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.scoring import component_bin, control_bin, quadratic_sigma, rounded

ELEMENT_MIN, PCS_MIN, FLOOR = 30, 10, 0.05
#: Bins that are looked up in turn.
PROBES = (0, -1, 1, -2, 2)


def with_error(marks: DataFrame, score: str = "judge_score") -> DataFrame:
    return marks.withColumn("error", F.col(score) - F.col("control_score"))


def element_bins(marks: DataFrame, least: int = ELEMENT_MIN) -> DataFrame:
    """sigma by discipline, element type and control bin, of bins with enough marks and some spread."""
    own = marks.groupBy("discipline_type_id", "element_type_id", control_bin(F.col("control_score")).alias("control_bin"))
    return own.agg(F.count("error").alias("n_marks"), F.stddev_samp("error").alias("sigma")).where((F.col("n_marks") >= least) & (F.col("sigma") > 0))


def fallback(marks: DataFrame) -> Column:
    """What a mark without a bin gets: the errors' spread over the whole scope, the floor if it has none; a scalar of the plan."""
    return marks.agg(F.greatest(F.lit(FLOOR), F.coalesce(F.stddev_samp("error"), F.lit(0.0)))).scalar()


def with_sigma(marks: DataFrame, bins: DataFrame, default: Column) -> DataFrame:
    """Adds sigma_hat, its source and m = error / sigma_hat. Lookup: own bin, then -1, +1, -2, +2, then the default.

    All five probes are one equi-join: bins are spread to the bins that may ask for them and the nearest wins.
    """
    order = {d: i for i, d in enumerate(PROBES)}
    asked = F.explode(F.array(*[F.struct((F.col("control_bin") - d).alias("control_bin"), F.lit(order[d]).alias("place")) for d in PROBES]))
    spread = bins.select("discipline_type_id", "element_type_id", "sigma", asked.alias("a")).select("discipline_type_id", "element_type_id", "a.*", "sigma")
    best = spread.groupBy("discipline_type_id", "element_type_id", "control_bin").agg(F.min(F.struct("place", "sigma")).alias("b"))
    best = best.select(F.col("discipline_type_id").alias("d"), F.col("element_type_id").alias("t"), F.col("control_bin").alias("c"), F.col("b.place").alias("place"), F.col("b.sigma").alias("found"))
    own = marks.withColumn("control_bin", control_bin(F.col("control_score")))
    joined = own.join(F.broadcast(best), (F.col("discipline_type_id") == F.col("d")) & (F.col("element_type_id") == F.col("t")) & (F.col("control_bin") == F.col("c")), "left")  # disciplines x types x bins of a bounded score
    source = F.when(F.col("place") == 0, "fitted").when(F.col("place") > 0, "neighbor").otherwise("fallback")
    hat = F.greatest(F.lit(FLOOR), F.coalesce("found", default))
    return joined.withColumns({"sigma_source": source, "sigma_hat": hat}).withColumn("m", F.col("error") / F.col("sigma_hat")).drop("d", "t", "c", "place", "found")


def partial_summary(marks: DataFrame, keys: Sequence[str] = ("judge_id",)) -> DataFrame:
    """Sums that merge by adding."""
    return marks.groupBy(*keys).agg(
        F.count("m").alias("n_marks"), F.sum(F.col("m") * F.col("m")).alias("sum_m2"), F.sum("error").alias("sum_error"), F.sum(F.abs("error")).alias("sum_abs_error"),
        F.sum("sigma_hat").alias("sum_sigma"), F.sum(F.abs("m")).alias("sum_abs_m"),
    )


def finished(parts: DataFrame, keys: Sequence[str] = ("judge_id",), digits: int = 6) -> DataFrame:
    """Partial summaries merged: marking score sqrt(mean m^2) and means."""
    n = F.sum("n_marks")
    mean = lambda c: rounded(F.sum(c) / n, digits)
    return parts.groupBy(*keys).agg(
        n.alias("n_marks"), rounded(F.sqrt(F.sum("sum_m2") / n), digits).alias("marking_score"), mean("sum_error").alias("mean_error"), mean("sum_abs_error").alias("mean_abs_error"),
        mean("sum_sigma").alias("mean_sigma_hat"), mean("sum_abs_m").alias("mean_abs_m"),
    )


def summary(marks: DataFrame, keys: Sequence[str] = ("judge_id",)) -> DataFrame:
    return finished(partial_summary(marks, keys), keys)


def ranked(summaries: DataFrame, least: int = 0, by: str = "marking_score", tie: str = "judge_id") -> DataFrame:
    """Those with enough marks, ranked 1..n from the lowest score; the rows are judges, few enough to be sorted by one task."""
    return summaries.where(F.col("n_marks") >= least).withColumn("rank", F.row_number().over(Window.orderBy(by, tie)).cast("long"))


def tiers(rankings: DataFrame) -> DataFrame:
    """Tier by rank: the top 30 and the bottom 10 percent (both rounded up), the middle in two halves, the odd one high."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    top, bottom = F.ceil(n * F.lit(0.30)), F.ceil(n * F.lit(0.10))
    half = F.ceil((n - top - bottom) / 2)
    r = F.col("rank")
    return rankings.withColumn("tier", F.when(r <= top, "top").when(r > n - bottom, "bottom").when(r <= top + half, "middle_high").otherwise("middle_low"))


def pcs_bins(marks: DataFrame, width: float = 0.25, least: int = PCS_MIN) -> DataFrame:
    """Mean control, sample variance and count of errors by discipline, component and control bin."""
    own = marks.groupBy("discipline_type_id", "pcs_type_id", component_bin(F.col("control_score"), width).alias("control_bin"))
    return own.agg(F.count("error").alias("n_marks"), F.avg("control_score").alias("x"), F.var_samp("error").alias("variance")).where((F.col("n_marks") >= least) & (F.col("variance") > 0))


def quadratics(bins: DataFrame, least_bins: int = 4) -> DataFrame:
    """Variance as a quadratic of control by discipline and component, least squares with squared counts as weights.

    The normal equations' sums are built-in aggregates; Cramer's rule solves them as an expression.
    """
    w = F.col("n_marks").cast("double") * F.col("n_marks")
    x = F.col("x") - 5.0  # about the middle, so that sums stay small
    s = [F.sum(w * F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(5)]
    t = [F.sum(w * F.pow(x, F.lit(float(k))) * F.col("variance")).alias(f"t{k}") for k in range(3)]
    own = bins.groupBy("discipline_type_id", "pcs_type_id").agg(F.count(F.lit(1)).alias("n_bins"), *s, *t).where(F.col("n_bins") >= least_bins)

    def det(m: list[list[str]]) -> Column:
        c = lambda i, j: F.col(m[i][j])
        return c(0, 0) * (c(1, 1) * c(2, 2) - c(1, 2) * c(2, 1)) - c(0, 1) * (c(1, 0) * c(2, 2) - c(1, 2) * c(2, 0)) + c(0, 2) * (c(1, 0) * c(2, 1) - c(1, 1) * c(2, 0))

    base = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]]
    right = ["t2", "t1", "t0"]
    swapped = lambda k: [[right[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]
    a, b, c = (det(swapped(k)) / det(base) for k in range(3))
    own = own.where(det(base) != 0).withColumns({"a": a, "b0": b, "c0": c})
    return own.select("discipline_type_id", "pcs_type_id", "n_bins", "a", (F.col("b0") - 10.0 * F.col("a")).alias("b"), (F.col("c0") - 5.0 * F.col("b0") + 25.0 * F.col("a")).alias("c"))


def with_pcs_sigma(marks: DataFrame, bins: DataFrame, default: Column, width: float = 0.25) -> DataFrame:
    """The discrete model: a bin's own spread, else the default."""
    own = marks.withColumn("control_bin", component_bin(F.col("control_score"), width))
    found = bins.select("discipline_type_id", "pcs_type_id", "control_bin", F.sqrt("variance").alias("found"))
    joined = own.join(F.broadcast(found), ["discipline_type_id", "pcs_type_id", "control_bin"], "left")  # bins of a bounded score
    return joined.withColumn("sigma_hat", F.greatest(F.lit(FLOOR), F.coalesce("found", default))).withColumn("m", F.col("error") / F.col("sigma_hat")).drop("found")


def with_quadratic_sigma(marks: DataFrame, fits: DataFrame, default: Column) -> DataFrame:
    joined = marks.join(F.broadcast(fits.drop("n_bins")), ["discipline_type_id", "pcs_type_id"], "left")  # a row a discipline and component
    hat = F.when(F.col("a").isNotNull(), quadratic_sigma(F.col("control_score"), F.col("a"), F.col("b"), F.col("c"), FLOOR)).otherwise(F.greatest(F.lit(FLOOR), default))
    return joined.withColumn("sigma_hat", hat).withColumn("m", F.col("error") / F.col("sigma_hat")).drop("a", "b", "c")


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two rankings of the same judges: Pearson's r of scores, Spearman's of ranks, tier matches, mean and greatest score difference."""
    rank = lambda d, p: d.select("judge_id", F.col("marking_score").alias(f"{p}_score"), F.rank().over(Window.orderBy("marking_score")).cast("double").alias(f"{p}_rank"))
    both = rank(one, "a").join(rank(other, "b"), "judge_id")
    gap = F.abs(F.col("a_score") - F.col("b_score"))
    return both.agg(
        F.count(F.lit(1)).alias("n_judges"), rounded(F.corr("a_score", "b_score"), 4).alias("pearson"), rounded(F.corr("a_rank", "b_rank"), 4).alias("spearman"),
        rounded(F.avg(gap), 4).alias("mean_gap"), rounded(F.max(gap), 4).alias("max_gap"),
    )


def fingerprint(marks: DataFrame, score: str = "judge_score") -> DataFrame:
    """One row: SHA-256 of count, greatest element, distinct competitions and the sum of scores in hundredths."""
    sums = marks.agg(F.count(F.lit(1)).alias("n"), F.max("element_id").alias("top"), F.countDistinct("competition_id").alias("k"), F.sum(F.round(F.col(score) * 100).cast("long")).alias("s"))
    return sums.select(F.sha2(F.concat_ws(":", "n", "top", "k", "s"), 256).alias("fingerprint"))


def described(frame: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, quartiles (exact) and extremes."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = frame.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), q.alias("q"))
    return own.select("n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")], *[rounded(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def takeaways(rankings: DataFrame, least: int, n: int = 3) -> DataFrame:
    """Text of the n best and the n worst judges with enough marks; with too few marks everywhere, of all."""
    enough = F.sum((F.col("n_marks") >= least).cast("int")).over(Window.partitionBy())
    own = rankings.where((F.col("n_marks") >= least) | F.lit(False)) if least <= 0 else rankings.withColumn("enough", enough).where((F.col("n_marks") >= least) | (F.col("enough") == 0)).drop("enough")
    place = own.withColumn("best", F.row_number().over(Window.orderBy("marking_score", "judge_id"))).withColumn("worst", F.row_number().over(Window.orderBy(F.desc("marking_score"), "judge_id")))
    text = F.format_string("judge %d: score %.3f over %d marks", "judge_id", "marking_score", "n_marks")
    return place.where((F.col("best") <= n) | (F.col("worst") <= n)).select("judge_id", F.when(F.col("best") <= n, "best").otherwise("worst").alias("side"), text.alias("takeaway"))


def pandas_view(rows: DataFrame) -> pd.DataFrame:
    """A ranking, one row a judge, for a report on the driver."""
    return rows.orderBy("rank").toPandas()
