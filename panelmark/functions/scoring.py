"""Column rules on marks: panels, thresholds, bins, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deviations from which a mark is an anomaly, inclusive.
ELEMENT_ANOMALY, PCS_ANOMALY = 2.0, 1.5


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def settled(x: Column, digits: int) -> Column:
    """Rounded from ten digits, ties away from zero: sums that err by the order of their rows round alike."""
    return rounded(F.round(x, 10), digits)


def half_up(x: Column, digits: int) -> Column:
    """A non-negative value to nine digits first, then rounded by whole numbers, ties up: sums that err by their order round alike."""
    unit = 10 ** (9 - digits)
    return F.floor((F.round(x * 1e9).cast("long") + unit // 2) / unit) / float(10**digits)


def with_panel(marks: DataFrame, score: str = "judge_score", panel: str = "element_id") -> DataFrame:
    """Adds panel_average, deviation, control_score (median), panel_size and thrown_out; null scores take no part.

    A mark is thrown out if it is the panel's least or greatest, unless three or more judges gave it.
    """
    own, x = Window.partitionBy(panel), F.col(score)
    equal = F.count(x).over(Window.partitionBy(panel, score))
    outer = (x == F.min(x).over(own)) | (x == F.max(x).over(own))
    return marks.withColumns({
        "panel_average": F.avg(x).over(own), "control_score": F.percentile(x, F.lit(0.5)).over(own), "panel_size": F.count(x).over(own),
        "thrown_out": F.coalesce(outer & (equal < 3), F.lit(False)),
    }).withColumn("deviation", x - F.col("panel_average"))


def is_anomaly(deviation: Column, rule_error: Column, least: float) -> Column:
    return (F.abs(deviation) >= least) | rule_error


def allowed_anomalies(entries: Column) -> Column:
    """1, 2 or 3 by field size."""
    return F.when(entries <= 10, 1).when(entries <= 20, 2).otherwise(3)


def control_bin(control: Column) -> Column:
    """Half-even."""
    return F.bround(control).cast("int")


def component_bin(control: Column, width: float) -> Column:
    """The nearest multiple of width, half-even."""
    return F.bround(control / width) * width


def legacy_bin(control: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(control + 0.75)).cast("int")


def bin_label(bin_: Column) -> Column:
    """Of a legacy bin: its lowest and highest median."""
    low = F.when(bin_ == 1, F.lit(0.25)).otherwise(bin_ - 0.75)
    return F.concat(F.format_number(low, 2), F.lit("–"), F.format_number(bin_.cast("double"), 2))


def falls(notes: Column) -> Column:
    """Falls of an element by its notes: 2 for Fx, 1 for F, in any case."""
    return F.when(notes.rlike("(?i)fx"), 2).when(notes.rlike("(?i)f"), 1).otherwise(0)


def fall_cap(n: Column) -> Column:
    """The greatest component mark of a program with n falls; null without any."""
    return F.when(n >= 2, 8.75).when(n == 1, 9.5)


def quadratic_sigma(x: Column, a: Column, b: Column, c: Column, floor: float = 0.05) -> Column:
    return F.sqrt(F.greatest(F.lit(floor * floor), a * x * x + b * x + c))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def activity_bucket(international: Column, qualifying: Column, nqs: Column, kind: Column) -> Column:
    """The first that fits: international, championships, sectionals, nqs, non_qualifying, other."""
    return (
        F.when(international, "international").when(qualifying & kind.isin(4, 8), "championships").when(qualifying & kind.isin(1, 2, 3, 5, 6, 7, 9), "sectionals")
        .when(nqs, "nqs").when(~qualifying, "non_qualifying").otherwise("other")
    )


def is_junior_senior(level: Column, teams: Column, least: int | None = None) -> Column:
    """Junior or Senior; with `least`, only with more than so many teams."""
    named = level.isin("Junior", "Senior")
    return named if least is None else named & (teams > least)
