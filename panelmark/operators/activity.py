"""W4: officials' activity: matrices, buckets, rollups, windows of years, availability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.scoring import activity_bucket


def matrix(served: DataFrame, appointed: DataFrame, years: Sequence[int], as_of: int, first_year: int) -> DataFrame:
    """served (official_id, year, competition_id); appointed (official_id, achieved_year). A row an appointed official.

    Columns: a count of competitions for each year, years in grade, how many years after the appointment had service, how many
    could have had. An official with several appointments counts from the first.
    """
    first = appointed.groupBy("official_id").agg(F.min("achieved_year").alias("achieved_year"))
    counts = served.groupBy("official_id", "year").agg(F.countDistinct("competition_id").alias("n"))
    wide = counts.groupBy("official_id").pivot("year", list(years)).agg(F.first("n"))
    after = counts.join(first, "official_id").where(F.col("year") > F.col("achieved_year")).groupBy("official_id").agg(F.count(F.lit(1)).alias("years_served"))
    own = first.join(wide, "official_id", "left").join(after, "official_id", "left").fillna(0, [*map(str, years), "years_served"])
    eligible = F.greatest(F.lit(0), F.lit(as_of) - F.greatest(F.lit(first_year), F.col("achieved_year") + 1) + 1)
    names = {str(y): f"y{y}" for y in years}
    return own.withColumns({"years_in_grade": F.lit(as_of) - F.col("achieved_year"), "eligible_years": eligible}).withColumnsRenamed(names)


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (international, qualifying, nqs, competition_type_id, ...) with bucket; null flags are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("bucket", activity_bucket(flag("international"), flag("qualifying"), flag("nqs"), F.col("competition_type_id")))


def total_activity(rows: DataFrame) -> DataFrame:
    """By official: distinct segments by (season, bucket), by season and in all, as one grouping-sets aggregate."""
    one = bucketed(rows).groupBy("official_id", "season_code", "competition_id", "segment_id").agg(F.first("bucket").alias("bucket"))
    sets = one.groupingSets([[F.col("official_id"), F.col("season_code"), F.col("bucket")], [F.col("official_id"), F.col("season_code")], [F.col("official_id")]], "official_id", "season_code", "bucket")
    return sets.agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("competition_id").alias("n_competitions"), F.grouping_id().alias("grouping"))


def season_pivot(rows: DataFrame, seasons: Sequence[int], key: str = "official_id") -> DataFrame:
    return rows.groupBy(key).pivot("season_code", list(seasons)).agg(F.countDistinct("competition_id")).fillna(0).withColumnsRenamed({str(s): f"s{s}" for s in seasons})


def segment_counts(rows: DataFrame) -> DataFrame:
    """Distinct competitions and, of them, international ones, by official."""
    return rows.groupBy("official_id").agg(F.countDistinct("competition_id").alias("n_competitions"), F.countDistinct(F.when(F.col("international"), F.col("competition_id"))).alias("n_international"))


def referee_report(served: DataFrame, appointed: DataFrame, as_of: int, window: int) -> DataFrame:
    """By official over the last `window` calendar years: years with service, sorted list, and years by eligible years, three digits."""
    recent = served.where((F.col("year") > as_of - window) & (F.col("year") <= as_of)).groupBy("official_id").agg(F.array_sort(F.collect_set("year")).alias("years"))
    first = appointed.groupBy("official_id").agg(F.min("achieved_year").alias("achieved_year"))
    own = first.join(recent, "official_id", "left").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    eligible = F.least(F.lit(window), F.greatest(F.lit(0), F.lit(as_of) - F.col("achieved_year")))
    n = F.size("years")
    return own.select("official_id", "achieved_year", n.alias("n_years"), F.concat_ws(", ", F.col("years").cast("array<string>")).alias("years"), F.round(n / F.greatest(F.lit(1), eligible), 3).alias("normalised"))


def attributed(rows: DataFrame, links: DataFrame, key: str = "name_key") -> DataFrame:
    """rows with official_id: their own, else the least that links (key, official_id) has for their key."""
    least = links.groupBy(key).agg(F.min("official_id").alias("linked"))
    return rows.join(least, key, "left").withColumn("official_id", F.coalesce("official_id", "linked")).drop("linked")


def availability(forms: DataFrame, prompts: Sequence[str]) -> DataFrame:
    """Wide answers (member, stamp, a column a prompt) as member, prompt, raw and code; a member's latest form counts."""
    latest = forms.withColumn("rn", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("stamp")))).where("rn = 1")
    long = latest.unpivot(["member"], list(prompts), "prompt", "raw")
    return long.withColumn("code", availability_code(F.col("raw")))


def availability_code(raw: Column) -> Column:
    """no_reply for blank cells, then the first wording that fits."""
    t = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull() | (t == ""), "no_reply").when(t.rlike("does not apply|n/a"), "not_applicable").when(t.rlike("not available|unavailable|^no\\b"), "unavailable")
        .when(t.rlike("maybe|if needed"), "if_needed").when(t.rlike("available|^yes\\b"), "available").otherwise("other")
    )


def tenure_bins(ages: DataFrame, column: str, width: int, top: int) -> DataFrame:
    """Rows counted in bins of width aligned to an open bin from top up, with shares running up to 100 percent."""
    low = F.when(F.col(column) >= top, F.lit(top)).otherwise(F.lit(top) - F.ceil((F.lit(top) - F.col(column)) / width) * width)
    own = ages.where(F.col(column).isNotNull()).groupBy(low.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(Window.partitionBy())  # a row a bin
    return own.withColumn("running", F.round(100.0 * running, 2))


def field_size_ok(entries: Column, countries: Column, discipline: Column, international: Column) -> Column:
    """International segments: 6 entries of singles, 4 of pairs and dance, two countries where any is known; none of them passes."""
    enough = F.when(discipline.isin("pairs", "ice dance"), entries >= 4).when(discipline == "singles", entries >= 6).otherwise(True)
    return ~international | (entries == 0) | (enough & ((countries == 0) | (countries >= 2)))
