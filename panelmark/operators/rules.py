"""W5: eligibility by rules held as data. Rules join appointments and counts; nothing is evaluated row by row."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = "rule_set_id int, purpose string, appointment_type_id int, metric string, min_value int, season_window int, metric_config string"
#: The nested configuration of a rule, read from JSON.
CONFIG = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("alternatives", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("requirements", T.ArrayType(T.StructType([T.StructField("scope", T.StringType()), T.StructField("min", T.IntegerType())])))]))),
    T.StructField("min_competitions", T.IntegerType()),
])


def parsed(rules: DataFrame) -> DataFrame:
    return rules.withColumn("config", F.from_json("metric_config", CONFIG))


def counts_in_window(served: DataFrame, last_season: int) -> DataFrame:
    """served (official_id, season_code, competition_id, scope): distinct competitions by official, scope and age of season (0: the last)."""
    own = served.where(F.col("season_code") <= last_season).withColumn("age", F.lit(last_season) - F.col("season_code"))
    return own.select("official_id", "scope", "competition_id", "age").distinct()


def evaluated(rules: DataFrame, appointments: DataFrame, served: DataFrame, last_season: int) -> DataFrame:
    """A row an official, rule set and rule: actual and met. rules: parsed; few, so they are broadcast after a check of their number.

    `competitions` counts distinct competitions of the rule's scope in its window; `years_in_grade` compares seasons since
    the appointment; `alternatives` needs all requirements of any one branch.
    """
    if (n := rules.count()) > 10_000:
        raise ValueError(f"{n} rules: rules are configuration and are broadcast")
    numbered = F.broadcast(rules.withColumn("rule_id", F.monotonically_increasing_id()))
    pairs = appointments.join(numbered, "appointment_type_id")
    needs = pairs.select("official_id", "rule_id", "season_window", F.posexplode_outer(
        F.when(F.col("metric") == "alternatives", F.flatten(F.transform("config.alternatives", lambda a, i: F.transform(a.requirements, lambda r: F.struct(i.alias("branch"), r.scope.alias("scope"), r["min"].alias("least"))))))
        .otherwise(F.array(F.struct(F.lit(0).alias("branch"), F.col("config.scope").alias("scope"), F.col("min_value").alias("least"))))
    ).alias("at", "need")).select("official_id", "rule_id", "season_window", "at", "need.*")
    events = counts_in_window(served, last_season)
    hits = needs.join(events, (needs.official_id == events.official_id) & (F.coalesce(needs.scope, events.scope) == events.scope) & (events.age < needs.season_window), "left").select(needs["*"], events.competition_id)
    per = hits.groupBy("official_id", "rule_id", "branch", "at", "least").agg(F.countDistinct("competition_id").alias("n"))
    branch = per.groupBy("official_id", "rule_id", "branch").agg(F.bool_and(F.col("n") >= F.col("least")).alias("all"), F.sum("n").alias("n"))
    counted = branch.groupBy("official_id", "rule_id").agg(F.bool_or("all").alias("counted"), F.max("n").alias("n"))
    joined = pairs.join(counted, ["official_id", "rule_id"], "left")
    years = F.lit(last_season) - F.col("achieved_season")
    by_years = F.col("metric") == "years_in_grade"
    return joined.select(
        "official_id", "appointment_type_id", "rule_set_id", "purpose", "metric", F.when(by_years, years).otherwise(F.col("n")).cast("int").alias("actual"),
        F.when(by_years, years >= F.col("min_value")).otherwise(F.coalesce("counted", F.lit(False))).alias("met"),
    )


def sets_met(results: DataFrame) -> DataFrame:
    """A set is met when all its rules are."""
    return results.groupBy("official_id", "rule_set_id", "purpose").agg(F.bool_and("met").alias("met"), F.count(F.lit(1)).alias("n_rules"), F.sum(F.col("met").cast("int")).alias("n_met"))


def first_season(rules: DataFrame, achieved: DataFrame) -> DataFrame:
    """By official and set: the first season in which all rules on years are met; null without such rules."""
    own = rules.where("metric = 'years_in_grade'").select("rule_set_id", "appointment_type_id", "min_value")
    return achieved.join(F.broadcast(own), "appointment_type_id").groupBy("official_id", "rule_set_id").agg(F.max(F.col("achieved_season") + F.col("min_value")).alias("first_season"))


def coverable(pools: Sequence[Sequence[int]]) -> bool:
    """Whether each pool can be given a competition of its own (a matching that covers all pools)."""
    given: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for c in pools[i]:
            if c not in seen:
                seen.add(c)
                if c not in given or place(given[c], seen):
                    given[c] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(pools)))


def coverable_counts(needs: Sequence[tuple[int, Sequence[int]]]) -> bool:
    """Whether each need (how many, of which competitions) can have competitions that no other need has."""
    return coverable([pool for least, pool in needs for _ in range(least)])


@F.pandas_udf(T.BooleanType())
def distinct_cover(pools: pd.Series) -> pd.Series:
    """coverable() of arrays of arrays; a row is an official and a rule, with a few competitions each. Null stays null."""
    return pools.map(lambda own: None if own is None else coverable([[] if p is None else list(p) for p in own]))


def in_window(season: Column, last: int, window: Column) -> Column:
    return (season <= last) & (season > F.lit(last) - window)
