"""Identities: components of links, canonical ids, name keys and fuzzy matches."""

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark.storage import saved


def identities(links: DataFrame) -> DataFrame:
    """links (judge_id, official). By judge the smallest judge id reachable over shared officials.

    Each round takes the least label over a judge's officials and then jumps to that label's own label; lineage is
    cut by a written table, and rounds end when no label changes.
    """
    links = saved(links.where("judge_id IS NOT NULL AND official IS NOT NULL").distinct())
    labels = saved(links.select("judge_id", F.col("judge_id").alias("identity")).distinct())
    while True:
        least = links.join(labels, "judge_id").groupBy("official").agg(F.min("identity").alias("least"))
        near = links.join(least, "official").groupBy("judge_id").agg(F.min("least").alias("identity"))
        jumped = near.join(labels.select(F.col("judge_id").alias("identity"), F.col("identity").alias("far")), "identity", "left")
        new = saved(jumped.select("judge_id", F.least("identity", "far").alias("identity")))
        changed = new.join(labels.withColumnRenamed("identity", "was"), "judge_id").where("identity <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def canonical(judges: DataFrame, counts: DataFrame, key: str = "name_key") -> DataFrame:
    """judges (judge_id, name key) with canonical_id: of equal keys the one with most marks, then the lowest id."""
    own = judges.join(counts, "judge_id", "left").withColumn("n_marks", F.coalesce("n_marks", F.lit(0)))
    best = own.groupBy(key).agg(F.max(F.struct("n_marks", (-F.col("judge_id")).alias("minus"))).alias("b"), F.count(F.lit(1)).alias("group_size"))
    return own.join(best, key).select("judge_id", key, (-F.col("b.minus")).alias("canonical_id"), "group_size")


def name_key(name: Column) -> Column:
    """Lower case without punctuation, titles and double spaces."""
    plain = F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}\\s]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\b(mr|ms|mrs|dr)\\b", " "), "\\s+", " "))


def sorted_key(name: Column) -> Column:
    """The key with its words in order, equal for swapped first and last names."""
    return F.array_join(F.array_sort(F.split(name_key(name), " ")), " ")


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark has no function for."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best of the pairwise ratios of common words and common words with either rest."""
    x, y = set(a.split()), set(b.split())
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    ratio = lambda p, q: 100 * SequenceMatcher(None, p, q, autojunk=False).ratio() if p or q else 0.0
    return 100.0 if common and (not left or not right) else max(ratio(common, one) if common else 0.0, ratio(common, two) if common else 0.0, ratio(one, two))


def fuzzy(left: DataFrame, right: DataFrame, least: float = 92.0, margin: float = 3.0) -> DataFrame:
    """left (left_id, name), right (right_id, name): matches of one word in common or more, scoring least and margin above the next."""
    words = lambda d: d.withColumn("key", name_key(F.col("name"))).withColumn("word", F.explode(F.array_distinct(F.split("key", " "))))
    pairs = words(left).select("left_id", F.col("key").alias("a"), "word").join(words(right).select("right_id", F.col("key").alias("b"), "word"), "word")
    pairs = pairs.select("left_id", "right_id", "a", "b").distinct()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[["left_id", "right_id"]].assign(score=[token_set_ratio(a, b) for a, b in zip(p["a"], p["b"])])

    own = pairs.mapInPandas(scored, "left_id long, right_id long, score double")
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    own = own.withColumns({"place": F.row_number().over(w), "next": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return own.where((F.col("place") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("next") >= margin)).select("left_id", "right_id", "score")


def resolved(names: DataFrame, links: DataFrame, aliases: DataFrame, officials: DataFrame) -> DataFrame:
    """names (judge_id, name) with official_id and how: link, alias, the only equal name, or fuzzy."""
    own = names.withColumn("key", name_key(F.col("name")))
    exact = officials.select(F.col("right_id"), name_key(F.col("name")).alias("key")).groupBy("key").agg(F.min("right_id").alias("by_name"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    near = fuzzy(names.select(F.col("judge_id").alias("left_id"), "name"), officials).select(F.col("left_id").alias("judge_id"), F.col("right_id").alias("by_fuzzy"))
    out = own.join(links.select("judge_id", F.col("official_id").alias("by_link")), "judge_id", "left").join(aliases.select("key", F.col("official_id").alias("by_alias")), "key", "left").join(exact, "key", "left").join(near, "judge_id", "left")
    how = F.when(F.col("by_link").isNotNull(), "link").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "name").when(F.col("by_fuzzy").isNotNull(), "fuzzy")
    return out.select("judge_id", F.coalesce("by_link", "by_alias", "by_name", "by_fuzzy").alias("official_id"), how.alias("how"))
