"""Writes: insert-ignore, upsert, replacement and invalidation of partitions, CSV pivots. Tables are folders of Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def existing(like: DataFrame, path: str) -> DataFrame:
    """The table at path, empty with like's schema if there is none."""
    spark = like.sparkSession
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], like.schema)


def insert_ignored(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to append: new rows whose key old lacks, one for each key."""
    fresh = new.dropDuplicates(list(keys))
    return fresh.join(old.select(*keys).distinct(), list(keys), "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """old and new with, for each key, the row of the greatest version, new before old at equal ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("__new")))
    return both.withColumn("__rn", last).where("__rn = 1").drop("__rn", "__new")


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites only the partitions that df has rows of; rows are dealt by partition, so that each gets few files."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def without_partitions(table: DataFrame, stale: DataFrame, by: Sequence[str]) -> DataFrame:
    """The table without the partitions (by) that stale names."""
    return table.join(stale.select(*by).distinct(), list(by), "left_anti")


def reflagged(marks: DataFrame, caps: DataFrame, key: str, score: str) -> DataFrame:
    """marks with is_rule_error set where the score is above its key's cap; marks without a cap keep their flag."""
    joined = marks.join(caps.select(key, "cap"), key, "left")
    return joined.withColumn("is_rule_error", F.when(F.col("cap").isNotNull(), F.col(score) > F.col("cap")).otherwise(F.col("is_rule_error"))).drop("cap")


def csv_pivot(rows: DataFrame, key: str, column: str, values: Sequence, value: Column, path: str) -> None:
    rows.groupBy(key).pivot(column, list(values)).agg(F.first(value)).write.mode("overwrite").csv(path, header=True)
