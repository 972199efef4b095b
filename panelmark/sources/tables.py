"""Reading tables, and the adapter from the driver's tables to the mark schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark schema that every operator on marks reads; scores are doubles, ids may be null.
MARK = T.StructType([
    T.StructField("element_id", T.LongType()), T.StructField("judge_id", T.LongType()), T.StructField("judge_score", T.DoubleType()),
    T.StructField("pcs_score", T.DoubleType()), T.StructField("pcs_type_id", T.IntegerType()), T.StructField("skater_segment_id", T.LongType()),
    T.StructField("segment_id", T.IntegerType()), T.StructField("discipline_type_id", T.IntegerType()), T.StructField("element_type_id", T.IntegerType()),
    T.StructField("competition_id", T.IntegerType()), T.StructField("competition_type_id", T.IntegerType()), T.StructField("season_start", T.IntegerType()),
    T.StructField("event_date", T.DateType()), T.StructField("is_rule_error", T.BooleanType()),
])

#: Dimension values of the driver's tables, in the order of their ids from 1.
DISCIPLINES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ELEMENT_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header and a declared schema; a cell that doesn't fit is null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def _place(column: str, values: tuple[str, ...]) -> F.Column:
    return F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of the MARK schema: an order's lines are a panel, a supplier is a judge; of a judge's lines on a panel the first counts.

    Lines are dealt by order once; de-duplication, panel windows and the join to orders keep that partitioning.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    first = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    lines = lines.repartition("l_orderkey").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("event_date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", _place("c_mktsegment", DISCIPLINES).alias("discipline_type_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", _place("p_type", ELEMENT_TYPES).alias("element_type_id"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    score = F.col("l_quantity").cast("int") % 11 - 5
    year = F.year("event_date")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return joined.select(
        F.col("l_orderkey").alias("element_id"), F.col("l_suppkey").alias("judge_id"), score.cast("double").alias("judge_score"),
        (F.floor(cents % 1000 / 25) * 0.25).cast("double").alias("pcs_score"), (1 + F.col("l_linenumber") % 3).cast("int").alias("pcs_type_id"), F.col("o_custkey").alias("skater_segment_id"),
        F.col("c_nationkey").alias("segment_id"), "discipline_type_id", "element_type_id",
        (F.col("c_nationkey") * 10000 + year).cast("int").alias("competition_id"), (1 + F.col("c_nationkey") % 17).cast("int").alias("competition_type_id"),
        (year - (F.month("event_date") < 7).cast("int")).alias("season_start"), "event_date",
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (score > 2)).alias("is_rule_error"),
    )


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("judge_id"), F.col("s_name").alias("judge_name"), F.col("s_nationkey").alias("nation_id"))


def judge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (judge_id, official) of two rosters: u... for the first, i... for the second."""
    own = table(spark, sf_dir, "supplier")
    first = own.select(F.col("s_suppkey").alias("judge_id"), F.concat(F.lit("u"), (F.col("s_nationkey") * 3 + F.col("s_suppkey") % 3).cast("string")).alias("official"))
    second = own.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("judge_id"), F.concat(F.lit("i"), (F.col("s_suppkey") % 40).cast("string")).alias("official"))
    return first.unionByName(second)


#: The same adapter for DuckDB; begins a WITH clause that a query goes on with.
MARKS_SQL = """
WITH kept AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1
), marks AS (
    SELECT l_orderkey AS element_id, l_suppkey AS judge_id, CAST(CAST(l_quantity AS INTEGER) % 11 - 5 AS DOUBLE) AS judge_score,
        CAST((CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) // 25 AS DOUBLE) * 0.25 AS pcs_score, CAST(1 + l_linenumber % 3 AS INTEGER) AS pcs_type_id,
        o_custkey AS skater_segment_id, c_nationkey AS segment_id,
        list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS discipline_type_id,
        list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) AS element_type_id,
        CAST(c_nationkey * 10000 + year(o_orderdate) AS INTEGER) AS competition_id, CAST(1 + c_nationkey % 17 AS INTEGER) AS competition_type_id,
        CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INTEGER) AS season_start, CAST(o_orderdate AS DATE) AS event_date,
        l_returnflag = 'R' AND l_linestatus = 'O' AND CAST(l_quantity AS INTEGER) % 11 - 5 > 2 AS is_rule_error
    FROM kept JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), panel AS (
    SELECT *, avg(judge_score) OVER w AS panel_average, judge_score - avg(judge_score) OVER w AS deviation, median(judge_score) OVER w AS control_score,
        count(*) OVER w AS panel_size,
        (judge_score = min(judge_score) OVER w OR judge_score = max(judge_score) OVER w) AND count(*) OVER (PARTITION BY element_id, judge_score) < 3 AS thrown_out
    FROM marks WINDOW w AS (PARTITION BY element_id)
)"""
