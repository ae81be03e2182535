"""Matched cohort derived from order tables: customers are match groups, orders are the rows.

Within the orders that are not pending, a customer's first order is the case and the others are its
controls; pending orders form the scoring sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL

# Score multipliers (one per model) and the centres over the three flag columns.
SCORE_FACTORS = {0: 7919, 1: 6101, 2: 5003, 3: 4507, 4: 3001}
FLAGS = ["RETURN_FLAG", "OPEN_FLAG", "URGENT_FLAG"]
CENTRES = {0: [0.25, 0.5, 0.75], 1: [0.75, 0.25, 0.0], 2: [1.0, 1.0, 0.5]}
COUNTS = ["SYMP_CNT", "COMOR_CNT", "NRCOMOR_CNT", "PROC_CNT"]
IDS = [MATCH_COL, LABEL_COL, ID_COL]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, population and label of every cohort row, and its priority.

    The first order per customer is an aggregate, joined back on the order key: a customer with a
    very large share of the orders never has to be sorted in one task.
    """
    orders = table(spark, folder, "orders")
    first = (
        orders.filter(F.col("o_orderstatus") != "P")
        .groupBy("o_custkey")
        .agg(F.min(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("_case"))
        .select("_case")
    )
    return (
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        .join(first, F.col("o_orderkey") == F.col("_case"), "left")
        .select(
            F.col("o_orderkey").alias(ID_COL),
            F.col("o_custkey").alias(MATCH_COL),
            F.when(F.col("o_orderstatus") == "P", "ss").otherwise("pn").alias("population"),
            F.when(F.col("_case").isNotNull(), 1.0).otherwise(0.0).alias(LABEL_COL),
            F.col("o_orderpriority").alias("priority"),
        )
    )


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort rows with their predictors: four counts, three flags and one rate from the order lines."""
    line = table(spark, folder, "lineitem")
    per_order = line.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("SYMP_CNT"),
        # an order has few lines: sets in the buffer cost less than the copies of all rows that countDistinct makes
        F.size(F.collect_set("l_partkey")).cast("bigint").alias("COMOR_CNT"),
        F.size(F.collect_set("l_suppkey")).cast("bigint").alias("NRCOMOR_CNT"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("PROC_CNT"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("RETURN_FLAG"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("OPEN_FLAG"),
        F.round(F.avg("l_discount"), 6).alias("DISC_AVG_RXDX"),
    )
    joined = members(spark, folder).join(per_order, F.col(ID_COL) == F.col("l_orderkey"), "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*COUNTS, "RETURN_FLAG", "OPEN_FLAG"]]
    urgent = F.when(F.col("priority") == "1-URGENT", 1).otherwise(0).alias("URGENT_FLAG")
    rate = F.coalesce(F.col("DISC_AVG_RXDX"), F.lit(0.0)).alias("DISC_AVG_RXDX")
    return joined.select(*IDS, "population", *filled, urgent, rate)


def flag_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort rows with the flag columns only, which need no distinct counts."""
    line = table(spark, folder, "lineitem")
    per_order = line.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("RETURN_FLAG"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("OPEN_FLAG"),
    )
    joined = members(spark, folder).join(per_order, F.col(ID_COL) == F.col("l_orderkey"), "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["RETURN_FLAG", "OPEN_FLAG"]]
    urgent = F.when(F.col("priority") == "1-URGENT", 1).otherwise(0).alias("URGENT_FLAG")
    return joined.select(*IDS, "population", *filled, urgent)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, controls and scoring rows of a cohort table, without the population column."""
    case = F.col(LABEL_COL) == 1
    in_study = F.col("population") == "pn"
    parts = (rows.filter(in_study & case), rows.filter(in_study & ~case), rows.filter(~in_study))
    return tuple(p.drop("population") for p in parts)


def model_score(model: int = 0) -> Column:
    """Deterministic score of one model; the denominator is prime, so rounding never meets a half."""
    base = (F.col(ID_COL) * F.lit(SCORE_FACTORS[model])) % F.lit(10007)
    return (base + F.col(LABEL_COL) * F.lit(2000.0)) / F.lit(12011.0)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Study rows (cases and controls) with the score of the first model."""
    rows = members(spark, folder).filter(F.col("population") == "pn")
    return rows.select(*IDS, model_score().alias("prob_1"))


def scored_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Study rows once per model, with ``model_id`` and that model's score; one pass over the rows."""
    rows = members(spark, folder).filter(F.col("population") == "pn")
    options = F.array(
        *[F.struct(F.lit(m).alias("model_id"), model_score(m).alias("prob_1")) for m in SCORE_FACTORS]
    )
    return rows.select(*IDS, F.explode(options).alias("_m")).select(*IDS, "_m.model_id", "_m.prob_1")
