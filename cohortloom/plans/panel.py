"""A cohort panel derived from the order tables: one row per order, made-up missingness.

The given tables have no missing values, so they are made by arithmetic on the key: a column
for each quality rule, and some that pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ["outcome"]
COVARIATES = ["Cycle", "cov_bal", "cov_nation"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: quantity, price, mean discount and mean tax of its lines."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("disc"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
    )


def survey_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    year = F.year("o_orderdate")
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer")
    joined = (
        orders.join(order_measures(spark, sf_dir), key == F.col("l_orderkey"))
        .join(customers, F.col("c_custkey") == F.col("o_custkey"))
    )
    return joined.select(
        key.alias("sample"),
        year.alias("Cycle"),
        F.col("o_totalprice").alias("outcome"),
        F.col("c_acctbal").alias("cov_bal"),
        F.col("c_nationkey").alias("cov_nation"),
        F.when(key % 7 != 0, F.col("qty")).alias("x_qty"),
        F.when(key % 11 != 0, F.col("price")).alias("x_price"),
        F.when(year != 1998, F.col("disc")).alias("x_gap"),
        F.when(key % 100 == 0, F.col("tax")).alias("x_sparse"),
        F.when(key % 20 == 0, F.col("qty")).otherwise(F.lit(0.0)).alias("x_zero"),
        F.when(key % 150 == 0, F.lit(2).cast("bigint")).otherwise(key % 2).alias("x_cat"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("x_prio"),
    )


def measure_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with all measures present: outcomes, covariates and exposures of every order."""
    joined = (
        read(spark, sf_dir, "orders")
        .join(order_measures(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    )
    return joined.select(
        F.col("o_orderkey").alias("sample"),
        F.year("o_orderdate").alias("Cycle"),
        F.round(F.col("o_totalprice") + F.col("price"), 2).alias("y_total"),
        F.col("price").alias("y_price"),
        F.col("c_acctbal").alias("cov_bal"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cov_prio"),
        F.col("qty").alias("x_qty"),
        F.col("disc").alias("x_disc"),
        F.col("tax").alias("x_tax"),
        F.col("o_totalprice").alias("x_order"),
    )


PANEL_SQL = """
li AS (SELECT l_orderkey, SUM(l_quantity) AS qty, ROUND(SUM(l_extendedprice), 2) AS price,
              ROUND(AVG(l_discount), 6) AS disc, ROUND(AVG(l_tax), 6) AS tax FROM lineitem GROUP BY l_orderkey),
panel AS (
  SELECT o.o_orderkey AS sample, CAST(year(o.o_orderdate) AS INTEGER) AS "Cycle", o.o_totalprice AS outcome,
         c.c_acctbal AS cov_bal, c.c_nationkey AS cov_nation,
         CASE WHEN o.o_orderkey % 7 <> 0 THEN li.qty END AS x_qty,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN li.price END AS x_price,
         CASE WHEN year(o.o_orderdate) <> 1998 THEN li.disc END AS x_gap,
         CASE WHEN o.o_orderkey % 100 = 0 THEN li.tax END AS x_sparse,
         CASE WHEN o.o_orderkey % 20 = 0 THEN li.qty ELSE 0.0::DOUBLE END AS x_zero,
         CAST(CASE WHEN o.o_orderkey % 150 = 0 THEN 2 ELSE o.o_orderkey % 2 END AS BIGINT) AS x_cat,
         CAST(substring(o.o_orderpriority, 1, 1) AS INTEGER) AS x_prio
  FROM orders o JOIN li ON li.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey),
mpanel AS (
  SELECT o.o_orderkey AS sample, CAST(year(o.o_orderdate) AS INTEGER) AS "Cycle",
         ROUND(o.o_totalprice + li.price, 2) AS y_total, li.price AS y_price, c.c_acctbal AS cov_bal,
         CAST(substring(o.o_orderpriority, 1, 1) AS INTEGER) AS cov_prio,
         li.qty AS x_qty, li.disc AS x_disc, li.tax AS x_tax, o.o_totalprice AS x_order
  FROM orders o JOIN li ON li.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)"""


def with_panel(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PANEL_SQL, *ctes]) + "\n" + body
