"""The queue as of a day, from orders and their lines: what has a line to ship within 30 days. Stands in for a scraped board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.tables import table

D0, D1, D2 = "1998-05-01", "1998-06-08", "1998-06-15"
FIELDS = ["status", "priority", "price", "due_lines", "due_value", "first_ship"]


def board(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """job, customer, status, priority, price, due_lines, due_value, first_ship, last_ship, co_number. Lines are summed before
    the join, so that the join moves a row for each order. Only lines that are due are summed for what they say; what comes from all
    lines of an order is joined to that, and left out by the optimiser where it is not asked for."""
    d = F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))
    soon = (F.col("l_shipdate") > d) & (F.col("l_shipdate") <= F.to_timestamp_ntz(F.date_add(F.lit(day).cast("date"), 30).cast("string")))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job")
    due = (
        lines.filter(soon)
        .groupBy("job")
        .agg(
            F.count("*").alias("due_lines"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("due_value"),
            F.min("l_shipdate").alias("first_ship"),
        )
    )
    whole = lines.groupBy("job").agg(F.max("l_shipdate").alias("last_ship"), F.count_if(F.col("l_shipdate") <= d).alias("co_number"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return orders.join(due.hint("shuffle_hash"), "job").join(whole, "job", "left").withColumns({"first_ship": F.col("first_ship").cast("date").cast("string"), "last_ship": F.col("last_ship").cast("date").cast("string")})


def board_sql(day: str) -> str:
    soon = f"l_shipdate > TIMESTAMP '{day} 00:00:00' AND l_shipdate <= CAST(DATE '{day}' + INTERVAL 30 DAY AS TIMESTAMP)"
    return f"""(SELECT o_orderkey AS job, o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price,
  due_lines, due_value, CAST(CAST(first_ship AS DATE) AS VARCHAR) AS first_ship, CAST(CAST(last_ship AS DATE) AS VARCHAR) AS last_ship, co_number
FROM orders JOIN (SELECT l_orderkey, count(*) FILTER ({soon}) AS due_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER ({soon}) AS DOUBLE) AS due_value,
  min(l_shipdate) FILTER ({soon}) AS first_ship, max(l_shipdate) AS last_ship, count(*) FILTER (l_shipdate <= TIMESTAMP '{day} 00:00:00') AS co_number
  FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE due_lines > 0)"""
