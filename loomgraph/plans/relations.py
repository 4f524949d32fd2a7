"""The driver's tables seen as commits, files, symbols and edges, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Lines that one task puts together at most, on average; a few hundred MB of its memory.
LINES = 300_000


def tasks_of(spark: SparkSession, d: str) -> int:
    """Into how many tasks lines are dealt, so that a task's memory doesn't grow with the table; the number of lines is read from file footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // LINES))


def brand_commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits, the brands in them as files."""
    tasks = tasks_of(spark, d)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(tasks, "l_partkey")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
    return lines.join(brands, "l_partkey").repartition(tasks, "l_orderkey").join(orders, "l_orderkey").select(F.col("l_orderkey").alias("hash"), "path", "ts").distinct()


def part_commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits, the parts in them as files."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(tasks_of(spark, d), "l_orderkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
    return lines.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), "ts").distinct()


BRAND_SQL = """cf AS (SELECT DISTINCT l_orderkey AS hash, p_brand AS path, o_orderdate AS ts
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
PART_SQL = """cf AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS path, o_orderdate AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAIRS_SQL = """pairs AS (SELECT a.path AS file1, b.path AS file2, count(*) AS n, min(a.ts) AS first_ts, max(a.ts) AS last_ts
    FROM cf a JOIN cf b ON a.hash = b.hash AND a.path < b.path GROUP BY 1, 2),
    counts AS (SELECT path, count(*) AS c FROM cf GROUP BY 1)"""


def return_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: where two lines of an order follow each other and both were returned, the first's part depends on the second's (src, dst, n)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("src"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src", "l_returnflag")
    flows = lines.select("src", F.lead("src").over(order).alias("dst"), "l_returnflag", F.lead("l_returnflag").over(order).alias("next"))
    return flows.where("l_returnflag = 'R' and next = 'R' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


RETURN_SQL = """flows AS (SELECT l_partkey AS src, lead(l_partkey) OVER o AS dst, l_returnflag AS flag, lead(l_returnflag) OVER o AS next FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)),
    edges AS (SELECT src, dst, count(*) AS n FROM flows WHERE flag = 'R' AND next = 'R' AND src <> dst GROUP BY 1, 2)"""
