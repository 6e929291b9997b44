"""X: what SQL users expect beside the surveyed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import temporal
from textloom.plans.sql import sql
from textloom.queries.registry import query, table

SALES = "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 1"


@query("x01_sql_text", SALES)
def x01(spark, d):
    return sql(spark, d, SALES)


@query("x02_as_of_join", "WITH b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_id % 5 = 0), a AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 5 <> 0) SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS before FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id")
def x02(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    b = e.where("event_id % 5 = 0").withColumn("before", F.col("event_id"))
    return temporal.as_of(e.where("event_id % 5 != 0"), b, ["user_id"], "ts", ["before"], "event_id").select("event_id", "before")


@query("x03_interval_overlap", "WITH i AS (SELECT p_partkey AS id, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e FROM part) SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.s <= b.e AND b.s <= a.e AND a.id < b.id")
def x03(spark, d):
    i = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10).alias("s"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("e"))
    return temporal.overlaps(i, i, "s", "e", 32).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).where("a < b")


@query("x04_approximate_distinct")
def x04(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("a"))
    return g.select("l_returnflag", "n", F.col("a").alias("estimate"))
