"""Queries on the star schema: interval, effective-dating and overlap joins, splits, sets, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import selection as K
from ..registry import query
from ..sources.tables import table

DAY = 86_400.0


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


@query("SELECT o_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY")
def interval_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", _seconds("l_shipdate").alias("at"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", _seconds("o_orderdate").alias("a"), (_seconds("o_orderdate") + 30 * DAY).alias("b"))
    joined = J.interval_join(points, spans, "at", "a", "b", 30 * DAY, ["o_orderkey"])
    return joined.select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("SELECT event_id, o.o_orderkey AS version FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("at"))
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("version"))
    return J.as_of(e, v, "k", "at", "since", "version").select("event_id", "version")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS k, epoch(o_orderdate) AS a, epoch(o_orderdate) + 864000 AS b, o_orderpriority AS g FROM orders)
SELECT DISTINCT y.id, y.k FROM s x JOIN s y ON x.k = y.k AND x.g <> y.g AND (x.a, x.id) < (y.a, y.id) AND x.b > y.a""")
def overlap_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), _seconds("o_orderdate").alias("a"), (_seconds("o_orderdate") + 10 * DAY).alias("b"), F.col("o_orderpriority").alias("g"))
    return J.overlaps(s, "k", "id", "a", "b", "g").select("id", "k")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.bank(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)")
def anti_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no second line names."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unknown(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("""SELECT c_custkey, round(coalesce(n.v, l.v), 4) AS v, CASE WHEN n.v IS NOT NULL THEN 'network' WHEN l.v IS NOT NULL THEN 'local' ELSE 'abstain' END AS route FROM customer
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) n ON n.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1) l ON l.o_custkey = c_custkey""")
def route_fallback_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    high = F.col("o_orderpriority").startswith("1")
    best = lambda c: orders.filter(c).groupBy("c_custkey").agg(F.max("o_totalprice").alias("v"))
    out = J.route(table(spark, sf_dir, "customer").select("c_custkey"), best(high), best(~high), "c_custkey", "v")
    return out.select("c_custkey", F.round("v", 4).alias("v"), "route")


@query("""WITH l AS (SELECT DISTINCT o_custkey AS k, c_mktsegment AS g FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY md5('7:' || k), k) AS n, count(*) OVER (PARTITION BY g) AS t FROM l)
SELECT k, g, CASE WHEN n <= round_even(t * 0.6, 0) THEN 'TRAIN' WHEN n <= round_even(t * 0.8, 0) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM p""")
def lineage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g")), "k")
    return K.lineage_split(rows, "k", "g", 7).select("k", "g", "split")


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.split_leaks(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("split")), "o_custkey")


@query("SELECT * FROM (SELECT o_orderpriority AS g, o_orderkey, round(o_totalprice, 4) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(o_totalprice) DESC, o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 5")
def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", F.col("o_totalprice").alias("v"))
    w = Window.partitionBy("g").orderBy(F.desc(F.abs("v")), "v", "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place <= 5").withColumn("v", F.round("v", 4))


@query("""SELECT k, g, ordinal FROM (SELECT c_custkey AS k, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) - 1 AS ordinal FROM customer) WHERE ordinal < 6""")
def bank_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"))
    return K.balanced_bank(c, "k", "g", 6, 3).orderBy("ordinal", "g")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'left', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionAll(count(a.subtract(b), "left")).unionAll(count(a.union(b).distinct(), "all"))


@query("""SELECT coalesce(r_name, 'all') AS region, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY GROUPING SETS ((r_name, c_mktsegment), (r_name), ())""")
def subgroup_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sets = joined.groupingSets([[F.col("r_name"), F.col("c_mktsegment")], [F.col("r_name")], []], F.col("r_name"), F.col("c_mktsegment")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double"), 2).alias("total"))
    return sets.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "total")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) NOT BETWEEN 100 AND 1000")
def design_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.balance(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 100, 1000)


@query("SELECT c_nationkey AS k, 'left' AS side FROM customer EXCEPT ALL SELECT s_nationkey, 'left' FROM supplier UNION ALL (SELECT s_nationkey, 'right' FROM supplier EXCEPT ALL SELECT c_nationkey, 'right' FROM customer)")
def exact_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one side of an evaluation has more often than the other."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return J.aligned(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")
