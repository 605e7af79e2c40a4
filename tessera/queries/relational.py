"""The inherited relational surface, one query for each category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.queries import query, read, views


def _sql(name: str, tables: str, text: str, duck: str | None = None) -> None:
    """A query given as SQL that both engines read (or each its own)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(text)

    run.__name__ = name
    query(duck or text)(run)


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05")
def scan_filter_project(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").filter("l_quantity < 10 and l_discount >= 0.05")
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
          min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY ALL""")
def group_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"),
    )


_sql("join_inner", "customer nation region", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_sql("join_left", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_sql("join_full", "supplier nation", "SELECT coalesce(s_nationkey, -1) AS s, coalesce(n_nationkey, -1) AS n, count(*) AS c FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 5) n ON s_nationkey = n_nationkey GROUP BY 1, 2")
_sql("join_semi", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_sql("join_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("join_theta", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey * 5")
_sql("join_cross", "region nation", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
_sql("distinct_rows", "events", "SELECT DISTINCT user_id, event_type FROM events")
_sql("having_filter", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
_sql("distinct_aggregates", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_sql("grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_sql("cube_rows", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("rollup_rows", "nation region", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("window_ranks", "orders", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
_sql("window_offsets", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS ahead, first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("window_frames", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders")
_sql("qualify_top", "orders", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
_sql("sort_limit", "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 100")
_sql("union_all_rows", "orders lineitem", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity = 1")
_sql("set_operations", "orders lineitem", "SELECT k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem) a UNION (SELECT o_custkey FROM orders EXCEPT SELECT l_partkey FROM lineitem)")
_sql("except_all_rows", "orders", "SELECT o_custkey FROM orders EXCEPT ALL SELECT DISTINCT o_custkey FROM orders")
_sql("correlated_scalar", "orders customer", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")
_sql("in_subquery", "lineitem part", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
_sql("cte_chain", "orders", "WITH a AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b")
_sql("recursive_series", "region", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")
_sql("string_functions", "nation", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, length(n_name) AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, trim(n_name) AS tr, concat(n_name, '-', n_regionkey) AS cat, reverse(n_name) AS rev FROM nation")
_sql("predicate_functions", "events", "SELECT event_id FROM events WHERE starts_with_(event_type) AND value BETWEEN 1 AND 50".replace("starts_with_(event_type)", "startswith(event_type, 'c')"), "SELECT event_id FROM events WHERE starts_with(event_type, 'c') AND value BETWEEN 1 AND 50")
_sql("case_coalesce", "lineitem", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, sum(coalesce(nullif(l_linenumber, 1), 0)) AS s FROM lineitem GROUP BY 1")
_sql("date_parts", "orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3")
_sql("math_functions", "part", "SELECT p_partkey, abs(p_size - 25) AS a, sqrt(CAST(p_size AS DOUBLE)) AS s, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, p_size % 7 AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, sqrt(CAST(p_size AS DOUBLE)) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, p_size % 7 AS m FROM part")
_sql("typed_casts", "part", "SELECT p_partkey, CAST(p_partkey AS VARCHAR(20)) AS s, CAST(p_retailprice AS DECIMAL(12, 2)) AS d, CAST(p_size AS DOUBLE) AS f FROM part")
_sql("percentiles", "lineitem", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag")


@query("""SELECT user_id, k, count(*) AS n FROM (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL""")
def json_fields(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, list_contains(list_transform(embedding, lambda x: x > 0.25), true) AS high FROM embeddings")
def array_functions(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.exists("embedding", lambda x: x > 0.25).alias("high")
    )


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY 1")
def pivot_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '1 hour' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
          s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
          SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf_dir):
    from tessera.streaming.topics import sessions

    return sessions(read(spark, sf_dir, "events"), "ts", "1 hour", ("user_id",)).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT l_suppkey, max(run) AS best FROM (SELECT l_suppkey, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS run FROM lineitem) GROUP BY l_suppkey")
def running_totals(spark, sf_dir):
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").rowsBetween(W.unboundedPreceding, W.currentRow)
    return read(spark, sf_dir, "lineitem").withColumn("run", F.sum("l_quantity").over(w)).groupBy("l_suppkey").agg(F.max("run").alias("best"))
