"""Relational queries over the driver tables: the templates' joins, anti-joins, counts and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import dates
from cairn.functions.stats import nearest_rank
from cairn.operators import relational, tools, traces


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_param_join3(spark: SparkSession, sf_dir: str, segment: str = "BUILDING", status: str | None = None) -> DataFrame:
    customers = relational.where_given(_t(spark, sf_dir, "customer"), (segment, F.col("c_mktsegment") == segment))
    orders = relational.where_given(_t(spark, sf_dir, "orders"), (status, F.col("o_orderstatus") == status))
    lines = _t(spark, sf_dir, "lineitem")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(lines, orders.o_orderkey == lines.l_orderkey)
    return rows.select("o_orderkey", "c_name", "o_orderpriority", "l_partkey", "l_quantity")


def due_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = dt.datetime(1996, 1, 1)
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    orders = _t(spark, sf_dir, "orders").withColumn("due_at", day).where(F.col("due_at").between("1996-01-01 00:00", (now + dt.timedelta(days=30)).strftime("%Y-%m-%d %H:%M")))
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_name", "due_at")


def open_items_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", "p_name", "l_quantity")


def free_resource_anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    end = F.date_format(F.date_add("l_shipdate", 3), "yyyy-MM-dd")
    taken = lines.where(relational.overlaps(day, end, "1995-03-01", "1995-03-03")).select(F.col("l_suppkey").alias("s_suppkey"))
    returned = lines.where((F.col("l_returnflag") == "R") & (day == "1995-02-28")).select(F.col("l_suppkey").alias("s_suppkey"))
    left = _t(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 0).join(taken, "s_suppkey", "left_anti").join(returned, "s_suppkey", "left_anti")
    return left.select("s_suppkey", "s_name", "s_nationkey")


def clash_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines and orders of a stated window of days, as one table."""
    day, end = F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format(F.date_add("l_shipdate", 3), "yyyy-MM-dd")
    lines = _t(spark, sf_dir, "lineitem").where(relational.overlaps(day, end, "1995-03-01", "1995-03-03")).select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("what"), F.col("l_quantity").alias("amount"))
    day, end = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd")
    orders = _t(spark, sf_dir, "orders").where(relational.overlaps(day, end, "1995-03-01", "1995-03-03")).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("what"), F.col("o_totalprice").alias("amount"))
    return lines.unionByName(orders)


def availability_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "N").groupBy("l_partkey").agg(F.count("*").alias("out"))
    parts = _t(spark, sf_dir, "part")
    rows = parts.where(F.lower("p_type").like("%economy%")).join(out, parts.p_partkey == out.l_partkey, "left")
    return rows.select("p_partkey", "p_name", (F.col("p_size") - F.coalesce("out", F.lit(0))).alias("available"))


def calendar_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return _t(spark, sf_dir, "events").where(day.between("2024-01-05", "2024-01-09") & (F.col("event_type") == "purchase")).select("event_id", day.alias("day"), "user_id")


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(_t(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


PRICES = [("click", 0.042, 0.0), ("view", 1.5, 2.0), ("error", None, None)]


def usage_cost_unknown_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    spans = e.select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("provider"), (F.col("event_id") % 500).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"), F.lit(1).cast("long").alias("calls"))
    prices = spark.createDataFrame(PRICES, "provider string, input double, output double")
    return traces.cost(traces.usage(spans), prices).select("trace_id", F.round("known_usd", 4).alias("known_usd"), "unknown_calls")


def argmax_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    best = e.groupBy("day").agg(F.max(F.struct(F.coalesce("value", F.lit(0.0)).alias("v"), (-F.col("event_id")).alias("k"))).alias("b"))
    return best.select("day", (-F.col("b.k")).alias("event_id"), F.round("b.v", 4).alias("value"))


def slowest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"), F.col("value").alias("ms"), F.col("event_type").alias("span"))
    return traces.slowest(e, 5).select("span_id", "span", F.round("ms", 4).alias("ms"))


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, sf_dir, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.max(k).alias("largest"))


def week_day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    day = F.to_date("ts")
    friday = dates.resolve_date(F.lit("friday"), day)
    return e.select("event_id", dates.weekday_name(day).alias("weekday"), F.date_format(friday, "yyyy-MM-dd").alias("next_friday"), F.date_format(dates.week_dates(day)["monday"], "yyyy-MM-dd").alias("monday"))


def sandbox_capped_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation")
    box = tools.sandbox(spark, lambda s: {n: _t(s, sf_dir, n) for n in names}, {"region": ["r_regionkey", "r_name"], "nation": ["n_name", "n_regionkey"]})
    rows, _, why = tools.run_sql(box, "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name")
    if why:
        raise ValueError(why)
    return spark.createDataFrame(rows, "r_name string, nations long")


def last_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest purchase value up to each user's last event."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = _t(spark, sf_dir, "events").withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(upto))
    return rows.withColumn("k", F.row_number().over(newest)).where("k = 1").select("user_id", "event_id", "last_purchase")


QUERIES = {
    f.__name__: f
    for f in (
        optional_param_join3, due_window_join, open_items_join, free_resource_anti_overlap, clash_union_tagged, availability_scalar_subquery,
        calendar_between, nearest_rank_percentiles, usage_cost_unknown_prices, argmax_hour, slowest_n, json_props_extract, week_day_numbers,
        sandbox_capped_select, last_event_per_user,
    )
}

SQL = {
    "optional_param_join3": """
        SELECT o_orderkey, c_name, o_orderpriority, l_partkey, l_quantity
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING'""",
    "due_window_join": """
        SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS due_at
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M') BETWEEN '1996-01-01 00:00' AND '1996-01-31 00:00'""",
    "open_items_join": """
        SELECT l_orderkey, l_linenumber, p_name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "free_resource_anti_overlap": """
        SELECT s_suppkey, s_name, s_nationkey FROM supplier
        WHERE s_acctbal >= 0
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey
                          AND CAST(l_shipdate AS DATE) < DATE '1995-03-03' AND DATE '1995-03-01' < CAST(l_shipdate AS DATE) + 3)
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND CAST(l_shipdate AS DATE) = DATE '1995-02-28')""",
    "clash_union_tagged": """
        SELECT 'line' AS kind, l_orderkey AS what, l_quantity AS amount FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '1995-03-03' AND DATE '1995-03-01' < CAST(l_shipdate AS DATE) + 3
        UNION ALL SELECT 'order', o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1995-03-03' AND DATE '1995-03-01' < CAST(o_orderdate AS DATE) + 3""",
    "availability_scalar_subquery": """
        SELECT p_partkey, p_name, p_size - (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N') AS available
        FROM part WHERE lower(p_type) LIKE '%economy%'""",
    "calendar_between": """
        SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events
        WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-09' AND event_type = 'purchase'""",
    "nearest_rank_percentiles": """
        WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, n, round_even(v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 1) AS p50,
               round_even(v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 1) AS p95 FROM s""",
    "usage_cost_unknown_prices": """
        WITH p(provider, i, o) AS (VALUES ('click', 0.042, 0.0), ('view', 1.5, 2.0), ('error', NULL, NULL)),
        u AS (SELECT user_id, event_type, count(*) AS calls, sum(event_id % 500) AS ti, sum(event_id % 70) AS tout FROM events GROUP BY 1, 2)
        SELECT CAST(user_id AS VARCHAR) AS trace_id,
               round(coalesce(sum(CAST((ti * i + tout * o) / 1e6 AS DOUBLE)) FILTER (i IS NOT NULL AND o IS NOT NULL), 0), 4) AS known_usd,
               CAST(coalesce(sum(calls) FILTER (i IS NULL OR o IS NULL), 0) AS BIGINT) AS unknown_calls
        FROM u LEFT JOIN p ON p.provider = u.event_type GROUP BY user_id""",
    "argmax_hour": """
        SELECT day, event_id, round(v, 4) AS value FROM (
          SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, coalesce(value, 0.0) AS v,
                 row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY coalesce(value, 0.0) DESC, event_id) AS k FROM events)
        WHERE k = 1""",
    "slowest_n": "SELECT event_id AS span_id, event_type AS span, round(value, 4) AS ms FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 5",
    "json_props_extract": """
        SELECT CAST(json_extract_string(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n, max(CAST(json_extract_string(props, '$.k') AS INT)) AS largest
        FROM events GROUP BY 1""",
    "week_day_numbers": """
        SELECT event_id, lower(dayname(ts)) AS weekday,
               strftime(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INT), '%Y-%m-%d') AS next_friday,
               strftime(date_trunc('week', CAST(ts AS DATE)), '%Y-%m-%d') AS monday FROM events""",
    "sandbox_capped_select": "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name LIMIT 50",
    "last_event_per_user": """
        SELECT user_id, event_id, last_purchase FROM (
          SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
                   OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
        WHERE k = 1""",
}
