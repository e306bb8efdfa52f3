"""The relational surface on the star schema, events and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import temporal
from weft.plans.common import on

_REV = "l_extendedprice * (1 - l_discount)"


def _rev():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _pricing(l):
    return (
        l.filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(_rev()), 2).alias("revenue"),
            F.round(F.sum(_rev() * (1 + F.col("l_tax"))), 2).alias("charge"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


def _shipping(c, o, l):
    return (
        c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
        .join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("c_custkey") == F.col("o_custkey"))
        .join(l.select("l_orderkey", "l_extendedprice", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey").agg(F.round(F.sum(_rev()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)
    )


def _nation_revenue(r, n, s, l):
    return (
        l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name").agg(F.round(F.sum(_rev()), 2).alias("revenue"))
    )


def _running(o):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.row_number().over(w).alias("rn"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"), F.lag("o_orderkey").over(w).alias("prev"))


def _asof(e):
    signups = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("sid"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(buys, signups, "user_id", "ts", "sid", "last_signup").select("event_id", "last_signup")


def _range(o):
    bands = o.sparkSession.range(0, 12).select(F.col("id").alias("band"), (F.col("id") * 50000.0 + 100).alias("low"), (F.col("id") * 50000.0 + 60100).alias("high"))
    return temporal.range_join(o.select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "low", "high", 50000.0).select("o_orderkey", "band")


def _interval(e):
    """Errors within an hour after a click of the same user, by hour buckets."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    clicks = e.filter("event_type = 'click'").select("user_id", t.alias("start"), (t + 3_600_000_000).alias("stop"))
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", t.alias("at"))
    hour = lambda c: F.floor(F.col(c) / 3_600_000_000)
    dealt = clicks.withColumn("hour", F.explode(F.sequence(hour("start"), hour("stop"))))
    hit = errors.withColumn("hour", hour("at")).join(dealt, ["user_id", "hour"]).filter("at >= start AND at < stop")
    return hit.groupBy("event_id").agg(F.count("*").alias("n"))


def _sessions(e):
    s = temporal.sessions(e, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


QUERIES = {
    "pricing_summary": on("lineitem", _pricing),
    "shipping_priority": on("customer", "orders", "lineitem", _shipping),
    "nation_revenue": on("region", "nation", "supplier", "lineitem", _nation_revenue),
    "forecast_revenue": on("lineitem", lambda l: l.filter((F.col("l_discount").between(0.03, 0.07)) & (F.col("l_quantity") < 24)).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))),
    "semi_join": on("customer", "orders", lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")),
    "anti_join": on("customer", "orders", lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")),
    "full_outer": on("customer", "supplier", lambda c, s: c.groupBy("c_nationkey").count().withColumnRenamed("count", "nc").join(s.groupBy("s_nationkey").count().withColumnRenamed("count", "ns"), F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "nc", "ns")),
    "cube": on("lineitem", lambda l: l.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))),
    "rollup": on("orders", lambda o: o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))),
    "grouping_sets": on("part", lambda p: p.groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count("*").alias("n"))),
    "window_frames": on("orders", _running),
    "set_union": on("customer", "supplier", lambda c, s: c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()),
    "set_intersect": on("customer", "supplier", lambda c, s: c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))),
    "set_except": on("nation", "supplier", lambda n, s: n.select(F.col("n_nationkey").alias("k")).exceptAll(s.select("s_nationkey").distinct())),
    "pivot": on("lineitem", lambda l: l.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))),
    "date_parts": on("orders", lambda o: o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))),
    "scalar_subquery": on("part", lambda p: p.join(F.broadcast(p.agg(F.avg("p_retailprice").alias("mean"))), F.col("p_retailprice") > F.col("mean")).select("p_partkey")),
    "count_distinct": on("lineitem", lambda l: l.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"))),
    "top_per_group": on("customer", lambda c: c.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).filter("r <= 3").select("c_custkey", "c_nationkey", "r")),
    "json_props": on("events", lambda e: e.groupBy((F.get_json_object("props", "$.k").try_cast("int") % 10).alias("k")).agg(F.count("*").alias("n"))),
    "asof_join": on("events", _asof),
    "range_join": on("orders", _range),
    "interval_join": on("events", _interval),
    "sessions": on("events", _sessions),
    "tumbling_window": on("events", lambda e: e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")),
    "sliding_window": on("events", lambda e: e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("start"), "n", "v")),
    "session_window": on("events", lambda e: e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")),
    "vector_topk": on("embeddings", lambda v: temporal.top_k_cosine(v, v.filter("vec_id % 20 = 0"), 5).select("query_id", "vec_id", "rank", "score")),
}

SQL = {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REV}), 2) AS revenue, round(sum({_REV} * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "shipping_priority": f"SELECT o_orderkey, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "nation_revenue": f"SELECT r_name, n_name, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "full_outer": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, nc, ns FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "window_frames": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, lag(o_orderkey) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "pivot": "SELECT l_returnflag, nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS F, nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY 1",
    "date_parts": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1",
    "top_per_group": "SELECT c_custkey, c_nationkey, r FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3",
    "json_props": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n FROM events GROUP BY 1",
    "asof_join": "SELECT p.event_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts) AS last_signup FROM events p WHERE event_type = 'purchase'",
    "range_join": "SELECT o_orderkey, band FROM orders JOIN (SELECT i AS band, i * 50000.0 + 100 AS low, i * 50000.0 + 60100 AS high FROM range(0, 12) t(i)) ON o_totalprice >= low AND o_totalprice < high",
    "interval_join": "SELECT e.event_id, count(*) AS n FROM events e JOIN events c ON e.user_id = c.user_id AND c.event_type = 'click' AND e.event_type = 'error' AND e.ts >= c.ts AND e.ts < c.ts + INTERVAL 1 HOUR GROUP BY 1",
    "sessions": "WITH x AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM y GROUP BY 1, 2",
    "tumbling_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_window": "SELECT date_trunc('hour', ts) - INTERVAL (o) HOUR AS start, count(*) AS n, round(sum(value), 4) AS v FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1",
    "session_window": "WITH x AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s",
    "vector_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
}
