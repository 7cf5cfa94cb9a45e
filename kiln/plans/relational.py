"""Queries on joins, aggregates, windows and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.plans.base import Tables, query
from kiln.streaming import events as S


@query("""
SELECT b.source, b.topic, count(DISTINCT c.chunk_id) AS n_chunks, sum(c.n_tokens)::BIGINT AS n_tokens FROM (SELECT DISTINCT chunk_id, book, n_tokens FROM chunks) c JOIN book_catalog b USING (book) GROUP BY 1, 2
""")
def unit_to_book(t: Tables) -> DataFrame:
    c = t.chunks.select("chunk_id", "book", "n_tokens").distinct()
    return c.join(t.book_catalog, "book").groupBy("source", "topic").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


@query("""
WITH n AS (SELECT DISTINCT chunk_id, unnest(numbers) AS number FROM tokenized_chunks) SELECT n.number, count(DISTINCT c.chunk_id) AS n_chunks FROM n JOIN chunks c USING (chunk_id) GROUP BY 1 HAVING count(DISTINCT c.chunk_id) > 1
""")
def array_to_units(t: Tables) -> DataFrame:
    n = t.tokenized_chunks.select("chunk_id", F.explode("numbers").alias("number")).distinct()
    return n.join(t.chunks.select("chunk_id").distinct(), "chunk_id").groupBy("number").agg(F.countDistinct("chunk_id").alias("n_chunks")).filter("n_chunks > 1")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS unit_revenue, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS weighted_discount FROM lineitem GROUP BY 1, 2
""")
def weighted_mean(t: Tables) -> DataFrame:
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(revenue / F.sum("l_quantity"), 6).alias("unit_revenue"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 8).alias("weighted_discount"))


@query("""
SELECT l_shipmonth, grouping(l_shipmonth)::INT AS g1, l_returnflag, grouping(l_returnflag)::INT AS g2, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM (SELECT month(l_shipdate)::INT AS l_shipmonth, l_returnflag, l_extendedprice FROM lineitem) GROUP BY CUBE (l_shipmonth, l_returnflag)
""")
def cube_totals(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.month("l_shipdate").alias("l_shipmonth"), "l_returnflag", "l_extendedprice")
    return d.cube("l_shipmonth", "l_returnflag").agg(F.grouping("l_shipmonth").cast("int").alias("g1"), F.grouping("l_returnflag").cast("int").alias("g2"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""
SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (late > 0) / nullif(count(*), 0)::DOUBLE, 8) AS late_share, max(late) AS most_late FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_discount > 0.05) AS late FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1
""")
def filtered_shares(t: Tables) -> DataFrame:
    late = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("late"))
    return t.orders.join(late, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("late") > 0) / F.nullif(F.count("*"), F.lit(0)), 8).alias("late_share"), F.max("late").alias("most_late"))


@query("""
SELECT c_nationkey, c_custkey, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey)::INT AS rank FROM (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE rank <= 3
""")
def top_per_group(t: Tables) -> DataFrame:
    s = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))).filter("rank <= 3")


@query("""
SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount >= 0.09)
""")
def anti_join(t: Tables) -> DataFrame:
    big = t.lineitem.filter("l_quantity > 49 and l_discount >= 0.09").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return t.supplier.select("s_suppkey", "s_name").join(big, "s_suppkey", "left_anti")


@query("""
SELECT s.s_nationkey AS a, c.c_nationkey AS b, count(*) AS n, round(sum(l_extendedprice), 2) AS weight FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey GROUP BY 1, 2
""")
def trade_edges(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("k"), F.sum("l_extendedprice").alias("p"))
    j = s.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.sum("k").alias("n"), F.round(F.sum("p"), 2).alias("weight"))


@query("""
SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts)) AS last_purchase FROM events e WHERE e.event_type = 'click'
""")
def as_of_join(t: Tables) -> DataFrame:
    """The last purchase of the same user at or before each click: one window over the union of both sides, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t.events.filter("event_type in ('purchase', 'click')").withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.filter("event_type = 'click'").select("event_id", "last_purchase")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t: Tables) -> DataFrame:
    return S.tumbling(t.events).withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def events_session(t: Tables) -> DataFrame:
    return S.sessions(t.events)


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def events_dedupe(t: Tables) -> DataFrame:
    return S.unique(t.events.select("event_id", "user_id", "event_type", "ts"), ["event_id"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query()
def events_stream(t: Tables) -> DataFrame:
    """The hourly windows by Structured Streaming over all files; complete output at the end of the data."""
    s = S.tumbling(S.stream(t.spark, t.folder))
    return S.drain(s, "events_stream_rows", "complete").withColumn("total", F.round("total", 4))


@query("""
WITH a AS (SELECT DISTINCT lower(title) AS x FROM entity_titles), b AS (SELECT DISTINCT lower(name) AS x FROM query_entities)
SELECT 'both' AS part, count(*) AS n FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'titles only', count(*) FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'names only', count(*) FROM (SELECT x FROM b EXCEPT SELECT x FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT x FROM a UNION SELECT x FROM b)
""")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.entity_titles.select(F.lower("title").alias("x")), t.query_entities.select(F.lower("name").alias("x"))
    parts = {"both": a.intersect(b), "titles only": a.subtract(b), "names only": b.subtract(a), "any": a.union(b).distinct()}
    out = None
    for name, d in parts.items():
        row = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS mid, round(stddev_pop(value), 6) AS std, count(value) AS n_value, count(DISTINCT user_id) AS users, json_extract_string(max(props), '$.k') IS NULL AS no_k FROM events GROUP BY 1
""")
def event_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("mid"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("value").alias("n_value"), F.countDistinct("user_id").alias("users"), F.get_json_object(F.max("props"), "$.k").isNull().alias("no_k"))
