"""Queries of joins by order and of stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..streaming import streams
from .registry import registered, table


@registered(
    """SELECT e.event_id, e.user_id, o.o_orderkey, o.o_totalprice FROM
       (SELECT *, ts - INTERVAL 9500 DAY AS t FROM events) e ASOF LEFT JOIN
       (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL) o
       ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate"""
)
def q_asof_join(spark, sf_dir):
    # each event, moved back to the orders' years, with its user's latest order so far; of a day's orders the last key
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("interval 9500 days")).alias("t"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return temporal.as_of_join(events, orders, "t", "o_orderdate", "user_id", "o_custkey").select("event_id", "user_id", "o_orderkey", "o_totalprice")


@registered(
    """WITH p AS (SELECT user_id, event_id AS purchase, ts AS at FROM events WHERE event_type = 'purchase')
       SELECT e.event_id, p.purchase FROM events e ASOF JOIN p ON e.user_id = p.user_id AND e.ts < p.at WHERE p.at <= e.ts + INTERVAL 2 DAY"""
)
def q_asof_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at"))
    found = temporal.as_of_join(events.select("event_id", "user_id", "ts"), bought, "ts", "at", "user_id", direction="forward", exact=False, tolerance="2 days", how="inner")
    return found.select("event_id", "purchase")


@registered(
    """SELECT e.event_id, p.event_id AS purchase FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase'
       AND e.ts >= p.ts - (p.event_id % 97) * INTERVAL 1 HOUR AND e.ts <= p.ts"""
)
def q_range_join(spark, sf_dir):
    # what users did in the hours before a purchase, from none to four days
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), (F.col("ts") - F.expr("(event_id % 97) * interval 1 hour")).alias("low"), F.col("ts").alias("high"))
    return temporal.range_join(events.select("event_id", "user_id", "ts"), spans, "ts", "low", "high", "user_id").select("event_id", "purchase")


@registered(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate AS low, max(l_shipdate) AS high FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
       SELECT a.o_orderkey AS one, b.o_orderkey AS two FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.low <= b.high AND b.low <= a.high AND a.low <= a.high AND b.low <= b.high AND a.o_orderkey < b.o_orderkey"""
)
def q_overlap_join(spark, sf_dir):
    # orders of a customer that were under way at once, from the order's day to the last shipping
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("high"))
    open_ = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("low")).join(shipped, "o_orderkey")
    met = temporal.overlap_join(open_, open_, "low", "high", "o_custkey")
    return met.where("o_orderkey < o_orderkey_y").select(F.col("o_orderkey").alias("one"), F.col("o_orderkey_y").alias("two"))


@registered("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal - 2.5 AND c_acctbal <= s_acctbal + 2.5")
def q_band_join(spark, sf_dir):
    found = temporal.band_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_acctbal", "s_acctbal", 2.5)
    return found.select("c_custkey", "s_suppkey")


#: Files that the events come in, and hours by which an event's file is behind its time at most.
SLOTS, LAG = 10, 48


def _slot(hours_late):
    """The number of the file that brings an event: its hour in the month's first 720, moved back by its lateness."""
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    return F.least(F.floor((hour + hours_late) / (720 / SLOTS)), F.lit(SLOTS - 1)).cast("int")


@registered(
    """WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
       g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s),
       w AS (SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, event_type AS key, round(sum(value), 4) AS total, count(*) AS n FROM g GROUP BY event_type, island)
       SELECT * FROM w WHERE stop <= (SELECT max(ts) - INTERVAL 240 HOUR FROM events)"""
)
def q_session_windows(spark, sf_dir):
    # each file holds events of three days, some up to two days late; sessions still open at the end are not appended
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    stream = streams.replay(events, _slot(F.pmod(F.xxhash64("event_id"), F.lit(LAG))), SLOTS, "late")
    return streams.run_to_end(streams.session_sums(stream, "ts", "event_type", "value", "30 minutes", "240 hours"), "sessions").withColumn("total", F.round("total", 4))


@registered("SELECT event_id, ts, user_id, value FROM events")
def q_stream_without_repeats(spark, sf_dir):
    # every event comes twice, the second time up to two days later
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    late = F.pmod(F.xxhash64("event_id"), F.lit(LAG)) * F.col("again")
    stream = streams.replay(twice, _slot(late), SLOTS, "repeats")
    return streams.run_to_end(streams.without_repeats(stream, "ts", ["event_id"], "240 hours"), "once").drop("again")
