"""The driver's tables in the shapes that tracking operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.plans.registry import table

HOUR = 3600


def seconds(column: str):
    """Whole seconds since the epoch of a timestamp without a time zone."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``us`` (microseconds), ``s`` (seconds) and ``day`` (days since the epoch)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", us.alias("us"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"), F.expr("unix_micros(cast(ts as timestamp)) div 86400000000").alias("day"))


def order_spans(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Per customer the days from an order on: o_custkey, o_orderkey, start, end."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("start"), (day + days).alias("end"), "o_orderstatus", "o_totalprice")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order line: frame = order, tid = line, position and size from its numbers."""
    li = table(spark, sf_dir, "lineitem")
    x1 = F.col("l_partkey") % 50 * 1.0
    y1 = F.col("l_suppkey") % 40 * 1.0
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("tid"), x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity")).alias("x2"), (y1 + 30 + F.col("l_quantity") / 2).alias("y2"), "l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity")


EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 86400000000 AS day FROM events)"
SPANS_SQL = "o AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 AS e, o_orderstatus, o_totalprice FROM orders)"
BOXES_SQL = "b AS (SELECT l_orderkey AS frame, l_linenumber AS tid, (l_partkey % 50) * 1.0::DOUBLE AS x1, (l_suppkey % 40) * 1.0::DOUBLE AS y1, (l_partkey % 50) * 1.0::DOUBLE + 20 + l_quantity AS x2, (l_suppkey % 40) * 1.0::DOUBLE + 30 + l_quantity / 2 AS y2, l_returnflag, l_suppkey, l_extendedprice, l_quantity FROM lineitem)"
