"""Queries over row filters, samples and status columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import filters
from trackweave.plans.inputs import BOXES_SQL, EVENTS_SQL, events, line_boxes
from trackweave.plans.registry import query, table


@query(f"WITH {BOXES_SQL} SELECT frame, tid, l_returnflag FROM b WHERE l_returnflag IN ('A', 'R')")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_classes(line_boxes(spark, sf_dir), "l_returnflag", ["A", "R"]).select("frame", "tid", "l_returnflag")


@query(f"WITH {BOXES_SQL} SELECT l_returnflag, count(*) FILTER (l_quantity >= 10) AS numbers, count(*) FILTER (l_quantity >= 17.5) AS tracked, count(*) FILTER (l_quantity >= 20) AS players FROM b GROUP BY l_returnflag")
def confidence_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.floor_counts(line_boxes(spark, sf_dir), ["l_returnflag"], "l_quantity", {"numbers": 10, "tracked": 17.5, "players": 20})


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 8)")
def enough_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_samples(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 8)


@query("""WITH r AS (SELECT user_id, event_id, event_type <> 'purchase' AS empty, row_number() OVER (PARTITION BY user_id, event_type <> 'purchase' ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_id FROM r WHERE NOT empty OR k % 12 = 0""")
def thinned_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return filters.thinned_empties(e, ["user_id"], ["us", "event_id"], F.col("event_type") != "purchase").select("user_id", "event_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE i IN (0, round_even((n - 1) / 3.0::DOUBLE, 0), round_even(2 * (n - 1) / 3.0::DOUBLE, 0), n - 1)""")
def linspace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.linspace_samples(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


_STATUS = """s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'human' WHEN c_acctbal < 0 THEN 'ignored' WHEN c_nationkey < 12 THEN 'named' WHEN c_custkey % 2 = 0 THEN 'number-only' ELSE 'anonymous' END AS status FROM customer)"""


@query(f"WITH {_STATUS} SELECT c_custkey, status, status IN ('number-only', 'anonymous') AS todo, status IN ('human', 'ignored') AS done FROM s")
def review_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, number = F.when(F.col("c_nationkey") < 12, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    state = filters.status(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") < 0, name, number)
    return table(spark, sf_dir, "customer").select("c_custkey", state.alias("status")).withColumns({tab: filters.in_tab(F.col("status"), tab) for tab in ("todo", "done")})


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(CASE WHEN day % 5 = 3 AND 700 - s % 720 BETWEEN 0 AND 400 THEN 700 - s % 720 END, 1)::DOUBLE AS film_t FROM e")
def film_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = filters.film_stamp(F.col("day") % 5, F.col("s") % 720, 700, 400)
    return events(spark, sf_dir).select("event_id", stamp.cast("double").alias("film_t"))


_PLAYS = "p AS (SELECT event_id, nullif(user_id % 4, 0) AS period, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 <> 0 THEN '5:00' END AS clock FROM events)"


@query(f"WITH {_PLAYS} SELECT event_id, period, clock FROM p WHERE period IS NOT NULL AND coalesce(clock, '') <> ''")
def complete_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 != 0, "5:00")
    plays = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id") % 4, F.lit(0)).alias("period"), clock.alias("clock"))
    return filters.complete_plays(plays, "period", "clock")


@query(f"WITH {BOXES_SQL} SELECT frame, tid, x2 - l_quantity * 2 > x1 AS wide, round(x1 * 100 / 30.48::DOUBLE, 4) AS feet, round((l_quantity - tid + 1) / 59.94::DOUBLE, 4) AS seconds FROM b")
def box_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_boxes(spark, sf_dir).withColumn("x2", F.col("x2") - F.col("l_quantity") * 2)
    seconds = filters.span_seconds(F.col("tid"), F.col("l_quantity"), 59.94)
    return b.select("frame", "tid", filters.non_trivial().alias("wide"), F.round(filters.metres_to_feet(F.col("x1")), 4).alias("feet"), F.round(seconds, 4).alias("seconds"))


@query("SELECT doc_id FROM labels WHERE coalesce(quality, 0) <> 0 OR coalesce(toxic, 0) <> 0")
def has_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(filters.has_activity("quality", "toxic")).select("doc_id")


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 20) AS anchors, quantile_cont(l_discount::DOUBLE * 10, 0.5) FILTER (l_quantity > 20) AS m FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, anchors, round(m, 4) AS median_residual, anchors >= 4 AND coalesce(m <= 0.5, false) AS usable FROM g""")
def residual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_discount").cast("double") * 10).alias("residual"))
    return filters.residual_gate(li, ["l_orderkey"], "l_quantity", "residual", floor=20).withColumn("median_residual", F.round("median_residual", 4))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY user_id, day), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY user_id)
SELECT s.user_id, a AS "start", b AS "end", min(day) FILTER (day < b - 2 AND (day - a) % 3 = 0 AND n >= 2) AS probe FROM s JOIN d USING (user_id) GROUP BY s.user_id, a, b""")
def first_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    spans = d.groupBy("user_id").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return filters.first_probe(spans, d, ["user_id"], "day", "n", step=3, tail=2, need=2)
