"""Queries over nearest-time joins, forward fills, windows and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.operators import timejoin
from trackweave.plans.inputs import EVENTS_SQL, HOUR, events
from trackweave.plans.registry import query, table

_NEAR = f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase'), p AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'view'),
r AS (SELECT q.event_id, q.user_id, q.us, p.event_id AS pid, abs(p.us - q.us) AS d, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(p.us - q.us), p.us {{tie}}, p.event_id DESC) AS k FROM q JOIN p USING (user_id) WHERE abs(p.us - q.us) <= {12 * HOUR * 1_000_000})
SELECT q.user_id, q.event_id, q.us, r.pid AS near_event_id, r.d AS distance FROM q LEFT JOIN r ON q.event_id = r.event_id AND r.k = 1"""


def _near(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    e = events(spark, sf_dir)
    return timejoin.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "us", "event_id", "event_id", 12 * HOUR * 1_000_000, later_wins=later)


@query(_NEAR.format(tie="DESC"))
def nearest_view_for_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, True)


@query(_NEAR.format(tie="ASC"))
def nearest_earlier_on_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, False)


_DAILY = f"{EVENTS_SQL}, t AS (SELECT user_id, day, round(sum(value), 4) AS total FROM e GROUP BY user_id, day)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "day").agg(F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_DAILY}, r AS (SELECT user_id, min(day) AS a, max(day) AS b FROM t GROUP BY user_id), s AS (SELECT user_id, unnest(range(a, b + 1)) AS day FROM r)
SELECT s.user_id, s.day, last_value(t.total IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS total, t.total IS NOT NULL AS sampled FROM s LEFT JOIN t USING (user_id, day)""")
def daily_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.forward_filled(daily(spark, sf_dir), ["user_id"], "day", ["total"])


@query(f"WITH {_DAILY}, k AS (SELECT user_id, day, total FROM t WHERE day % 3 = 0) SELECT e.event_id, e.user_id, e.day, k.total AS held FROM e LEFT JOIN k ON k.user_id = e.user_id AND k.day = e.day - e.day % 3")
def key_frame_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "day")
    solves = daily(spark, sf_dir).where("day % 3 = 0").withColumnRenamed("total", "held")
    return timejoin.key_frames(e, solves, ["user_id"], "day", 3).select("event_id", "user_id", "day", "held")


@query(f"""WITH {_DAILY}, w AS (SELECT *, lag(day) OVER x AS pd, lead(day) OVER x AS nd, lag(total) OVER x AS pt, lead(total) OVER x AS nt FROM t WINDOW x AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(CASE WHEN day - pd = 1 AND nd - day = 1 THEN nt - 2 * total + pt END, 4) AS second_difference FROM w""")
def second_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timejoin.second_difference(daily(spark, sf_dir), ["user_id"], "day", "total")
    return out.select("user_id", "day", F.round("second_difference", 4).alias("second_difference"))


@query(f"""WITH {_DAILY}, w AS (SELECT user_id, day, total, lead(day) OVER x - day - 1 AS gap, lead(total) OVER x AS nt FROM t WINDOW x AS (PARTITION BY user_id ORDER BY day)), f AS (SELECT *, unnest(range(1, gap + 1)) AS k FROM w WHERE gap BETWEEN 1 AND 3)
SELECT user_id, day, round(total, 4) AS total, false AS interpolated FROM t UNION ALL SELECT user_id, day + k, round(total + (nt - total) * k / (gap + 1), 4), true FROM f""")
def bounded_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.bridged(daily(spark, sf_dir), ["user_id"], "day", "total").withColumn("total", F.round("total", 4))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, event_type, row_number() OVER x AS s, lag(event_type) OVER x AS p FROM e WINDOW x AS (PARTITION BY user_id ORDER BY us, event_id)), r AS (SELECT *, sum(CASE WHEN event_type = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s) AS run FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY s) AS n FROM r), k AS (SELECT user_id, event_type, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS f FROM c WHERE n = 3) SELECT user_id, event_type AS confirmed, s AS at_row FROM k WHERE f = 1""")
def first_n_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timejoin.first_confirmed(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type", 3)
    return out.withColumn("at_row", F.col("at_row").cast("bigint"))


@query("""WITH n AS (SELECT conv_id, role, row_number() OVER x AS s, lag(role) OVER x AS p FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn, role)), r AS (SELECT *, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY s) AS run FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY s) AS n FROM r), k AS (SELECT conv_id, role, s, row_number() OVER (PARTITION BY conv_id ORDER BY s) AS f FROM c WHERE n = 1) SELECT conv_id, role AS confirmed, s AS at_row FROM k WHERE f = 1""")
def first_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timejoin.first_confirmed(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "role", 1)
    return out.withColumn("at_row", F.col("at_row").cast("bigint"))


_RANKED = "r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")


@query(f"WITH {_RANKED} SELECT o_custkey, o_orderkey FROM r WHERE i % 4 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.every_nth(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query(f"WITH {_RANKED} SELECT o_custkey, o_orderkey FROM r WHERE n <= 3 OR i IN (0, n // 3, 2 * n // 3)")
def even_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.evenly(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(f"WITH {_RANKED} SELECT o_custkey, o_orderkey, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'valid' ELSE 'test' END AS part FROM r")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.time_split(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "part")


_STATS = f"{EVENTS_SQL}, z AS (SELECT user_id, event_id, us, event_type, user_id % 2 AS team FROM e)"


@query(f"""WITH {_STATS} SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END) OVER w AS points, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS attempts FROM z WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def running_box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = timejoin.running(events(spark, sf_dir), ["user_id"], ["us", "event_id"], {"points": F.when(kind == "purchase", 2).otherwise(0), "attempts": F.when(kind == "click", 1).otherwise(0)})
    return out.select("event_id", "user_id", "points", "attempts")


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT DISTINCT user_id FROM e) SELECT u.user_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 2 END), 0) AS points, count(event_id) FILTER (event_type = 'click') AS attempts, count(event_id) FILTER (event_type = 'view') AS boards
FROM u LEFT JOIN e ON e.user_id = u.user_id AND us <= epoch_us(TIMESTAMP '2024-01-15') GROUP BY u.user_id""")
def stats_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    until = e.where(F.col("us") <= F.unix_micros(F.lit("2024-01-15").cast("timestamp")))
    kind = F.col("event_type")
    stats = until.groupBy("user_id").agg(F.sum(F.when(kind == "purchase", 2)).alias("points"), F.count_if(kind == "click").alias("attempts"), F.count_if(kind == "view").alias("boards"))
    return e.select("user_id").distinct().join(stats, "user_id", "left").na.fill(0)


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT min(s) AS t0 FROM e), x AS (SELECT event_type, s - t0 AS a, s - t0 + 5400 AS b FROM e, o WHERE event_type IN ('purchase', 'click')), w AS (SELECT unnest(range(0, (SELECT max(b) FROM x) - {12 * HOUR} + 1, {6 * HOUR})) AS ws)
SELECT event_type, ws AS window_start, sum(least(b, ws + {12 * HOUR}) - greatest(a, ws)) AS seconds, count(*) AS contacts FROM x JOIN w ON b > ws AND a < ws + {12 * HOUR} GROUP BY event_type, ws""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kinds = F.col("event_type").isin("purchase", "click")
    ends = e.agg(F.min("s").alias("t0"), F.max(F.when(kinds, F.col("s"))).alias("last"))
    x = e.where(kinds).crossJoin(F.broadcast(ends))  # one row
    since = F.col("s") - F.col("t0")
    x = x.select("event_type", since.alias("a"), (since + 5400).alias("b"), (F.col("last") - F.col("t0") + 5400).alias("until"))
    placed = timejoin.windowed(x, "a", "b", width=12 * HOUR, until=F.col("until"))
    return placed.groupBy("event_type", "window_start").agg(F.sum("inside").alias("seconds"), F.count("*").alias("contacts"))


@query(f"WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM e WHERE us <= epoch_us(TIMESTAMP '2024-01-20')) SELECT user_id, event_id, k FROM r WHERE k <= 24")
def feed_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = events(spark, sf_dir).where(F.col("us") <= F.unix_micros(F.lit("2024-01-20").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    return until.withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 24").select("user_id", "event_id", "k")


@query(f"WITH {_DAILY}, g AS (SELECT user_id, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS d FROM t) SELECT user_id, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS cadence FROM g WHERE d IS NOT NULL GROUP BY user_id")
def grid_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day")
    d = daily(spark, sf_dir).withColumn("d", F.col("day") - F.lag("day").over(w)).where("d is not null")
    return d.groupBy("user_id").agg(F.floor(F.percentile("d", F.lit(0.5))).alias("cadence"))


@query(f"WITH {_DAILY} SELECT user_id, day, round(avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS trail FROM t")
def trail_of_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-7, -1)
    return daily(spark, sf_dir).select("user_id", "day", F.round(F.avg("total").over(w), 4).alias("trail"))
