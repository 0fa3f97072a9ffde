"""Queries over lifetimes, islands and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import spans
from trackweave.plans.inputs import EVENTS_SQL, HOUR, SPANS_SQL, events, order_spans
from trackweave.plans.registry import query

_ISLANDS = f"""{EVENTS_SQL},
f AS (SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= {6 * HOUR} THEN 0 ELSE 1 END AS n FROM e),
g AS (SELECT user_id, s, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM f),
islands AS (SELECT user_id, min(s) AS "start", max(s) AS "end", count(*) AS n_rows FROM g GROUP BY user_id, i HAVING max(s) - min(s) + 1 >= {HOUR})"""
_COALESCED = f"""{SPANS_SQL},
c1 AS (SELECT o_custkey, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM o),
c2 AS (SELECT o_custkey, s, e, sum(n) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM c1),
c AS (SELECT o_custkey, min(s) AS "start", max(e) AS "end", count(*) AS n_spans FROM c2 GROUP BY o_custkey, i)"""


def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as spans of two days of their user."""
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("user_id", F.col("s").alias("start"), (F.col("s") + 2 * 24 * HOUR).alias("end"), F.col("event_id").alias("seg_ix"), F.col("value").alias("worth"))


_USER_SPANS = f"""{EVENTS_SQL},
p AS (SELECT user_id, s AS a, s + {2 * 24 * HOUR} AS b, event_id AS seg_ix, value AS worth FROM e WHERE event_type = 'purchase')"""


@query(f"WITH {EVENTS_SQL} SELECT user_id, min(us) AS first_at, max(us) AS last_at, count(*) AS n_rows FROM e GROUP BY user_id")
def track_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.lifetimes(events(spark, sf_dir), ["user_id"], "us")


@query(f"WITH {_ISLANDS} SELECT * FROM islands")
def activity_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.islands(events(spark, sf_dir), ["user_id"], "s", 6 * HOUR, HOUR)


@query(f"""WITH {_ISLANDS},
l AS (SELECT user_id, event_type, max(s) - min(s) + 1 AS life FROM e GROUP BY user_id, event_type), m AS (SELECT user_id, min(life) AS shorter FROM l GROUP BY user_id)
SELECT user_id, "start", "end", CASE WHEN ("end" - "start" + 1)::DOUBLE / shorter >= 0.05 THEN 'duplicate' ELSE 'collapse' END AS kind FROM islands JOIN m USING (user_id)""")
def overlap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    lives = spans.lifetimes(e, ["user_id", "event_type"], "s").groupBy("user_id").agg(F.min(F.col("last_at") - F.col("first_at") + 1).alias("shorter"))
    found = spans.islands(e, ["user_id"], "s", 6 * HOUR, HOUR).join(lives, "user_id")
    return spans.overlap_kind(found, 0.05).select("user_id", "start", "end", "kind")


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT DISTINCT user_id, day FROM e), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d)
SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS n_rows FROM g GROUP BY user_id, i""")
def contiguous_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.contiguous_runs(events(spark, sf_dir), ["user_id"], "day")


@query(f"WITH {_COALESCED} SELECT * FROM c")
def coalesced_order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coalesced(order_spans(spark, sf_dir), ["o_custkey"])


@query(f"WITH {_USER_SPANS} SELECT event_id, user_id, s FROM e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND e.s BETWEEN p.a AND p.b)")
def contaminated_events_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = spans.coalesced(user_spans(spark, sf_dir), ["user_id"])
    return spans.outside(events(spark, sf_dir).where("event_type <> 'purchase'").select("event_id", "user_id", "s"), merged, ["user_id"], "s")


@query(f"""WITH {_USER_SPANS}, r AS (SELECT event_id, user_id, s, seg_ix, row_number() OVER (PARTITION BY event_id ORDER BY seg_ix) AS k FROM e LEFT JOIN p USING (user_id) WHERE s BETWEEN a AND b)
SELECT e.event_id, e.user_id, e.s, r.seg_ix AS hit_seg_ix FROM e LEFT JOIN r ON r.event_id = e.event_id AND r.k = 1""")
def truth_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "s")
    return spans.first_covering(e, user_spans(spark, sf_dir), ["user_id"], ["event_id"], "s", "seg_ix", ["seg_ix"])


@query(f"""WITH {SPANS_SQL} SELECT a.o_custkey, a.o_orderkey AS first_name, b.o_orderkey AS second_name, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND least(a.e, b.e) - greatest(a.s, b.s) + 1 > 10""")
def overlapping_span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlapping_pairs(order_spans(spark, sf_dir), ["o_custkey"], "o_orderkey", 10)


@query(f"""WITH {_COALESCED}, l AS (SELECT o_custkey, min(s) AS f, max(e) AS t FROM o GROUP BY o_custkey), k AS (SELECT o_custkey, sum("end" - "start" + 1) AS covered FROM c GROUP BY o_custkey)
SELECT o_custkey, round(covered::DOUBLE / (t - f + 1), 6) AS share, covered::DOUBLE / (t - f + 1) <= 0.5 AS unvouched FROM l JOIN k USING (o_custkey)""")
def covered_share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_spans(spark, sf_dir)
    lives = o.groupBy("o_custkey").agg(F.min("start").alias("first_at"), F.max("end").alias("last_at"))
    out = spans.covered_share(spans.coalesced(o, ["o_custkey"]), lives, ["o_custkey"])
    return out.select("o_custkey", F.round("share", 6).alias("share"), (F.col("share") <= 0.5).alias("unvouched"))


@query(f"""WITH {SPANS_SQL}, k AS (SELECT o_custkey, s, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS nxt FROM o)
SELECT o_custkey, s AS shot_start, nxt AS shot_end, nxt - s AS length FROM k WHERE nxt > s""")
def shots_between_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    k = order_spans(spark, sf_dir).select("o_custkey", F.col("start").alias("shot_start"), F.lead("start").over(w).alias("shot_end"))
    return k.where("shot_end > shot_start").withColumn("length", F.col("shot_end") - F.col("shot_start"))
