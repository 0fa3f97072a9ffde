"""Queries over runs, reports, names, set operations and the tables a viewer asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions import names
from trackweave.operators import runs
from trackweave.plans.inputs import EVENTS_SQL, events
from trackweave.plans.registry import query, table

_STAGES = [(0, "gate", "1-"), (1, "track", "2-"), (2, "track-high", "2-HIGH"), (3, "identify", "3-MEDIUM"), (4, "grade", "5-")]
_STAGES_SQL = "st(ix, stage, prefix) AS (VALUES " + ", ".join(f"({i}, '{s}', '{p}')" for i, s, p in _STAGES) + ")"


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_STAGES, "ix int, stage string, prefix string")


_STAGED = f"{_STAGES_SQL}, m AS (SELECT o_orderkey, stage, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(prefix) DESC, ix) AS k FROM orders JOIN st ON starts_with(o_orderpriority, prefix)), j AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_custkey, coalesce(stage, 'Other') AS stage FROM orders LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (o_orderkey))"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "job")
    return runs.staged(o, stages(spark), "job")


@query(f"WITH {_STAGED} SELECT o_orderkey, stage FROM j")
def longest_prefix_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).select("o_orderkey", "stage")


@query(f"""WITH {_STAGED}, a AS (SELECT unnest(['gate', 'track', 'track-high', 'identify', 'grade', 'render', 'Other']) AS stage), c AS (SELECT stage, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice < 150000) AS running, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice >= 150000) AS stale, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failed FROM j GROUP BY stage)
SELECT stage, coalesce(running, 0) AS running, coalesce(done, 0) AS done, coalesce(stale, 0) AS stale, coalesce(failed, 0) AS failed FROM a LEFT JOIN c USING (stage) WHERE stage <> 'Other' OR running + done + stale + failed > 0""")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = staged(spark, sf_dir).select("stage", F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"), (F.col("o_totalprice") >= 150000).alias("stale"))
    spine = spark.createDataFrame([(s,) for s in ("gate", "track", "track-high", "identify", "grade", "render", "Other")], "stage string")
    return runs.rollup(r, spine)


@query("""WITH r AS (SELECT o_custkey AS clip, o_orderkey, o_orderdate AS started, o_totalprice AS elapsed, o_orderstatus = 'P' AS failed FROM orders) SELECT clip, count(*) AS runs, max(epoch_us(started)) AS latest, round(sum(elapsed), 2) AS elapsed, count(*) FILTER (failed) AS failed, string_agg(o_orderkey::VARCHAR, ',' ORDER BY started, o_orderkey) AS in_order FROM r GROUP BY clip""")
def clip_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("run"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started"), F.col("o_totalprice").alias("elapsed"), (F.col("o_orderstatus") == "P").alias("failed"))
    return runs.history(r).withColumn("elapsed", F.round("elapsed", 2))


@query("""WITH r AS (SELECT s_nationkey AS clip, s_suppkey AS route, round(abs(s_acctbal) / 10000, 1) AS precision, s_suppkey % 7 AS coverage FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY precision DESC, coverage DESC, route) AS n, max(precision) OVER (PARTITION BY clip) AS top FROM r) SELECT clip, route, precision, coverage, n = 1 AS chosen, precision = top AND precision > 0 AS best FROM k""")
def best_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("clip"), F.col("s_suppkey").alias("route"), F.round(F.abs("s_acctbal") / 10000, 1).alias("precision"), (F.col("s_suppkey") % 7).alias("coverage"))
    return runs.best(r)


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS latest_finished, count(DISTINCT o_orderpriority) AS jobs FROM orders GROUP BY o_custkey""")
def latest_with_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(done)["o_orderkey"].alias("latest_finished"), F.count_distinct("o_orderpriority").alias("jobs"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations WHERE role IS NOT NULL) SELECT conv_id, role AS last_action FROM c WHERE k = 1""")
def last_action_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.last_action(table(spark, sf_dir, "conversations").where("role is not null"), ["conv_id"], ["turn", "role"], "role").withColumnRenamed("role", "last_action")


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE coalesce(CASE WHEN s_suppkey IS NOT NULL THEN s_name END, c_mktsegment) END AS number FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def human_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("number"), (F.col("c_custkey") % 5 == 0).alias("human"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("number"))
    return runs.applied(c, s, ["c_custkey"], "number", "human").drop("human")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT 'union' AS op, k FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    part = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return part("union", a.union(b).distinct()).unionAll(part("intersect", a.intersect(b))).unionAll(part("except", a.subtract(b)))


@query("""WITH c AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Van Horn Jr.' WHEN 1 THEN ' Stone III' WHEN 2 THEN '' ELSE ' Reed' END AS name, (c_custkey % 60)::VARCHAR AS number, (c_custkey % 7)::VARCHAR AS other, (c_custkey % 12) || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS clock FROM customer)
SELECT c_custkey, name, CASE c_custkey % 4 WHEN 0 THEN 'Horn Jr.' WHEN 1 THEN 'Stone III' WHEN 2 THEN name ELSE 'Reed' END AS surname, '#' || number || ' ' || CASE c_custkey % 4 WHEN 0 THEN 'Horn Jr.' WHEN 1 THEN 'Stone III' WHEN 2 THEN name ELSE 'Reed' END AS chip,
CASE WHEN length(number) <= length(other) THEN starts_with(other, number) OR suffix(other, number) ELSE starts_with(number, other) OR suffix(number, other) END AS clipped, (c_custkey % 12) * 60.0::DOUBLE + c_custkey % 60 AS seconds FROM c""")
def clock_and_name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.when(k % 4 == 0, " Van Horn Jr.").when(k % 4 == 1, " Stone III").when(k % 4 == 2, "").otherwise(" Reed")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", tail).alias("name"), (k % 60).cast("string").alias("number"), (k % 7).cast("string").alias("other"), F.concat((k % 12).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("clock"))
    return c.select("c_custkey", "name", names.surname(F.col("name")).alias("surname"), names.chip(F.col("number"), F.col("name")).alias("chip"), names.clipped_reading(F.col("number"), F.col("other")).alias("clipped"), names.clock_seconds(F.col("clock")).alias("seconds"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""WITH a AS (SELECT o_orderkey, 'out/c' || (o_custkey % 9) || CASE o_orderkey % 4 WHEN 0 THEN '_tracks.json' WHEN 1 THEN '_oncourt_tracks.json' WHEN 2 THEN '_report.json' ELSE '.mp4' END AS artifact, o_totalprice FROM orders), r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'c' || regexp_extract(artifact, 'out/c([0-9]+)', 1) WHEN 1 THEN 'c' || regexp_extract(artifact, 'out/c([0-9]+)', 1) || '_oncourt' WHEN 2 THEN 'c' || regexp_extract(artifact, 'out/c([0-9]+)', 1) END AS route, o_totalprice FROM a)
SELECT route, count(*) AS runs, round(sum(o_totalprice), 2) AS seconds FROM r GROUP BY route""")
def compute_per_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    tail = F.when(k == 0, "_tracks.json").when(k == 1, "_oncourt_tracks.json").when(k == 2, "_report.json").otherwise(".mp4")
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("out/c"), (F.col("o_custkey") % 9).cast("string"), tail).alias("artifact"), "o_totalprice")
    return a.groupBy(names.route(F.col("artifact")).alias("route")).agg(F.count("*").alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, e.user_id, n_name AS name FROM e LEFT JOIN nation ON n_nationkey = e.user_id % 40")
def roster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"))
    e = events(spark, sf_dir).select("event_id", "user_id", (F.col("user_id") % 40).alias("key"))
    return e.join(roster, "key", "left").drop("key")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, count(*) AS calls, round(sum(value), 4) AS cost, max(us) AS last_us FROM e GROUP BY user_id) SELECT user_id, calls, cost, last_us, rank() OVER (ORDER BY calls DESC, user_id) AS place FROM c ORDER BY place LIMIT 40""")
def ledger_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.max("us").alias("last_us"))
    top = c.orderBy(F.desc("calls"), "user_id").limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("calls"), "user_id")).cast("bigint"))
