"""Queries over consensus, bridged gaps, chains of registrations and clicks on a hub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.courts import Court
from trackweave.operators import calibration, registration
from trackweave.plans.registry import query, table


@query("""WITH m AS (SELECT l_orderkey // 4000 AS clip, l_orderkey // 5 AS frame, count(*) AS n, count(*) FILTER ((l_partkey + l_suppkey) % 10 >= 2) AS good FROM lineitem GROUP BY ALL)
SELECT clip, frame, n AS landmarks, CASE WHEN n < 12 THEN 0 ELSE good END AS inliers, n >= 12 AND good >= 12 AS solved, CASE WHEN n < 12 THEN 'too few landmarks' WHEN good < 12 THEN 'too few landmarks agree' END AS reason, CASE WHEN n >= 12 AND good >= 12 THEN 0.0 END AS off_px FROM m""")
def robust_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the landmarks are far from where the camera has them; ``off_px``: how far the matrix found puts the middle of the court from its place."""
    X, Y = (F.col("l_partkey") % 29).cast("double"), (F.col("l_suppkey") * 7 % 16).cast("double")
    w = 0.002 * X + 0.001 * Y + 1
    wrong = (F.col("l_partkey") + F.col("l_suppkey")) % 10 < 2
    away = lambda d: F.when(wrong, d).otherwise(0)
    x, y = (40 * X + 3 * Y + 100) / w + away(97 + 13 * (F.col("l_partkey") % 11)), (2 * X + 35 * Y + 60) / w - away(80 + 17 * (F.col("l_suppkey") % 7))
    seen = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 4000").alias("clip"), F.expr("l_orderkey div 5").alias("frame"), X.alias("court_x"), Y.alias("court_y"), x.alias("x"), y.alias("y"))
    out = calibration.robust_calibrated(seen, least=12, count=table(spark, sf_dir, "lineitem").count())
    m = [F.get("h", F.lit(i)) for i in range(9)]
    z = m[6] * 14 + m[7] * 7.5 + m[8]
    true_z = 0.002 * 14 + 0.001 * 7.5 + 1
    off = F.hypot((m[0] * 14 + m[1] * 7.5 + m[2]) / z - (40 * 14 + 3 * 7.5 + 100) / true_z, (m[3] * 14 + m[4] * 7.5 + m[5]) / z - (2 * 14 + 35 * 7.5 + 60) / true_z)
    return out.select("clip", "frame", "landmarks", "inliers", "solved", "reason", F.round(off, 3).alias("off_px"))


_SEEN = ", ".join(f"(m0 * {x} + m1 * {y} + m2) / (m6 * {x} + m7 * {y} + 1) AS x{i}, (m3 * {x} + m4 * {y} + m5) / (m6 * {x} + m7 * {y} + 1) AS y{i}" for i, (x, y) in enumerate(((0.0, 0.0), (28.0, 0.0), (28.0, 15.0), (0.0, 15.0))))
_MOVED = ", ".join(f"(a.{c}{i} + t * (b.{c}{i} - a.{c}{i}))::DOUBLE AS {c}{i}" for i in range(4) for c in "xy")
_FLAT = ["(x1 - x0 + g * x1) / 28", "(x3 - x0 + h * x3) / 15", "x0", "(y1 - y0 + g * y1) / 28", "(y3 - y0 + h * y3) / 15", "y0", "g / 28", "h / 15"]


@query(f"""WITH s AS (SELECT o_orderkey // 300 AS clip, o_orderkey % 300 * 5 AS frame, o_custkey % 3 > 0 AS solved, 40.0::DOUBLE + o_orderkey % 7 AS m0, 3.0::DOUBLE AS m1, 100.0::DOUBLE + o_orderkey % 50 AS m2, 2.0::DOUBLE AS m3, 35.0::DOUBLE + o_orderkey % 5 AS m4, 60.0::DOUBLE AS m5, 0.002::DOUBLE AS m6, 0.001::DOUBLE AS m7 FROM orders),
c AS (SELECT clip, frame, {_SEEN} FROM s WHERE solved),
n AS (SELECT s.*, last_value(CASE WHEN solved THEN frame END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(CASE WHEN solved THEN frame END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM s),
f AS (SELECT n.*, (hi - lo) // 5 - 1 AS gap, (frame - lo) / 5 / ((hi - lo) // 5) AS t FROM n WHERE NOT solved AND (hi - lo) // 5 - 1 BETWEEN 1 AND 3),
q AS (SELECT f.clip, f.frame, gap, {_MOVED} FROM f JOIN c a ON a.clip = f.clip AND a.frame = lo JOIN c b ON b.clip = f.clip AND b.frame = hi),
d AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q),
g AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / det AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / det AS h FROM d)
SELECT clip, frame, gap AS bridge, {", ".join(f"round({e}, {8 if i > 5 else 5}) AS m{i}" for i, e in enumerate(_FLAT))} FROM g""")
def corner_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = [40.0 + k % 7, 3.0, 100.0 + k % 50, 2.0, 35.0 + k % 5, 60.0, 0.002, 0.001, 1.0]
    h = F.array(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in cells])
    rows = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 300").alias("clip"), (k % 300 * 5).alias("frame"), F.when(F.col("o_custkey") % 3 > 0, h).alias("h"))
    out = calibration.bridged(rows, 5).where("interpolated")
    return out.select("clip", "frame", "bridge", *[F.round(F.col("h")[i], 8 if i > 5 else 5).alias(f"m{i}") for i in range(8)])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT l_orderkey // 2000 AS clip, l_orderkey % 2000 * 8 + l_linenumber AS frame, l_partkey % 60 >= 25 AND l_suppkey % 10 >= 8 AS direct, l_partkey % 13 > 0 AND l_suppkey % 40 >= 5 AS step, l_partkey % 5 AS a, l_suppkey % 7 AS b, l_partkey % 3 - 1 AS c FROM l),
k AS (SELECT *, CASE WHEN direct THEN 'const' WHEN step THEN 'step' ELSE 'none' END AS kind FROM r),
s AS (SELECT *, count(*) FILTER (kind <> 'step') OVER w AS seg FROM k WINDOW w AS (PARTITION BY clip ORDER BY frame)),
h AS (SELECT *, first_value(kind) OVER (PARTITION BY clip, seg ORDER BY frame) AS head, sum(a) OVER w AS ta, sum(c) OVER w AS tc FROM s WINDOW w AS (PARTITION BY clip, seg ORDER BY frame)),
o AS (SELECT *, sum(CASE WHEN kind = 'const' THEN b ELSE b + a * (tc - c) END) OVER (PARTITION BY clip, seg ORDER BY frame) AS tb FROM h)
SELECT clip, frame, CASE WHEN head <> 'const' THEN 'failed' WHEN kind = 'const' THEN 'direct' ELSE 'chained' END AS method, CASE WHEN head = 'const' THEN ta::DOUBLE END AS a, CASE WHEN head = 'const' THEN tb::DOUBLE END AS b, CASE WHEN head = 'const' THEN tc::DOUBLE END AS c FROM o""")
def registration_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations whose matrices are upper triangles of whole numbers, so products are exact."""
    a, b, c = F.col("l_partkey") % 5, F.col("l_suppkey") % 7, F.col("l_partkey") % 3 - 1
    h = F.array(*[x.cast("double") for x in (F.lit(1), a, b, F.lit(0), F.lit(1), c, F.lit(0), F.lit(0), F.lit(1))])
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    links = one.select(
        F.expr("l_orderkey div 2000").alias("clip"), (F.col("l_orderkey") % 2000 * 8 + F.col("l_linenumber")).alias("frame"), h.alias("direct"), (F.col("l_partkey") % 60).alias("direct_inliers"),
        F.when(F.col("l_suppkey") % 10 >= 8, 0.3).otherwise(0.29).alias("overlap"), F.when(F.col("l_partkey") % 13 > 0, h).alias("step"), (F.col("l_suppkey") % 40 + 20).alias("step_inliers"),
    )
    out = registration.chained(links, width=512, keep=[], count=table(spark, sf_dir, "lineitem").count())
    return out.select("clip", "frame", "method", F.col("h")[1].alias("a"), F.col("h")[2].alias("b"), F.col("h")[5].alias("c"))


def _clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Court]:
    """Clicks of a customer's orders: eight customers are the frames of a clip, each camera stands (7, -3) pixels from the one before."""
    court = Court()
    names = list(court.landmarks().items())
    marks = spark.createDataFrame([(i, n, x, y) for i, (n, (x, y)) in enumerate(names)], "ix long, name string, X double, Y double")
    rows = table(spark, sf_dir, "orders").join(F.broadcast(marks), F.col("o_orderkey") % len(names) == F.col("ix"))
    frame = F.col("o_custkey") % 8
    w = 0.002 * F.col("X") + 0.001 * F.col("Y") + 1
    x, y = (40 * F.col("X") + 3 * F.col("Y") + 100) / w + 7 * frame, (2 * F.col("X") + 35 * F.col("Y") + 60) / w - 3 * frame
    clicks = rows.select(F.expr("o_custkey div 8").alias("clip"), frame.alias("frame"), F.lit("point").alias("kind"), "name", x.alias("x1"), y.alias("y1"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2")).distinct()
    move = F.array(*[F.lit(float(v)) for v in (1, 0, 7, 0, 1, -3, 0, 0, 1)])
    at = F.col("c_custkey") % 8
    links = table(spark, sf_dir, "customer").where(at < 7).select(F.expr("c_custkey div 8").alias("clip"), at.alias("a"), (at + 1).alias("b"), move.alias("h"), F.lit(40).alias("inliers"))
    return clicks, links, court


_MARKS = ", ".join(f"({i}, '{n}', {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (n, (x, y)) in enumerate(Court().landmarks().items()))


@query(f"""WITH m AS (SELECT * FROM (VALUES {_MARKS}) v(ix, name, X, Y)),
k AS (SELECT DISTINCT o_custkey // 8 AS clip, o_custkey % 8 AS frame, name, (40 * X + 3 * Y + 100) / (0.002 * X + 0.001 * Y + 1) AS x, (2 * X + 35 * Y + 60) / (0.002 * X + 0.001 * Y + 1) AS y FROM orders JOIN m ON o_orderkey % 20 = ix),
hub AS (SELECT clip, frame AS hub FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, frame) AS r FROM k GROUP BY clip, frame) WHERE r = 1),
cust AS (SELECT c_custkey FROM customer),
ok AS (SELECT k.*, hub FROM k JOIN hub USING (clip) WHERE NOT EXISTS (SELECT 1 FROM range(8) r(f) WHERE f >= least(frame, hub) AND f < greatest(frame, hub) AND k.clip * 8 + f NOT IN (SELECT c_custkey FROM cust))),
last AS (SELECT *, row_number() OVER (PARTITION BY clip, name ORDER BY frame DESC) AS r FROM ok)
SELECT clip, name, frame, CAST(abs(frame - hub) AS INTEGER) AS hops, round(x + 7 * hub, 5) AS x1, round(y - 3 * hub, 5) AS y1 FROM last WHERE r = 1""")
def clicks_on_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, links, _ = _clicks(spark, sf_dir)
    out = registration.on_hub(clicks, registration.paths_to_hub(links, registration.hubs(clicks)))
    return out.select("clip", "name", "frame", "hops", F.round("x1", 5).alias("x1"), F.round("y1", 5).alias("y1"))


@query()
def fused_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, links, court = _clicks(spark, sf_dir)
    out = registration.fused_calibration(clicks, links, court.landmarks(), court.lines())
    return out.select("clip", "name", "frame", "hops", F.round("residual", 3).alias("residual"), "again", F.round("rms_px", 3).alias("rms_px"), F.round("coverage", 3).alias("coverage"), "verdict")
