"""Queries over lines, polygons and court points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import planes
from trackweave.plans.inputs import BOXES_SQL, line_boxes
from trackweave.plans.registry import query, table


@query(f"""WITH {BOXES_SQL}, l AS (SELECT *, sqrt((y1 - y2) ** 2 + (x2 - x1) ** 2) AS n FROM b)
SELECT frame, tid, round((y1 - y2) / n, 6) AS a, round((x2 - x1) / n, 6) AS b, round(abs((y1 - y2) * l_quantity + (x2 - x1) * 7 + x1 * y2 - x2 * y1) / n, 4) AS residual FROM l""")
def line_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_boxes(spark, sf_dir).withColumn("line", planes.line_through(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    residual = planes.line_distance(F.col("line"), F.col("l_quantity"), F.lit(7.0))
    return b.select("frame", "tid", F.round("line.a", 6).alias("a"), F.round("line.b", 6).alias("b"), F.round(residual, 4).alias("residual"))


@query(f"""WITH {BOXES_SQL} SELECT frame, tid, round(CASE WHEN tid % 5 = 0 THEN 0 ELSE greatest(0, least(x2 - 20, 60) - greatest(x1 - 20, 0)) * greatest(0, least(y2 - 20, 40) - greatest(y1 - 20, 0)) / 2400.0::DOUBLE END, 6) AS overlap FROM b""")
def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct((F.col(x) - 20).cast("double").alias("x"), (F.col(y) - 20).cast("double").alias("y"))
    right = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    quads = line_boxes(spark, sf_dir).select("frame", "tid", F.when(F.col("tid") % 5 == 0, F.reverse(right)).otherwise(right).alias("quad"))
    return planes.rectangle_overlap(quads, "quad", 60.0, 40.0).select("frame", "tid", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {BOXES_SQL} SELECT frame, tid, round((sqrt((x2 - y2) ** 2 + (x1 - y1) ** 2) + sqrt((x1 - y1) ** 2 + (x2 - y2) ** 2)) / 2, 5) AS gap FROM b""")
def corner_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    gap = planes.corner_disagreement(F.array(point("x2", "x1"), point("x1", "x2")), F.array(point("y2", "y1"), point("y1", "y2")))
    return line_boxes(spark, sf_dir).select("frame", "tid", F.round(gap, 5).alias("gap"))


@query(f"""WITH {BOXES_SQL}, c AS (SELECT o_orderkey AS frame, o_custkey % 60 AS cx, o_custkey % 50 AS cy FROM orders), d AS (SELECT c.frame, tid, sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) AS distance FROM c JOIN b USING (frame))
SELECT c.frame, d.tid, round(d.distance, 6) AS distance FROM c LEFT JOIN (SELECT * FROM d WHERE distance < 25 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY distance, tid) = 1) d USING (frame)""")
def nearest_to_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("click"), (F.col("o_custkey") % 60).alias("cx"), (F.col("o_custkey") % 50).alias("cy"))
    players = line_boxes(spark, sf_dir).select("frame", "tid", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return planes.nearest_to_click(players, clicks, ["frame"], "click", "tid", 25.0).select("frame", "tid", F.round("distance", 6).alias("distance"))


@query("WITH p AS (SELECT n_nationkey AS i, (n_nationkey * 4 % 28)::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation) SELECT p.i AS index, q.i AS mirror FROM p LEFT JOIN p q ON q.x = 28 - p.x AND q.y = p.y")
def mirror_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), (F.col("n_nationkey") * 4 % 28).cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return planes.mirror_partners(marks, 28.0)


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' || p_partkey % 9 ELSE (p_partkey % 9)::VARCHAR END AS name FROM part), k AS (SELECT *, try_cast(name AS INTEGER) AS i FROM n)
SELECT p_partkey, CASE WHEN i < 6 THEN i * 5.6::DOUBLE END AS x, CASE WHEN i < 6 THEN i * 3.0::DOUBLE END AS y, round((degrees(atan2(p_partkey % 13 - 6, p_partkey % 7 - 3.5)) + 360) % 360, 6) AS bearing FROM k""")
def court_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("x"), key % 9)).otherwise((key % 9).cast("string"))
    point = planes.court_point(name, [(i * 5.6, i * 3.0) for i in range(6)])
    return table(spark, sf_dir, "part").select("p_partkey", point["x"].alias("x"), point["y"].alias("y"), F.round(planes.bearing(key % 7 - 3.5, key % 13 - 6), 6).alias("bearing"))
