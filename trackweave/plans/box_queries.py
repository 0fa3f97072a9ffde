"""Queries over boxes, geometry, fusion and joins of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import boxes
from trackweave.operators import fusion
from trackweave.plans.inputs import BOXES_SQL, EVENTS_SQL, events, line_boxes
from trackweave.plans.registry import query, table

_INTER = "greatest(0.0::DOUBLE, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0::DOUBLE, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"


@query(f"""WITH {BOXES_SQL} SELECT a.frame, a.tid AS first_name, b.tid AS second_name, round({_INTER} / least({_AREA.format('a')}, {_AREA.format('b')}), 6) AS share FROM b a JOIN b ON a.frame = b.frame AND a.tid < b.tid WHERE {_INTER} / least({_AREA.format('a')}, {_AREA.format('b')}) >= 0.75""")
def line_box_ios_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.overlapping_in_frame(line_boxes(spark, sf_dir), ["frame"], "tid").withColumn("share", F.round("share", 6))


_MATCH = f"""WITH {BOXES_SQL}, p AS (SELECT a.frame, a.tid AS inner_id, b.tid AS outer_id, {_INTER} / {_AREA.format('a')} AS share FROM (SELECT * FROM b WHERE l_quantity < 25) a JOIN (SELECT * FROM b WHERE l_quantity >= 25) b ON a.frame = b.frame),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, inner_id ORDER BY share DESC, outer_id {{tie}}) AS k FROM p WHERE share >= {{least}}) SELECT frame, inner_id, outer_id, round(share, 6) AS share FROM r WHERE k = 1"""


def _match(spark: SparkSession, sf_dir: str, least: float, last: bool) -> DataFrame:
    b = line_boxes(spark, sf_dir)
    out = fusion.best_match(b.where("l_quantity < 25"), b.where("l_quantity >= 25"), ["frame"], "tid", "tid", least, last_wins=last)
    return out.withColumn("share", F.round("share", 6))


@query(_MATCH.format(tie="DESC", least=0.5))
def best_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, 0.5, True)


@query(_MATCH.format(tie="ASC", least=0.9))
def first_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, 0.9, False)


@query(f"""WITH {BOXES_SQL}, d AS (SELECT frame // 64 AS clip, frame % 64 AS frame, tid, x1, y1, x2, y2 FROM b WHERE tid <= 2), t AS (SELECT frame // 64 AS clip, frame % 64 AS frame, tid, x1, y1, x2, y2 FROM b WHERE tid > 2 AND frame % 64 % 3 = 0),
g AS (SELECT DISTINCT clip, frame AS grid FROM t), q AS (SELECT d.*, CASE WHEN g.grid IS NOT NULL THEN d.frame - d.frame % 3 ELSE d.frame - d.frame % 3 + 3 END AS grid FROM d LEFT JOIN g ON g.clip = d.clip AND g.grid = d.frame - d.frame % 3),
p AS (SELECT a.clip, a.frame, a.tid, a.x1, a.y1, a.x2, a.y2, b.tid AS other, {_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER}) AS share FROM q a JOIN t b ON a.clip = b.clip AND a.grid = b.frame),
r AS (SELECT *, row_number() OVER (PARTITION BY clip, frame, tid, x1, y1, x2, y2 ORDER BY share DESC, other) AS k FROM p WHERE share > 0.4) SELECT clip, frame, tid, other AS adopted_tid, round(share, 6) AS share FROM r WHERE k = 1""")
def adopted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_boxes(spark, sf_dir).select(F.floor(F.col("frame") / 64).alias("clip"), (F.col("frame") % 64).alias("frame"), "tid", "x1", "y1", "x2", "y2")
    tracks = b.where("tid > 2 and frame % 3 = 0")
    out = fusion.adopted(b.where("tid <= 2"), tracks, ["clip"], "frame", "tid", 3)
    return out.select("clip", "frame", "tid", "adopted_tid", F.round("share", 6).alias("share"))


@query(f"WITH {BOXES_SQL}, r AS (SELECT frame, tid, l_returnflag, round((x2 - x1) * (y2 - y1), 4) AS size, row_number() OVER (PARTITION BY frame, l_returnflag ORDER BY round((x2 - x1) * (y2 - y1), 4) DESC, tid) AS k FROM b) SELECT frame, tid, l_returnflag, size FROM r WHERE k = 1")
def one_row_per_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = line_boxes(spark, sf_dir).withColumn("size", F.round(boxes.area(boxes.box()), 4))
    return fusion.one_per_frame(sized, ["frame"], "l_returnflag", "size", "tid").select("frame", "tid", "l_returnflag", "size")


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, day, event_type, max(value) AS v FROM e WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id, day, event_type, max(value) AS v FROM e WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, day, event_type, CASE WHEN c.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' WHEN a.v >= c.v THEN 'both_a' ELSE 'both_b' END AS source, greatest(a.v, c.v) AS v FROM a FULL JOIN c USING (user_id, day, event_type)""")
def two_pass_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda odd: events(spark, sf_dir).where(F.col("event_id") % 2 == odd).groupBy("user_id", "day", "event_type").agg(F.max("value").alias("v"))
    return fusion.fused(best(0), best(1), ["user_id", "day", "event_type"], "v")


@query("""WITH s AS (SELECT DISTINCT l_returnflag, l_orderkey, l_suppkey FROM lineitem) SELECT a.l_returnflag, a.l_suppkey AS first_name, b.l_suppkey AS second_name, count(*) AS shared FROM s a JOIN s b ON a.l_returnflag = b.l_returnflag AND a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def cooccurrence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.cooccurring(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "l_suppkey")


@query(f"""WITH {BOXES_SQL}, q AS (SELECT * FROM b WHERE tid = 1), p AS (SELECT frame, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b) SELECT q.frame, q.tid, count(p.x) AS n_inside FROM q LEFT JOIN p ON p.frame = q.frame AND p.x BETWEEN q.x1 AND q.x2 AND p.y BETWEEN q.y1 AND q.y2 GROUP BY q.frame, q.tid""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_boxes(spark, sf_dir)
    x, y = boxes.centre(boxes.box())
    return fusion.in_boxes(b.select("frame", x.alias("x"), y.alias("y")), b.where("tid = 1"), ["frame"], ["tid"])


@query(f"""WITH {BOXES_SQL}, c AS (SELECT frame % 500 AS span, count(*)::DOUBLE AS n FROM b GROUP BY frame), m AS (SELECT span, quantile_cont(n, 0.5) AS middle FROM c GROUP BY span) SELECT s.span, CASE WHEN s.kind = 'collapse' AND middle >= 4 THEN 'occlusion' ELSE s.kind END AS kind, middle FROM (SELECT unnest(range(520)) AS span, CASE WHEN unnest(range(520)) % 4 = 0 THEN 'duplicate' ELSE 'collapse' END AS kind) s LEFT JOIN m USING (span)""")
def relabelled_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = line_boxes(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n_inside")).withColumn("span", F.col("frame") % 500)
    spans = spark.range(520).select(F.col("id").alias("span"), F.when(F.col("id") % 4 == 0, "duplicate").otherwise("collapse").alias("kind"))
    return fusion.relabelled_overlaps(spans, counts, ["span"], 4.0)


_XY = "p AS (SELECT p_partkey, (p_size % 29) * 0.95::DOUBLE AS x, (p_partkey % 31) * 0.49::DOUBLE AS y FROM part)"


def _court_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 29 * F.lit(0.95)).alias("x"), (F.col("p_partkey") % 31 * F.lit(0.49)).alias("y"))


@query(f"""WITH {_XY}, q AS (SELECT *, CASE WHEN abs(x - 1.575::DOUBLE) <= abs(x - 26.425::DOUBLE) THEN 1.575::DOUBLE ELSE 26.425::DOUBLE END AS bx FROM p)
SELECT p_partkey, round(x, 4) AS x, round(y, 4) AS y, CASE WHEN abs(x - bx) < sqrt(7.24::DOUBLE * 7.24 - (7.5::DOUBLE - 0.914) * (7.5::DOUBLE - 0.914)) THEN CASE WHEN y < 0.914 OR y > 15 - 0.914 THEN 3 ELSE 2 END WHEN sqrt((x - bx) * (x - bx) + (y - 7.5) * (y - 7.5)) > 7.24 THEN 3 ELSE 2 END AS points FROM q""")
def shot_value_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _court_points(spark, sf_dir).select("p_partkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), boxes.shot_value(F.col("x"), F.col("y")).alias("points"))


@query(f"""WITH {_XY}, h AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 0.001::DOUBLE * x + 0.002::DOUBLE * y + 1 END AS w FROM p), m AS (SELECT p_partkey, (1.1::DOUBLE * x + 0.05::DOUBLE * y - 0.6) / w AS cx, (0.02::DOUBLE * x + 1.05::DOUBLE * y - 0.3) / w AS cy FROM h)
SELECT p_partkey, round(cx, 6) AS cx, round(cy, 6) AS cy, cx IS NULL AS unsolved, cx IS NULL OR (cx BETWEEN -0.5 AND 28.5 AND cy BETWEEN -0.5 AND 15.5) AS kept FROM m""")
def on_court_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.when(F.col("p_partkey") % 9 != 0, F.array(*[F.lit(v) for v in (1.1, 0.05, -0.6, 0.02, 1.05, -0.3, 0.001, 0.002, 1.0)]))
    cx, cy = boxes.mapped(h, F.col("x"), F.col("y"))
    m = _court_points(spark, sf_dir).select("p_partkey", cx.alias("cx"), cy.alias("cy"))
    inside = boxes.on_court(F.col("cx"), F.col("cy"), 0.5)
    return m.select("p_partkey", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.col("cx").isNull().alias("unsolved"), (F.col("cx").isNull() | inside).alias("kept"))


@query(f"""WITH {_XY}, l(landmark, lx, ly) AS (SELECT i * 4 + j, i * 5.6::DOUBLE, j * 5.0::DOUBLE FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(4)) AS j)), r AS (SELECT p_partkey AS name, landmark, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS d FROM p, l WHERE p_partkey % 10 >= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, landmark) AS n FROM r WHERE d <= 2.0) SELECT name, landmark, round(d, 6) AS distance FROM k WHERE n = 1""")
def nearest_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.range(24).select(F.col("id").alias("landmark"), (F.floor(F.col("id") / 4) * F.lit(5.6)).alias("lx"), (F.col("id") % 4 * F.lit(5.0)).alias("ly"))
    points = _court_points(spark, sf_dir).select(F.col("p_partkey").alias("name"), "x", "y", (F.col("p_partkey") % 10).alias("sightings"), F.lit(1.0).alias("spread"))
    return fusion.nearest_landmark(points, i).withColumn("distance", F.round("distance", 6))


@query("""WITH i AS (SELECT l_orderkey AS image, median(l_quantity) AS m, count(*) AS n FROM lineitem WHERE CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END BETWEEN 0.25 AND 3.0 GROUP BY l_orderkey) SELECT o_orderkey AS image, coalesce(n, 0) AS boxes, n >= 3 AND m < 25 AS wide FROM orders LEFT JOIN i ON image = o_orderkey""")
def wide_shot_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "lineitem").where(boxes.plausible_aspect(F.col("l_discount"), F.col("l_tax")))
    i = good.groupBy(F.col("l_orderkey").alias("image")).agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")).join(i, "image", "left")
    return images.select("image", F.coalesce("n", F.lit(0)).alias("boxes"), ((F.col("n") >= 3) & (F.col("m") < 25)).alias("wide"))
