"""Queries over order-dependent and numeric kernels: SQL by recursion where it can go row by row, tests against brute force for the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import assign, court
from trackweave.plans.inputs import BOXES_SQL, events, line_boxes
from trackweave.plans.registry import query, table
from trackweave.streaming import stateful


def _inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def _size(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)} / ({_size(a)} + {_size(b)} - {_inter(a, b)}))"


@query(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_extendedprice DESC, tid) AS i FROM b),
s AS (SELECT frame, i, tid, x1, y1, x2, y2, l_extendedprice, true AS kept, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS held FROM o WHERE i = 1
 UNION ALL SELECT o.frame, o.i, o.tid, o.x1, o.y1, o.x2, o.y2, o.l_extendedprice, k.kept, CASE WHEN k.kept THEN list_append(s.held, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE s.held END FROM s JOIN o ON o.frame = s.frame AND o.i = s.i + 1, LATERAL (SELECT NOT EXISTS (SELECT 1 FROM (SELECT unnest(s.held) AS t) WHERE {_iou("o", "t")} > 0.5) AS kept) k)
SELECT frame, tid, x1, y1, x2, y2, l_extendedprice FROM s WHERE kept""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = line_boxes(spark, sf_dir).select("frame", "tid", "x1", "y1", "x2", "y2", "l_extendedprice")
    return assign.suppressed(boxes, ["frame"], "l_extendedprice", "tid", 0.5)


@query()
def roster_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).groupBy(F.floor(F.col("user_id") / 10).alias("club"), F.col("user_id").alias("tid"), F.col("event_type").alias("number")).agg(F.count("*").cast("double").alias("votes"))
    return assign.assigned(v, ["club"], "tid", "number", "votes", 5)


@query(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY tid, x1, y1, x2, y2) AS i FROM b),
p AS (SELECT d.frame, d.i, t.i AS j, {_iou("d", "t")} AS iou FROM o d JOIN o t ON d.frame = t.frame AND d.tid % 2 = 1 AND t.tid % 2 = 0 WHERE {_iou("d", "t")} >= 0.5),
c AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY i) AS k FROM (SELECT frame, i, list(j ORDER BY iou DESC, j) AS js FROM p GROUP BY frame, i)),
r AS (SELECT frame, k, [js[1]] AS taken FROM c WHERE k = 1 UNION ALL SELECT c.frame, c.k, list_concat(r.taken, list_filter(c.js, lambda j: NOT list_contains(r.taken, j))[1:1]) FROM r JOIN c ON c.frame = r.frame AND c.k = r.k + 1),
n AS (SELECT frame, max(len(taken)) AS tp FROM r GROUP BY frame), g AS (SELECT frame, count(*) FILTER (tid % 2 = 1) AS found, count(*) FILTER (tid % 2 = 0) AS truth FROM b GROUP BY frame)
SELECT frame, coalesce(tp, 0) AS tp, found - coalesce(tp, 0) AS fp, truth - coalesce(tp, 0) AS fn FROM g LEFT JOIN n USING (frame)""")
def detection_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = line_boxes(spark, sf_dir).select("frame", "tid", "x1", "y1", "x2", "y2", (F.col("tid") % 2 == 0).alias("truth"))
    return assign.match_rates(boxes, ["frame"], "truth", "tid", 0.5)


@query()
def tracklet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    lives = e.groupBy(F.floor(F.col("user_id") / 8).alias("clip"), F.col("user_id").alias("tid"), F.floor(F.col("event_id") / 4000).alias("part")).agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("votes"), F.min("event_type").alias("number"))
    lives = lives.select("clip", (F.col("tid") * 100 + F.col("part")).alias("tid"), "number", "votes", "start", "end", F.when(F.col("tid") % 3 > 0, F.col("tid") % 3).cast("double").alias("kit"))
    return assign.tracklet_merges(lives, "clip", 1, 3)


@query("""WITH RECURSIVE k AS (SELECT l_orderkey // 1000 AS clip, l_suppkey AS key, list(DISTINCT l_partkey % 200) AS members FROM lineitem GROUP BY ALL),
s AS (SELECT DISTINCT clip, NULL::BIGINT AS key, 0::BIGINT AS rank, []::BIGINT[] AS seen FROM k
 UNION ALL SELECT clip, key, rank + 1, list_concat(seen, news) FROM (SELECT s.clip, k.key, s.rank, s.seen, list_filter(k.members, lambda m: NOT list_contains(s.seen, m)) AS news FROM s JOIN k ON k.clip = s.clip WHERE s.rank < 12) WHERE len(news) > 0 QUALIFY row_number() OVER (PARTITION BY clip ORDER BY len(news) DESC, key) = 1)
SELECT clip, key, rank FROM s WHERE rank > 0""")
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("clip"), F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 200).alias("member")).distinct()
    return assign.covers(edges, "clip", 12)


@query(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY tid, l_quantity DESC, x1, y1, x2, y2) AS i FROM b),
p AS (SELECT c.frame, c.i, d.i AS j, c.l_quantity < d.l_quantity AS weaker, row_number() OVER (PARTITION BY c.frame ORDER BY c.i, d.i) AS k FROM o c JOIN o d ON c.frame = d.frame AND c.i < d.i WHERE {_inter("c", "d")} / least({_size("c")}, {_size("d")}) >= 0.8),
r AS (SELECT frame, k, [CASE WHEN weaker THEN i ELSE j END] AS gone FROM p WHERE k = 1
 UNION ALL SELECT p.frame, p.k, CASE WHEN list_contains(r.gone, p.i) OR list_contains(r.gone, p.j) THEN r.gone ELSE list_append(r.gone, CASE WHEN p.weaker THEN p.i ELSE p.j END) END FROM r JOIN p ON p.frame = r.frame AND p.k = r.k + 1),
n AS (SELECT frame, arg_max(gone, k) AS gone FROM r GROUP BY frame)
SELECT frame, tid, x1, y1, x2, y2, l_quantity FROM o LEFT JOIN n USING (frame) WHERE NOT coalesce(list_contains(gone, i), false)""")
def fusion_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = line_boxes(spark, sf_dir).select("frame", "tid", "x1", "y1", "x2", "y2", "l_quantity")
    return assign.without_conflicts(boxes, ["frame"], "tid", "l_quantity", 0.8)


@query()
def court_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.select(F.floor(F.col("user_id") / 10).alias("clip"), "day", "event_id", (F.col("value") % 28).alias("x"), (F.col("event_id") * 7 % 150 / 10).cast("double").alias("y"))
    return stateful.tracked(points.select("clip", F.col("day").alias("frame"), F.col("event_id").alias("point"), "x", "y"))


@query()
def homography_dlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    X, Y = (F.col("l_partkey") % 29).cast("double"), (F.col("l_suppkey") * 7 % 16).cast("double")
    w = 0.002 * X + 0.001 * Y + 1
    seen = li.select(F.floor(F.col("l_orderkey") / 4000).alias("clip"), F.floor(F.col("l_orderkey") / 4).alias("frame"), X.alias("court_x"), Y.alias("court_y"), ((40 * X + 3 * Y + 100) / w).alias("x"), ((2 * X + 35 * Y + 60) / w).alias("y"))
    return court.calibrated(seen).select("clip", "frame", "solved", "reason", F.round("rms_px", 3).alias("rms_px"))


@query()
def kit_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label in two clusters, clip by clip of 256 ids, so a group does not grow with the table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pdf.assign(cluster=court.two_means(np.stack(pdf["embedding"].to_list()).astype(float)))[["vec_id", "label", "cluster"]]

    return table(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 256)).applyInPandas(run, "vec_id bigint, label int, cluster int")


@query()
def smoothed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id", F.col("day").alias("frame")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))
    return court.cleaned_paths(d, ["user_id"])


@query()
def chained_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'click'").select(F.floor(F.col("user_id") / 10).alias("clip"), F.col("day").alias("frame"), F.col("value").alias("cx"), F.lit(0.0).alias("cy"))
    return stateful.contacts(rows, "clip", 5.0, 1, 2)


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(v::DOUBLE), 5) AS mean FROM x GROUP BY label, i""")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("""WITH x AS (SELECT p, q, embedding[p + 1]::DOUBLE - embedding[q + 1]::DOUBLE AS s FROM embeddings, (SELECT unnest(range(12)) AS p) a, (SELECT unnest(range(12)) AS q) b WHERE p < q),
g AS (SELECT p, q, count(*) FILTER (s > 0) AS n1, count(*) FILTER (s <= 0) AS n0, avg(s) FILTER (s > 0) AS m1, avg(s) FILTER (s <= 0) AS m0, stddev_pop(s) FILTER (s > 0) AS d1, stddev_pop(s) FILTER (s <= 0) AS d0 FROM x GROUP BY p, q)
SELECT CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, round(abs(m1 - m0) / ((d1 + d0) / 2) * least(n1, n0)::DOUBLE / (n1 + n0) / 0.5, 5) AS contrast FROM g WHERE n1 >= 2 AND n0 >= 2""")
def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(p, q) for p in range(12) for q in range(p + 1, 12)]
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), (F.col("embedding")[p].cast("double") - F.col("embedding")[q].cast("double")).alias("s")) for p, q in pairs]))
    x = table(spark, sf_dir, "embeddings").select(cells.alias("c")).select("c.*")
    up, down = F.when(F.col("s") > 0, F.col("s")), F.when(F.col("s") <= 0, F.col("s"))
    g = x.groupBy("p", "q").agg(F.count(up).alias("n1"), F.count(down).alias("n0"), F.avg(up).alias("m1"), F.avg(down).alias("m0"), F.stddev_pop(up).alias("d1"), F.stddev_pop(down).alias("d0")).where("n1 >= 2 and n0 >= 2")
    contrast = F.abs(F.col("m1") - F.col("m0")) / ((F.col("d1") + F.col("d0")) / 2) * F.least("n1", "n0") / (F.col("n1") + F.col("n0")) / 0.5
    return g.select("p", "q", F.round(contrast, 5).alias("contrast"))
