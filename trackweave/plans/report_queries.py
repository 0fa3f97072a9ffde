"""Queries over cleaned paths, stacked labels, clip reports, routes and identities under people's decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import names
from trackweave.operators import assign, layout, paths, reports, runs
from trackweave.operators.paths import smoothing_weights
from trackweave.plans.inputs import BOXES_SQL, line_boxes
from trackweave.plans.registry import query, table

_WEIGHTS = "[" + ", ".join("[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in smoothing_weights(w, 2)) + "]" for w in (5, 7, 9)) + "]"


@query(f"""WITH g AS (SELECT l_suppkey % 5 AS tid, l_orderkey AS frame, min(l_partkey % 10) AS p, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT tid, frame, p::DOUBLE / 50 + frame % 2000 * 0.01::DOUBLE + CASE WHEN frame % 300 BETWEEN 40 AND 45 THEN 5 ELSE 0 END AS x, 1 + n::DOUBLE / 20 AS y FROM g),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY tid ORDER BY frame) AS run FROM p),
i AS (SELECT *, row_number() OVER (PARTITION BY tid, run ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY tid, run) AS n, sqrt((x - lag(x) OVER (PARTITION BY tid, run ORDER BY frame)) ** 2 + (y - lag(y) OVER (PARTITION BY tid, run ORDER BY frame)) ** 2) AS d FROM r),
m AS (SELECT *, median(d) OVER (PARTITION BY tid, run) AS m FROM i),
s AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY tid, run) AS s FROM m),
j AS (SELECT *, coalesce(d > greatest(0.6::DOUBLE * 0.3048::DOUBLE, m + 3.5::DOUBLE * 1.4826::DOUBLE * s), false) AS j FROM s),
k AS (SELECT *, max(CASE WHEN j THEN i END) OVER w AS last, min(CASE WHEN j THEN i END) OVER (PARTITION BY tid, run ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, count(*) FILTER (j) OVER w AS c, j AND coalesce(i - max(CASE WHEN j THEN i END) OVER (PARTITION BY tid, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 18, true) AS head FROM j WINDOW w AS (PARTITION BY tid, run ORDER BY frame)),
o AS (SELECT *, coalesce((c - max(CASE WHEN head THEN c END) OVER (PARTITION BY tid, run ORDER BY frame)) % 2 = 0 AND nxt - last <= 18, false) AS near FROM k),
q AS (SELECT *, bool_or(near) OVER (PARTITION BY tid, run ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS off FROM o),
a AS (SELECT *, last_value(CASE WHEN NOT off THEN i END IGNORE NULLS) OVER (PARTITION BY tid, run ORDER BY frame) AS a, first_value(CASE WHEN NOT off THEN i END IGNORE NULLS) OVER (PARTITION BY tid, run ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM q),
e AS (SELECT *, off AND n >= 5 AND bool_and(a IS NOT NULL AND b IS NOT NULL) OVER (PARTITION BY tid, run) AS edited FROM a),
f AS (SELECT e.*, CASE WHEN e.edited THEN l.x + (e.i - e.a) / (e.b - e.a) * (h.x - l.x) ELSE e.x END AS px, CASE WHEN e.edited THEN l.y + (e.i - e.a) / (e.b - e.a) * (h.y - l.y) ELSE e.y END AS py FROM e LEFT JOIN e l ON l.tid = e.tid AND l.run = e.run AND l.i = e.a LEFT JOIN e h ON h.tid = e.tid AND h.run = e.run AND h.i = e.b),
w AS (SELECT tid, run, i, frame, n, edited, least(9, n - (n + 1) % 2) AS size FROM f),
v AS (SELECT *, greatest(0, least(i - (size - 1) // 2, n - size)) AS low FROM w),
u AS (SELECT v.tid, v.frame, sum(({_WEIGHTS})[(v.size - 5) // 2 + 1][v.i - v.low + 1][f.i - v.low + 1] * f.px) AS x, sum(({_WEIGHTS})[(v.size - 5) // 2 + 1][v.i - v.low + 1][f.i - v.low + 1] * f.py) AS y FROM v JOIN f ON f.tid = v.tid AND f.run = v.run AND f.i BETWEEN v.low AND v.low + v.size - 1 WHERE v.n >= 5 GROUP BY v.tid, v.frame)
SELECT e.tid, e.frame, round(CASE WHEN e.n >= 5 THEN u.x ELSE e.x END, 5) AS x, round(CASE WHEN e.n >= 5 THEN u.y ELSE e.y END, 5) AS y, e.edited FROM e LEFT JOIN u ON u.tid = e.tid AND u.frame = e.frame""")
def cleaned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames of five tracks that jump away for six frames in every three hundred."""
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("tid"), F.col("l_orderkey").alias("frame")).agg(F.min(F.col("l_partkey") % 10).alias("p"), F.min("l_linenumber").alias("n"))
    away = F.when((F.col("frame") % 300).between(40, 45), 5).otherwise(0)
    rows = li.select("tid", "frame", (F.col("p") / 50 + F.col("frame") % 2000 * 0.01 + away).alias("x"), (1 + F.col("n") / 20).alias("y"))
    out = paths.cleaned(rows, ["tid"], places=5, count=table(spark, sf_dir, "lineitem").count())
    return out.select("tid", "frame", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "edited")


@query(f"""WITH RECURSIVE {BOXES_SQL}, g AS (SELECT frame, tid, min(x1) AS x1, min(x2) AS x2, min(y2) AS y2 FROM b GROUP BY frame, tid), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y2, tid) AS i FROM g),
s AS (SELECT frame, i, tid, 0 AS r, y2, [{{'x1': x1, 'x2': x2, 'y': y2}}] AS taken FROM o WHERE i = 1
 UNION ALL SELECT o.frame, o.i, o.tid, f.r, o.y2, list_append(s.taken, {{'x1': o.x1, 'x2': o.x2, 'y': o.y2 + f.r * 10}}) FROM s JOIN o ON o.frame = s.frame AND o.i = s.i + 1, LATERAL (SELECT min(r) AS r FROM range(16) x(r) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(s.taken) AS t) WHERE abs(o.y2 + r * 10 - t.y) < 10 AND NOT (o.x2 < t.x1 OR o.x1 > t.x2))) f)
SELECT frame, tid, CAST(r AS INTEGER) AS row, y2 + r * 10.0::DOUBLE AS label_y FROM s""")
def stacked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = line_boxes(spark, sf_dir).groupBy("frame", "tid").agg(F.min("x1").alias("x1"), F.min("x2").alias("x2"), F.min("y2").alias("y2"))
    return layout.stacked(boxes, ["frame"], "tid", 10.0).select("frame", "tid", "row", "label_y")


_REPORT = """WITH tr AS (SELECT DISTINCT l_orderkey // 1500 AS clip, l_orderkey % 1500 AS frame, l_linenumber AS tid FROM lineitem),
ident AS (SELECT DISTINCT clip, tid, (tid % 6 + 1)::VARCHAR AS number, CASE WHEN tid % 2 = 1 THEN 'a' ELSE 'b' END AS club, 'p' || tid % 6 AS name, CASE WHEN (clip + tid) % 9 = 0 THEN 'mixed-kit' END AS ignored FROM tr),
lab AS (SELECT tr.clip, frame, tr.tid, club, number FROM tr JOIN ident USING (clip, tid) WHERE ignored IS NULL),
pf AS (SELECT clip, frame, count(*) AS boxes FROM tr GROUP BY clip, frame),
lf AS (SELECT clip, frame, sum(n) AS labels, count(*) FILTER (n > 1) AS twice FROM (SELECT clip, frame, club, number, count(*) AS n FROM lab GROUP BY ALL) GROUP BY clip, frame),
f AS (SELECT clip, frame, boxes, coalesce(labels, 0) AS labels, coalesce(twice, 0) AS twice FROM pf LEFT JOIN lf USING (clip, frame)),
pl AS (SELECT clip, club, number, tid FROM ident WHERE ignored IS NULL),
sz AS (SELECT clip, sum(n) AS players, list(n ORDER BY n) AS sizes FROM (SELECT clip, club, count(DISTINCT number) AS n FROM pl GROUP BY clip, club) GROUP BY clip),
li AS (SELECT clip, tid, min(frame) AS a, max(frame) AS b FROM tr GROUP BY clip, tid),
cl AS (SELECT p.clip, count(*) AS clashes FROM pl p JOIN pl q ON p.clip = q.clip AND p.club = q.club AND p.number = q.number AND p.tid < q.tid JOIN li x ON x.clip = p.clip AND x.tid = p.tid JOIN li y ON y.clip = q.clip AND y.tid = q.tid WHERE least(x.b, y.b) - greatest(x.a, y.a) + 1 > 5 GROUP BY p.clip),
g AS (SELECT clip, list(ignored || ' ' || n ORDER BY ignored) AS gates FROM (SELECT clip, ignored, count(*) AS n FROM ident WHERE ignored IS NOT NULL GROUP BY clip, ignored) GROUP BY clip),
r AS (SELECT f.clip, count(*) AS frames, avg(boxes) AS mean_boxes, avg(labels) AS mean_labels, avg((labels >= 3)::INT) AS full_share, count(*) FILTER (labels < 3) AS short_frames, min(labels) AS lowest, sum(twice) AS doubles FROM f GROUP BY f.clip),
x AS (SELECT r.*, (SELECT count(*) FROM ident i WHERE i.clip = r.clip) AS tracks, coalesce(players, 0) AS players, coalesce(sizes, []) AS sizes, coalesce(clashes, 0) AS clashes, coalesce(gates, []) AS gates FROM r LEFT JOIN sz USING (clip) LEFT JOIN cl USING (clip) LEFT JOIN g USING (clip))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as tracks, lines 1 and 7 as one player."""
    k, tid = F.col("l_orderkey"), F.col("tid")
    tracks = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 1500").alias("clip"), (k % 1500).alias("frame"), F.col("l_linenumber").cast("long").alias("tid")).distinct()
    identities = tracks.select("clip", "tid").distinct().select("clip", "tid", F.when(tid % 2 == 1, "a").otherwise("b").alias("club"), (tid % 6 + 1).cast("string").alias("number"), F.concat(F.lit("p"), tid % 6).alias("name"), F.when((F.col("clip") + tid) % 9 == 0, "mixed-kit").alias("ignored"))
    labels = tracks.join(identities.where("ignored is null"), ["clip", "tid"]).select("clip", "frame", "tid", "club", "number")
    return reports.clip_report(tracks, identities, labels, fps=10.0, full=3)


@query(f"{_REPORT} SELECT clip, frames, round(mean_boxes, 6) AS mean_boxes, round(mean_labels, 6) AS mean_labels, round(full_share, 6) AS full_share, short_frames, CAST(lowest AS BIGINT) AS lowest, CAST(doubles AS BIGINT) AS doubles, tracks, CAST(players AS BIGINT) AS players, array_to_string(sizes, ',') AS club_sizes, clashes, array_to_string(gates, ',') AS gates, round(frames / 10.0::DOUBLE, 6) AS seconds, round(mean_labels / 3, 6) AS proxy, 'not ready' AS verdict FROM x")
def clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _report(spark, sf_dir)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_boxes", "mean_labels", "full_share", "seconds", "proxy")]
    return r.select("clip", "frames", "short_frames", "lowest", "doubles", "tracks", "players", F.array_join(F.col("club_sizes").cast("array<string>"), ",").alias("club_sizes"), "clashes", F.array_join("gates", ",").alias("gates"), "verdict", *rounded)


@query(f"""{_REPORT}, c AS (SELECT clip, 0 AS i, 'five a side - ' || array_to_string(sizes, ', ') AS note, sizes = [5, 5] AS ok FROM x UNION ALL SELECT clip, 1, 'labels in every frame - ' || short_frames || ' of ' || frames || ' frames short', short_frames = 0 FROM x
 UNION ALL SELECT clip, 2, 'no player drawn twice - ' || doubles || ' frames', doubles = 0 FROM x UNION ALL SELECT clip, 3, 'no shared identity - ' || clashes || ' pairs', clashes = 0 FROM x)
SELECT clip, count(*) FILTER (ok) AS passed, count(*) AS total, coalesce(string_agg(clip || ': ' || note, '; ' ORDER BY i) FILTER (NOT ok), '') AS notes FROM c GROUP BY clip""")
def failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.failed_checks(reports.checks(_report(spark, sf_dir)))
    return out.select("clip", "passed", "total", F.array_join("notes", "; ").alias("notes"))


@query("""WITH a AS (SELECT 'c' || o_custkey % 40 || CASE WHEN o_orderkey % 3 = 0 THEN '_fused' ELSE '' END AS stem, o_totalprice FROM orders WHERE o_orderkey % 4 < 3), s AS (SELECT stem, sum(o_totalprice) / 60 AS minutes FROM a GROUP BY stem),
r AS (SELECT DISTINCT 'c' || c_custkey % 50 || CASE WHEN c_nationkey % 2 = 0 THEN '_fused' ELSE '' END AS stem, c_custkey % 50 AS n, (c_custkey % 50 * 7 % 11)::DOUBLE / 10 + CASE WHEN c_nationkey % 2 = 0 THEN 0.05 ELSE 0 END AS precision FROM customer),
j AS (SELECT r.stem, precision, CASE WHEN n % 9 > 0 THEN 'v' || n // 3 END AS video, minutes FROM r LEFT JOIN s USING (stem)), t AS (SELECT video, max(precision) AS top FROM j GROUP BY video)
SELECT j.stem, round(precision, 3) AS precision, j.video, round(minutes, 2) AS minutes, coalesce(precision = top AND top > 0, false) AS best FROM j JOIN t ON t.video IS NOT DISTINCT FROM j.video""")
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, fused = F.col("o_orderkey"), lambda c: F.when(c, "_fused").otherwise("")
    tail = F.when(k % 4 == 0, "_tracks.json").when(k % 4 == 1, "_ident.json").when(k % 4 == 2, "_report.json").otherwise(".mp4")
    done = table(spark, sf_dir, "orders").select(F.concat(F.lit("out/c"), F.col("o_custkey") % 40, fused(k % 3 == 0), tail).alias("artifact"), F.col("o_totalprice").cast("double").alias("elapsed"))
    n, even = F.col("c_custkey") % 50, F.col("c_nationkey") % 2 == 0
    rep = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), n, fused(even)).alias("stem"), n.alias("n"), ((n * 7 % 11) / 10 + F.when(even, 0.05).otherwise(0.0)).alias("precision")).distinct()
    sources = rep.where("n % 9 > 0").select("stem", F.concat(F.lit("v"), F.expr("n div 3")).alias("video"))
    out = reports.routes(rep.drop("n"), done, sources)
    return out.select("stem", F.round("precision", 3).alias("precision"), "video", F.round("minutes", 2).alias("minutes"), "best")


@query()
def refined_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a range of orders as candidates, linked where they share an order's part class."""
    li = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("clip"), F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 60).alias("member"))
    edges = li.where("key <> member").distinct()
    sharp = li.groupBy("clip", "key").agg(F.sum("member").cast("double").alias("sharp"))
    return assign.refined_covers(edges, sharp, "clip", 8)


@query("""WITH p AS (SELECT c_custkey // 10 AS clip, c_custkey AS tid, (c_nationkey)::VARCHAR AS number, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'ignored' WHEN 2 THEN 'jersey-ocr' END AS identity, CASE WHEN c_custkey % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM customer),
i AS (SELECT o_custkey AS tid, max(o_orderkey % 100) AS k FROM orders GROUP BY o_custkey),
j AS (SELECT p.*, CASE WHEN k % 7 > 0 THEN k::VARCHAR END AS n, CASE WHEN k % 3 > 0 THEN 'player ' || k END AS m, CASE WHEN k % 2 = 0 THEN 'home' ELSE 'away' END AS to_side, k % 5 > 0 AND clip % 4 > 0 AS has_side FROM p LEFT JOIN i USING (tid)),
o AS (SELECT *, n IS NOT NULL AND (identity IS NULL OR identity NOT IN ('human', 'ignored')) AS open FROM j)
SELECT clip, tid, CASE WHEN open THEN n ELSE number END AS number, CASE WHEN open THEN m ELSE name END AS name, CASE WHEN open THEN 'jersey-ocr' ELSE identity END AS identity, CASE WHEN open AND has_side THEN to_side ELSE side END AS side, open AND has_side AND to_side <> side AS moved FROM o""")
def applied_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    decided = F.when(c % 6 == 0, "human").when(c % 6 == 1, "ignored").when(c % 6 == 2, "jersey-ocr")
    players = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("clip"), c.alias("tid"), F.col("c_nationkey").cast("string").alias("number"), F.col("c_name").alias("name"), decided.alias("identity"), F.when(c % 2 == 0, "home").otherwise("away").alias("side"))
    k = F.col("k")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tid")).agg(F.max(F.col("o_orderkey") % 100).alias("k"))
    club = F.when(k % 5 == 0, "nobody's").when(k % 2 == 0, "east").otherwise("west")
    found = found.select(F.expr("tid div 10").alias("clip"), "tid", F.when(k % 7 > 0, k.cast("string")).alias("number"), F.when(k % 3 > 0, F.concat(F.lit("player "), k)).alias("name"), club.alias("club"))
    clips = players.select("clip").distinct().where("clip % 4 > 0")
    sides = clips.select("clip", F.inline(F.array(F.struct(F.lit("east").alias("club"), F.lit("home").alias("side")), F.struct(F.lit("west").alias("club"), F.lit("away").alias("side")))))
    return runs.applied_identities(players, found, sides)


@query("""WITH s AS (SELECT o_orderkey, o_totalprice::DOUBLE / 10 AS s FROM orders)
SELECT o_orderkey, printf('%02d:%02d', CAST(floor(s / 60) AS INTEGER), CAST(floor(s - floor(s / 60) * 60) AS INTEGER)) AS padded, CASE WHEN s < 90 THEN printf('%.0fs', s) WHEN s < 5400 THEN printf('%.0fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS eta FROM s""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_totalprice").cast("double") / 10
    return table(spark, sf_dir, "orders").select("o_orderkey", names.padded_clock(s).alias("padded"), names.eta_text(s).alias("eta"))
