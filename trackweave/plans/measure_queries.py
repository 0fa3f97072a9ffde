"""Queries over counts, rates, shares, windows, reports and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import measures
from trackweave.operators.tasks import spread
from trackweave.plans.inputs import EVENTS_SQL, SPANS_SQL, events, order_spans
from trackweave.plans.registry import query, table


@query("SELECT split_part(split_part(o_orderstatus || ' in view of ' || o_orderpriority || ', ' || o_custkey, ',', 1), ' in view', 1) AS reason, count(*) AS n FROM orders GROUP BY 1")
def reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat("o_orderstatus", F.lit(" in view of "), "o_orderpriority", F.lit(", "), "o_custkey")
    return measures.reason_groups(table(spark, sf_dir, "orders").select(reason.alias("reason")), "reason")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_SHOTS = "z AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS made, count(*) FILTER (event_type IN ('purchase', 'click')) AS attempts FROM events GROUP BY user_id)"


def _shots(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("made"), F.count_if(kind.isin("purchase", "click")).alias("attempts"))


@query(f"WITH {_SHOTS} SELECT user_id, made, attempts, round(CASE WHEN attempts > 0 THEN made * 100.0::DOUBLE / attempts ELSE 0 END, 4) AS pct, greatest(100.0::DOUBLE, attempts::DOUBLE) AS span FROM z")
def shot_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = measures.percent(F.col("made"), F.col("attempts"))
    return _shots(spark, sf_dir).withColumn("pct", F.round(pct, 4)).withColumn("span", measures.bar_span(F.col("attempts").cast("double")))


@query(f"WITH {_SHOTS} SELECT user_id % 6 AS zone, CAST(sum(made) AS BIGINT) AS made, CAST(sum(attempts) AS BIGINT) AS attempts FROM z GROUP BY 1")
def zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(spark, sf_dir).groupBy((F.col("user_id") % 6).alias("zone")).agg(F.sum("made").alias("made"), F.sum("attempts").alias("attempts"))


@query(f"WITH {_SHOTS} SELECT user_id, made, attempts, row_number() OVER (ORDER BY made DESC, attempts DESC, user_id) AS rank FROM z QUALIFY rank <= 25")
def box_score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.ranked(_shots(spark, sf_dir), [F.desc("made"), F.desc("attempts"), F.asc("user_id")], 25)


@query("""WITH p AS (SELECT l_orderkey, max(l_linestatus) AS guess FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
SELECT count(*) FILTER (guess = o_orderstatus) AS hits, count(*) AS total, round(count(*) FILTER (guess = o_orderstatus)::DOUBLE / count(*), 6) AS accuracy FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def classification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("guess"))
    out = measures.accuracy(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), guess, ["o_orderkey"], "o_orderstatus", "guess")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH x AS (SELECT label, p, q, embedding[p + 1]::DOUBLE - embedding[q + 1]::DOUBLE AS s FROM embeddings, (SELECT unnest(range(12)) AS p) a, (SELECT unnest(range(12)) AS q) b WHERE p < q),
g AS (SELECT label, p, q, count(*) FILTER (s > 0) AS n1, count(*) FILTER (s <= 0) AS n0, avg(s) FILTER (s > 0) AS m1, avg(s) FILTER (s <= 0) AS m0, stddev_pop(s) FILTER (s > 0) AS d1, stddev_pop(s) FILTER (s <= 0) AS d0 FROM x GROUP BY label, p, q),
c AS (SELECT label, p, q, round(abs(m1 - m0) / nullif((d1 + d0) / 2, 0) * least(n1, n0)::DOUBLE / (n1 + n0) / 0.5, 6) AS contrast FROM g WHERE n1 >= 2 AND n0 >= 2)
SELECT label, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, contrast FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY contrast DESC NULLS LAST, p, q) = 1""")
def best_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.best_contrast(table(spark, sf_dir, "embeddings"), "label", "embedding", 12)


@query("""WITH p AS (SELECT l_suppkey, (l_partkey % 50)::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem), m AS (SELECT l_suppkey, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM p GROUP BY l_suppkey)
SELECT l_suppkey, mx AS mid_x, my AS mid_y, round(quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 0.5), 6) AS spread, count(*) AS n FROM p JOIN m USING (l_suppkey) GROUP BY l_suppkey, mx, my""")
def landmark_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return measures.landmark_spread(p, "l_suppkey", "x", "y").withColumn("spread", F.round("spread", 6))


_NOW = 1706400000
_JOBS = f"j AS (SELECT user_id, min(s) AS started, max(s) AS updated, count(*) AS done, count(*) + user_id % 5 AS total FROM e GROUP BY user_id)"


@query(f"""WITH {EVENTS_SQL}, {_JOBS} SELECT user_id, round(CASE WHEN {_NOW} > started THEN done / ({_NOW} - started)::DOUBLE END, 9) AS rate, round(CASE WHEN {_NOW} > started THEN (total - done) / (done / ({_NOW} - started)::DOUBLE) END, 3) AS eta, CAST({_NOW} - updated AS DOUBLE) AS silence,
CASE WHEN {_NOW} - updated > 1800 THEN 'stale' WHEN {_NOW} - updated > 90 THEN 'quiet' ELSE 'live' END AS pulse FROM j""")
def job_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = events(spark, sf_dir).groupBy("user_id").agg(F.min("s").alias("started"), F.max("s").alias("updated"), F.count("*").alias("done"), (F.count("*") + F.first("user_id") % 5).alias("total"))
    out = measures.job_rates(jobs, float(_NOW))
    return out.select("user_id", F.round("rate", 9).alias("rate"), F.round("eta", 3).alias("eta"), "silence", "pulse")


@query("SELECT count(DISTINCT list_last(string_split(url, '/'))) AS clips, count(*) FILTER (page_id % 3 = 1 AND page_id % 4000 <= 1800) AS live FROM pages")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 3 == 1, "running").otherwise("done").alias("state"), (F.col("page_id") % 4000).alias("silence"))
    return measures.live_counts(runs, "url", "state", "silence")


@query(f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS labels, round(count(*)::DOUBLE / (SELECT count(DISTINCT day) FROM e), 6) AS per_frame FROM e GROUP BY event_type")
def contention_of_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return measures.mean_per_frame(e, "event_type", "day", e).withColumn("per_frame", F.round("per_frame", 6))


_DAILY = "d AS (SELECT user_id, day, avg(value) AS x, count(*) AS n FROM e GROUP BY user_id, day)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("x"), F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, {_DAILY} SELECT user_id, day, round(sqrt((x - lag(x) OVER w) ** 2 + (n - lag(n) OVER w) ** 2), 6) AS step FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def keypoint_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.jitter(_daily(spark, sf_dir), ["user_id"], "day", "x", "n").select("user_id", "day", F.round("step", 6).alias("step"))


@query(f"""WITH {SPANS_SQL}, h AS (SELECT o_custkey, o_orderstatus, sum(e - s + 1) / 59.94::DOUBLE AS seconds FROM o GROUP BY o_custkey, o_orderstatus), c AS (SELECT o_custkey, (max(e) - min(s) + 1) / 59.94::DOUBLE AS clip FROM o GROUP BY o_custkey)
SELECT o_custkey, o_orderstatus, round(seconds, 6) AS seconds, round(seconds / clip, 6) AS share FROM h JOIN c USING (o_custkey)""")
def duration_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.duration_share(order_spans(spark, sf_dir), ["o_orderstatus"], "o_custkey", 59.94)
    return out.withColumn("seconds", F.round("seconds", 6)).withColumn("share", F.round("share", 6))


_PROBES = [(0.0, 0.0), (20.0, 10.0), (5.0, 14.0)]
_SEEN = ", ".join(f"((1 + n * 0.01::DOUBLE) * {x} + x) / (n * 0.001::DOUBLE * {x} + 1) AS x{i}, ({y} + n * 3) / (n * 0.001::DOUBLE * {x} + 1) AS y{i}" for i, (x, y) in enumerate(_PROBES))
_GAPS = " + ".join(f"sqrt((x{i} - (lag(x{i}) OVER w + lead(x{i}) OVER w) / 2) ** 2 + (y{i} - (lag(y{i}) OVER w + lead(y{i}) OVER w) / 2) ** 2)" for i in range(3))


@query(f"""WITH {EVENTS_SQL}, {_DAILY}, h AS (SELECT user_id, day, n < 4 AS solved, {_SEEN} FROM d),
w AS (SELECT user_id, day, CASE WHEN solved AND lag(solved) OVER w AND lead(solved) OVER w THEN ({_GAPS}) / 3 END AS wobble FROM h WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(wobble, 5) AS wobble, coalesce(wobble > 30, false) AS suspect FROM w""")
def homography_wobble(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = _daily(spark, sf_dir).select("user_id", "day", (F.col("n") < 4).alias("solved"), F.array(1 + n * 0.01, zero, F.col("x"), zero, one, n * 3, n * 0.001, zero, one).alias("h"))
    return measures.wobble(rows, ["user_id"], "day", "solved", "h", _PROBES).select("user_id", "day", F.round("wobble", 5).alias("wobble"), "suspect")


_WINDOWS = f"""{EVENTS_SQL}, f AS (SELECT event_type, s // 3600 AS frame, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT event_type, s // 3600 AS a, s // 3600 + 2 AS b FROM e WHERE value > 80),
t AS (SELECT event_type, min(frame) AS t0, max(frame) + 1 AS t1 FROM f GROUP BY event_type), w AS (SELECT event_type, t0 + k * 24 AS ws FROM (SELECT *, unnest(range(0, (t1 - t0 - 48) // 24 + 1)) AS k FROM t WHERE t1 - t0 >= 48)),
p AS (SELECT event_type, ws, avg((n < 2)::INT) AS short_share, min(n) AS least, avg(n) AS mean FROM w JOIN f USING (event_type) WHERE frame >= ws AND frame < ws + 48 GROUP BY event_type, ws),
q AS (SELECT event_type, ws, CAST(sum(least(b, ws + 48) - greatest(a, ws)) AS BIGINT) AS contact FROM w JOIN c USING (event_type) WHERE b > ws AND a < ws + 48 GROUP BY event_type, ws),
m AS (SELECT event_type, ws AS window_start, short_share, least, mean, coalesce(contact, 0) AS contact FROM p LEFT JOIN q USING (event_type, ws))"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("frame", F.expr("s div 3600"))
    frames = e.groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    contacts = e.where("value > 80").select("event_type", F.col("frame").alias("start"), (F.col("frame") + 2).alias("end"))
    return measures.windows_inside(contacts, frames, ["event_type"], width=48, full=2)


@query(f"WITH {_WINDOWS} SELECT event_type, window_start, round(short_share, 6) AS short_share, least, round(mean, 6) AS mean, contact FROM m")
def windows_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("short_share", F.round("short_share", 6)).withColumn("mean", F.round("mean", 6)).select("event_type", "window_start", "short_share", "least", "mean", "contact")


@query(f"WITH {_WINDOWS} SELECT event_type, window_start, row_number() OVER (PARTITION BY event_type ORDER BY contact, round(short_share, 6), round(mean, 6) DESC, window_start) AS rank FROM m QUALIFY rank <= 3")
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _windows(spark, sf_dir).withColumn("short_share", F.round("short_share", 6)).withColumn("mean", F.round("mean", 6))
    return measures.best_windows(rounded, ["event_type"], 3).select("event_type", "window_start", "rank")


_REPORT = """l AS (SELECT o_orderpriority AS clip, o_orderkey AS frame, l_suppkey % 7 AS tid, l_returnflag AS club FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 20),
pc AS (SELECT clip, frame, club, count(*) AS n, count(DISTINCT tid) AS t FROM l GROUP BY ALL), pf AS (SELECT clip, frame, sum(n) AS n, sum(n - t) AS doubles, list_sort(list(n)) AS clubs FROM pc GROUP BY clip, frame),
f AS (SELECT o_orderpriority AS clip, o_orderkey AS frame, coalesce(n, 0) AS n, doubles, clubs FROM orders LEFT JOIN pf ON pf.clip = o_orderpriority AND pf.frame = o_orderkey),
r AS (SELECT clip, count(*) AS frames, CAST(sum(n) AS BIGINT) AS labels, CAST(coalesce(sum(doubles), 0) AS BIGINT) AS doubles, avg((n >= 4)::INT) AS full_share, avg(n) AS mean, count(*) FILTER (n < 4) AS short_frames, count(*) FILTER (clubs = [5, 5]) AS five_a_side FROM f GROUP BY clip)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("clip"), F.col("o_orderkey").alias("frame"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 7).alias("tid"), F.col("l_returnflag").alias("club"))
    n = table(spark, sf_dir, "lineitem").count()  # from the file's footer
    labels = spread(lines, "frame", count=n).join(spread(orders, "frame", count=n), "frame")
    return measures.segment_report(labels, orders, "clip", "frame", "tid", "club", full=4, count=n)


@query(f"WITH {_REPORT} SELECT clip, frames, labels, doubles, round(full_share, 6) AS full_share, round(mean, 6) AS mean, short_frames, five_a_side, round(mean / 4, 6) AS proxy, doubles = 0 AND short_frames = 0 AS verdict FROM r")
def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _report(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in ("full_share", "mean", "proxy")})


@query(f"WITH {_REPORT} SELECT clip, row_number() OVER (ORDER BY round(mean / 4, 6) DESC, frames DESC, clip) AS rank FROM r")
def report_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _report(spark, sf_dir).withColumn("proxy", F.round("proxy", 6))
    return measures.ranked(reports, [F.desc("proxy"), F.desc("frames"), F.asc("clip")], 400).select("clip", "rank")


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS frames FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def player_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = measures.player_timeline(labels, table(spark, sf_dir, "customer"), "c_custkey", "o_orderkey")
    return out.select("c_custkey", F.array_join("frames", ",").alias("frames"))


_SHOTS_BY_USER = f"{EVENTS_SQL}, u AS (SELECT user_id, min(day) AS a, max(day) AS b FROM e GROUP BY user_id)"


@query(f"WITH {_SHOTS_BY_USER} SELECT user_id, b - a AS length, row_number() OVER (ORDER BY b - a DESC, a DESC, b DESC, user_id) AS rank FROM u WHERE b - a >= 3 QUALIFY rank <= 12")
def longest_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).withColumn("length", F.col("b") - F.col("a"))
    return measures.ranked(u.where("length >= 3"), [F.desc("length"), F.desc("a"), F.desc("b"), F.asc("user_id")], 12).select("user_id", "length", "rank")


@query("""WITH x AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'R') AS fn FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, fp + fn AS errors, row_number() OVER (ORDER BY fp + fn DESC, l_orderkey DESC) AS rank FROM x WHERE fp + fn > 0 QUALIFY rank <= 8""")
def worst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(flag == "A") + F.count_if(flag == "R")).alias("errors"))
    return measures.ranked(x.where("errors > 0"), [F.desc("errors"), F.desc("l_orderkey")], 8)


@query(f"WITH {SPANS_SQL}, d AS (SELECT o_custkey, o_orderkey, e - s AS frames, o_totalprice FROM o) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM d QUALIFY rank <= 10")
def residuals_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.ranked(order_spans(spark, sf_dir), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, ["o_custkey"]).select("o_custkey", "o_orderkey", "rank")


@query(f"WITH {EVENTS_SQL}, d AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY user_id, day) SELECT user_id, arg_max(day, n * 100000 - day) AS frame, max(n) AS kept FROM d GROUP BY user_id")
def best_scan_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return measures.ranked(d, [F.desc("n"), F.asc("day")], 1, ["user_id"]).select("user_id", F.col("day").alias("frame"), F.col("n").alias("kept"))
