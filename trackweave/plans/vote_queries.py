"""Queries over votes, margins, gates and identity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.operators import evaluate, votes
from trackweave.plans.inputs import EVENTS_SQL, events, line_boxes
from trackweave.plans.registry import query, table

_LEADERS = f"""{EVENTS_SQL},
t AS (SELECT user_id, event_type, count(*) AS votes FROM e GROUP BY user_id, event_type),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM t),
l AS (SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS top_value, max(CASE WHEN r = 1 THEN votes END) AS top_votes, coalesce(max(CASE WHEN r = 2 THEN votes END), 0) AS second_votes, CAST(sum(votes) AS BIGINT) AS total_votes FROM k GROUP BY user_id)"""


@query(f"WITH {_LEADERS} SELECT * FROM t")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.tally(events(spark, sf_dir), ["user_id"], "event_type")


@query(f"WITH {_LEADERS} SELECT *, top_votes - second_votes >= greatest(2.0::DOUBLE, 0.2::DOUBLE * total_votes) AS decisive, top_votes >= 2 AND top_votes > second_votes AS confirmed FROM l")
def vote_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.leaders(votes.tally(events(spark, sf_dir), ["user_id"], "event_type"), ["user_id"], "event_type")


@query(f"WITH {_LEADERS} SELECT event_id, user_id, event_type, top_value, event_type = top_value AS agrees FROM e JOIN l USING (user_id)")
def own_majority_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return votes.agreement(e, ["user_id"], "event_type")


@query(f"WITH {_LEADERS} SELECT user_id, total_votes FROM l WHERE total_votes >= 15 AND NOT (top_votes - second_votes >= greatest(2.0::DOUBLE, 0.2::DOUBLE * total_votes))")
def mixed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.mixed(votes.tally(events(spark, sf_dir), ["user_id"], "event_type"), ["user_id"], "event_type")


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, row_number() OVER w AS k, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, k > 1 AS demoted, CASE WHEN k > 1 THEN f END AS duplicate_of FROM r""")
def duplicate_identity_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return votes.strongest_per_name(o, ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey")


@query("""WITH r AS (SELECT DISTINCT n_name AS number, CASE WHEN n_regionkey <= 1 THEN 'east' ELSE 'west' END AS club FROM nation WHERE n_regionkey <= 3),
c AS (SELECT CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS cluster, n_name AS number FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT cluster, club FROM c JOIN r USING (number)),
w AS (SELECT sum(CASE WHEN (cluster = 0) = (club = 'east') THEN 1 ELSE 0 END) AS straight, sum(CASE WHEN (cluster = 0) = (club = 'west') THEN 1 ELSE 0 END) AS crossed FROM h)
SELECT x.cluster, CASE WHEN (straight >= crossed) = (x.cluster = 0) THEN 'east' ELSE 'west' END AS club FROM w, (VALUES (0), (1)) x(cluster) WHERE abs(straight - crossed) >= 2""")
def cluster_to_club(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    roster = nation.where("n_regionkey <= 3").select(F.col("n_name").alias("number"), F.when(F.col("n_regionkey") <= 1, "east").otherwise("west").alias("club"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return votes.club_of_cluster(people.select((F.col("c_acctbal") > 4500).cast("int").alias("cluster"), F.col("n_name").alias("number")), roster)


_TRACKS = """tr AS (SELECT l_orderkey % 20 AS clip, l_shipdate::DATE - DATE '1992-01-01' AS frame, l_suppkey AS tid, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, l_quantity AS x2, l_extendedprice AS y2 FROM lineitem),
ident AS (SELECT c.clip, s_suppkey AS tid, (s_nationkey % 12)::VARCHAR AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS club, CASE WHEN s_suppkey % 11 = 0 THEN 'mixed-kit' END AS ignored, NULL AS merged_into FROM supplier, (SELECT unnest(range(20)) AS clip) c),
col AS (SELECT clip, tid, 400 + tid % 100 AS a, 600 + tid % 100 AS b FROM ident WHERE tid % 5 = 0),
truth AS (SELECT clip, tid, 0 AS seg_ix, CASE WHEN tid % 7 = 0 THEN '?' WHEN tid % 3 = 0 THEN '1' ELSE number END AS number, CASE WHEN tid % 4 = 0 THEN 'a' WHEN tid % 13 = 0 THEN 'b' END AS club, 0 AS a, 1800 AS b FROM ident),
d AS (SELECT tr.*, number, club, row_number() OVER (PARTITION BY clip, frame, tid ORDER BY (x2 - x1) * (y2 - y1) DESC, tid) AS k FROM tr JOIN ident USING (clip, tid) WHERE ignored IS NULL AND NOT EXISTS (SELECT 1 FROM col WHERE col.clip = tr.clip AND col.tid = tr.tid AND frame BETWEEN col.a AND col.b)),
v AS (SELECT d.clip, d.frame, d.tid, d.number, d.club, t.number AS tn, t.club AS tc FROM d LEFT JOIN truth t ON t.clip = d.clip AND t.tid = d.tid AND d.frame BETWEEN t.a AND t.b WHERE k = 1),
j AS (SELECT *, CASE WHEN tn IS NULL THEN 'unknown' WHEN tn = '?' AND (tc IS NULL OR tc = club) THEN 'unknown' WHEN tn = number AND (tc IS NULL OR tc = club) THEN 'right' ELSE 'wrong' END AS verdict FROM v)"""


def synthetic_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tracks, identities, truth and collapse spans: order lines as boxes of suppliers on days, in twenty clips."""
    li = table(spark, sf_dir, "lineitem")
    tracks = li.select((F.col("l_orderkey") % 20).alias("clip"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("frame"), F.col("l_suppkey").alias("tid"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_extendedprice").alias("y2"))
    s = table(spark, sf_dir, "supplier").withColumn("clip", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    tid = F.col("s_suppkey")
    ident = s.select("clip", tid.alias("tid"), (F.col("s_nationkey") % 12).cast("string").alias("number"), F.when(tid % 2 == 0, "a").otherwise("b").alias("club"), F.when(tid % 11 == 0, "mixed-kit").alias("ignored"), F.lit(None).cast("bigint").alias("merged_into"))
    t = F.col("tid")
    truth = ident.select("clip", "tid", F.lit(0).alias("seg_ix"), F.when(t % 7 == 0, "?").when(t % 3 == 0, "1").otherwise(F.col("number")).alias("number"), F.when(t % 4 == 0, "a").when(t % 13 == 0, "b").alias("club"), F.lit(0).alias("start"), F.lit(1800).alias("end"))
    collapse = ident.where("tid % 5 = 0").select("clip", "tid", (400 + t % 100).alias("start"), (600 + t % 100).alias("end"))
    return tracks, ident, truth, collapse


@query(f"""WITH {_TRACKS}, f AS (SELECT clip, count(DISTINCT frame) AS n_frames FROM tr GROUP BY clip),
c AS (SELECT clip, count(*) FILTER (verdict = 'right') AS n_right, count(*) FILTER (verdict = 'wrong') AS n_wrong, count(*) FILTER (verdict = 'unknown') AS n_unknown FROM j GROUP BY clip),
p AS (SELECT clip, sum(n) AS found FROM (SELECT clip, frame, count(DISTINCT number || '/' || club) AS n FROM j WHERE verdict = 'right' GROUP BY clip, frame) GROUP BY clip)
SELECT clip, n_frames, coalesce(n_right, 0) AS n_right, coalesce(n_wrong, 0) AS n_wrong, coalesce(n_unknown, 0) AS n_unknown, CASE WHEN n_right + n_wrong > 0 THEN round(n_right::DOUBLE / (n_right + n_wrong), 6) END AS precision, round(coalesce(found, 0)::DOUBLE / (n_frames * 10), 6) AS coverage FROM f LEFT JOIN c USING (clip) LEFT JOIN p USING (clip)""")
def identity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, ident, truth, collapse = synthetic_clips(spark, sf_dir)
    verdicts = evaluate.judged(evaluate.drawn(tracks, ident, collapse), truth)
    out = evaluate.score(verdicts, tracks)
    return out.withColumns({"precision": F.round(F.nanvl("precision", F.lit(None).cast("double")), 6), "coverage": F.round("coverage", 6)})


@query(f"WITH {_TRACKS} SELECT clip, tid, number AS said, tn AS true_number, count(*) AS frames FROM j WHERE verdict = 'wrong' GROUP BY ALL")
def identity_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, ident, truth, collapse = synthetic_clips(spark, sf_dir)
    return evaluate.culprits(evaluate.judged(evaluate.drawn(tracks, ident, collapse), truth))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT event_type, min(day) AS a, max(day) AS b FROM e GROUP BY event_type), sp AS (SELECT event_type, unnest(range(a, b + 1)) AS day FROM d),
c AS (SELECT event_type, day, count(*) AS n FROM e GROUP BY event_type, day), j AS (SELECT event_type, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (event_type, day))
SELECT event_type, count(*) AS steps, round(avg(n), 6) AS mean_labels, round(avg(CASE WHEN n >= 60 THEN 1.0 ELSE 0.0 END), 6) AS share_full, count(*) FILTER (n < 60) AS short_steps, max(n) AS most FROM j GROUP BY event_type""")
def frame_counts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    spine = e.groupBy("event_type").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("event_type", F.explode(F.sequence("a", "b")).alias("day"))
    out = evaluate.frame_report(e, spine, ["event_type"], "day", 60)
    return out.withColumns({"mean_labels": F.round("mean_labels", 6), "share_full": F.round("share_full", 6)})


@query("SELECT l_orderkey % 7 AS clip, n, count(*) AS rows FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL")
def kept_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return evaluate.histogram(per.withColumn("clip", F.col("l_orderkey") % 7), ["clip"], F.col("k"))


@query("""WITH r AS (SELECT n_chars::DOUBLE AS f, quality = 1 AS good FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c(cut) AS (VALUES (200.0::DOUBLE), (500.0), (1000.0), (2000.0))
SELECT cut, count(*) FILTER (f >= cut) AS kept, count(*) FILTER (f < cut AND NOT good) AS bad_dropped, count(*) FILTER (f < cut AND good) AS good_lost FROM r, c GROUP BY cut""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    cuts = spark.createDataFrame([(200.0,), (500.0,), (1000.0,), (2000.0,)], "cut double")
    return evaluate.threshold_sweep(rows, "n_chars", F.col("quality") == 1, cuts)


@query("""WITH r AS (SELECT lang, count(*) FILTER (n_chars >= 500 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 500 AND quality = 0) AS fp, count(*) FILTER (n_chars < 500 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall FROM r""")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    found, good = F.col("n_chars") >= 500, F.col("quality") == 1
    r = rows.groupBy("lang").agg(F.count_if(found & good).alias("tp"), F.count_if(found & (F.col("quality") == 0)).alias("fp"), F.count_if((F.col("n_chars") < 500) & good).alias("fn"))
    precision, recall = evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return r.select("lang", "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


@query("""SELECT coalesce(r_name, 'all') AS team, coalesce(n_name, 'all') AS player, count(o_orderkey) AS attempts, count(o_orderkey) FILTER (o_orderstatus = 'F') AS made, count(o_orderkey) FILTER (o_orderstatus = 'F') * 2 AS points
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def box_score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    per_customer = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    people = t("customer").select("c_custkey", "c_nationkey").join(per_customer, "c_custkey", "left")
    rows = people.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = F.coalesce(F.sum("f"), F.lit(0))
    out = rows.rollup("r_name", "n_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), made.alias("made"), (made * 2).alias("points"))
    return out.select(F.coalesce("r_name", F.lit("all")).alias("team"), F.coalesce("n_name", F.lit("all")).alias("player"), "attempts", "made", "points")


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(min(l_extendedprice), 4) AS low, round(max(l_extendedprice), 4) AS high FROM lineitem GROUP BY ALL""")
def stat_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(p.alias("p"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return out.select("l_returnflag", "l_linestatus", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p90"))], F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_NUMBERS = "c AS (SELECT l_suppkey AS tid, CASE l_partkey % 5 WHEN 4 THEN '21' ELSE (l_partkey % 5)::VARCHAR END AS number, count(*) AS votes FROM lineitem GROUP BY ALL)"
_TWO = f"""{_NUMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY votes DESC, number) AS k, sum(votes) OVER (PARTITION BY tid) AS total FROM c),
two AS (SELECT tid, max(number) FILTER (k = 1) AS a, max(number) FILTER (k = 2) AS b, max(votes) FILTER (k = 1) - coalesce(max(votes) FILTER (k = 2), 0) >= greatest(2, 0.2 * max(total)) AS decisive FROM k GROUP BY tid),
r AS (SELECT DISTINCT s_suppkey % 2 AS club, (s_suppkey % 4)::VARCHAR AS number FROM supplier)"""


def _numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Votes for numbers by track, and a roster."""
    number = F.when(F.col("l_partkey") % 5 == 4, "21").otherwise((F.col("l_partkey") % 5).cast("string"))
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tid"), number.alias("number"))
    roster = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2).alias("club"), (F.col("s_suppkey") % 4).cast("string").alias("number")).distinct()
    return votes.tally(reads, ["tid"], "number"), roster


@query(f"""WITH {_TWO} SELECT tid, a AS first_number, b AS second_number FROM two WHERE b IS NOT NULL AND NOT decisive AND NOT EXISTS (SELECT 1 FROM r x JOIN r y ON x.club = y.club WHERE x.number = a AND y.number = b)
AND NOT CASE WHEN length(a) <= length(b) THEN starts_with(b, a) OR ends_with(b, a) ELSE starts_with(a, b) OR ends_with(a, b) END""")
def split_identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, roster = _numbers(spark, sf_dir)
    return votes.split_identities(counts, ["tid"], "number", roster)


@query(f"""WITH {_TWO}, o AS (SELECT number, min(club) AS owner FROM r GROUP BY number HAVING count(DISTINCT club) = 1), t AS (SELECT tid, tid % 3 AS club, tid % 4 = 0 AS open FROM two)
SELECT tid, CASE WHEN open AND decisive AND owner IS NOT NULL AND owner <> club THEN owner ELSE club END AS club, coalesce(open AND decisive AND owner IS NOT NULL AND owner <> club, false) AS moved FROM t JOIN two USING (tid) LEFT JOIN o ON o.number = a""")
def club_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, roster = _numbers(spark, sf_dir)
    lead = votes.leaders(counts, ["tid"], "number").select("tid", F.col("top_value").alias("number"), F.col("decisive").alias("number_decisive"))
    tracks = lead.select("tid", (F.col("tid") % 3).alias("club"), (F.col("tid") % 4 != 0).alias("colour_decisive"))
    return votes.club_by_number(tracks, lead, roster)


@query("""WITH p AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'east' ELSE 'west' END AS club, CASE WHEN (c_custkey + c_nationkey) % 3 = 0 THEN 'home' ELSE 'away' END AS side FROM customer), v AS (SELECT sum(CASE WHEN (club = 'east') = (side = 'home') THEN 1 ELSE -1 END) >= 0 AS straight FROM p)
SELECT 'east' AS club, CASE WHEN straight THEN 'home' ELSE 'away' END AS side FROM v UNION ALL SELECT 'west', CASE WHEN straight THEN 'away' ELSE 'home' END FROM v""")
def side_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    club = F.when(F.col("c_nationkey") % 2 == 0, "east").otherwise("west")
    side = F.when((F.col("c_custkey") + F.col("c_nationkey")) % 3 == 0, "home").otherwise("away")
    return votes.side_convention(table(spark, sf_dir, "customer").select(club.alias("club"), side.alias("side")))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, event_id FROM events) SELECT event_type, event_id, value, k FROM r WHERE k <= 12""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, sf_dir, "events").select("event_type", "event_id", "value").withColumn("k", F.row_number().over(w))
    return r.where("k <= 12").withColumn("k", F.col("k").cast("bigint"))
