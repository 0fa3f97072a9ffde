"""Queries over corrections, lookups and registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import corrections
from trackweave.plans.inputs import SPANS_SQL, order_spans
from trackweave.plans.registry import query, table

_TRACKS = "t AS (SELECT c_custkey AS tid, c_nationkey AS club, c_custkey % 40 AS number, c_name AS name FROM customer), r AS (SELECT s_nationkey AS club, s_suppkey % 40 AS number, min(s_name) AS name FROM supplier GROUP BY ALL), u AS (SELECT c_custkey AS tid, c_custkey % 37 AS number, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 25 END AS club FROM customer WHERE c_custkey % 3 = 0)"


@query(f"""WITH {_TRACKS}, h AS (SELECT t.*, u.number AS un, u.tid IS NOT NULL AS upd, coalesce(u.club, t.club) AS uc FROM t LEFT JOIN u USING (tid)), f AS (SELECT h.*, r.name AS rn FROM h LEFT JOIN r ON r.club = uc AND r.number = un)
SELECT tid, CASE WHEN rn IS NULL THEN number ELSE un END AS number, CASE WHEN rn IS NULL THEN name ELSE rn END AS name, CASE WHEN rn IS NULL THEN club ELSE uc END AS club, rn IS NOT NULL AS corrected, upd AND rn IS NULL AS missing FROM f""")
def corrected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    tracks = customer.select(key.alias("tid"), F.col("c_nationkey").alias("club"), (key % 40).alias("number"), F.col("c_name").alias("name"))
    roster = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("club"), (F.col("s_suppkey") % 40).alias("number")).agg(F.min("s_name").alias("name"))
    updates = customer.where(key % 3 == 0).select(key.alias("tid"), (key % 37).alias("number"), F.when(key % 2 == 0, key % 25).alias("club"))
    return corrections.corrected_points(tracks, updates, roster, ["tid"])


@query("""WITH a AS (SELECT user_id, arg_max(event_type, epoch_us(ts) * 1000 + event_id % 1000) AS act FROM events GROUP BY user_id)
SELECT user_id, CASE act WHEN 'purchase' THEN 'human' WHEN 'click' THEN 'ignored' ELSE CASE WHEN user_id % 3 > 0 THEN 'number-only' ELSE 'anonymous' END END AS status, coalesce(CASE WHEN user_id % 3 > 0 THEN (user_id % 99)::VARCHAR END, 'T' || user_id) AS label FROM a""")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", order).alias("act"))
    action = F.when(F.col("act") == "purchase", "assign").when(F.col("act") == "click", "ignore").otherwise("unassign")
    state, label = corrections.review_status(action, F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 99), F.col("user_id"))
    return last.select("user_id", state.alias("status"), label.alias("label"))


@query("SELECT o_orderkey, coalesce(o_orderstatus IN ('F', 'P'), false) AS settled FROM orders")
def settled_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "human").when(F.col("o_orderstatus") == "P", "ignored")
    free, settled = corrections.kept_identities(table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")), "state")
    return free.select("o_orderkey", F.lit(False).alias("settled")).unionByName(settled.select("o_orderkey", F.lit(True).alias("settled")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def unfinished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return corrections.unfinished(table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")), "state").select("o_orderkey")


@query(f"""WITH {SPANS_SQL}, p AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'F' ELSE 'O' END AS name, s, e FROM o WHERE o_orderkey % 2 = 0)
SELECT o_custkey, o_orderkey, name FROM p WHERE EXISTS (SELECT 1 FROM o WHERE o.o_custkey = p.o_custkey AND o.o_orderstatus = p.name AND o.o_orderkey <> p.o_orderkey AND o.s <= p.e AND o.e >= p.s)""")
def would_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = order_spans(spark, sf_dir).withColumnRenamed("o_orderstatus", "name")
    proposal = tracks.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", F.when(F.col("name") == "O", "F").otherwise("O").alias("name"))
    return corrections.would_conflict(tracks, proposal, ["o_custkey"], "o_orderkey", "name", "start", "end")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END, p) AS total FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def totals_from_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("total"))
    hints = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("total"))
    return corrections.with_totals(jobs, hints, "o_orderkey")


@query("""WITH live AS (SELECT o_orderpriority AS job, o_orderkey AS run, o_orderdate AS started FROM orders WHERE o_orderstatus = 'P'), old AS (SELECT o_orderpriority AS job, o_orderkey AS run, o_orderdate AS started FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 400),
b AS (SELECT *, 0 AS k FROM live UNION ALL SELECT *, 1 FROM old) SELECT job, run FROM b WHERE job = (SELECT max(job) FROM old) ORDER BY k, started DESC, run DESC LIMIT 1""")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("job"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"), "o_orderstatus")
    live, old = (runs.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "PF")
    job = old.orderBy(F.desc("started"), F.desc("run")).limit(400).agg(F.max("job")).first()[0]
    return corrections.looked_up(live, old, job=job).select("job", "run")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE -1 END AS index FROM lineitem")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.remapped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["R", "A", "X"]).drop("l_returnflag")


@query("SELECT a.page_id, min(b.url) AS match FROM pages a LEFT JOIN pages b ON list_last(string_split(a.url, '/')) = list_last(string_split(b.url, '/')) AND b.page_id % 3 = 0 GROUP BY a.page_id")
def truth_by_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return corrections.by_basename(pages, "url", pages.where("page_id % 3 = 0").select(F.col("url").alias("other")), "other").select("page_id", "match").distinct()


_PAIRS = "p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b, CAST(l_quantity AS INTEGER) AS inliers, l_discount::DOUBLE * 5 AS overlap FROM lineitem)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").cast("int").alias("inliers"), (F.col("l_discount").cast("double") * 5).alias("overlap"))


@query(f"WITH {_PAIRS}, g AS (SELECT a, b FROM p WHERE inliers >= 25 AND overlap >= 0.3) SELECT a, b FROM g UNION SELECT b, a FROM g")
def registration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.registration_edges(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT a, b, inliers, CASE WHEN inliers >= 25 AND overlap >= 0.3 THEN 'direct' WHEN b % 50 >= 25 THEN 'chained' ELSE 'failed' END AS method FROM p")
def link_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = corrections.link_kind(F.col("inliers"), F.col("overlap"), F.col("b") % 50)
    return _pairs(spark, sf_dir).distinct().select("a", "b", "inliers", kind.alias("method"))


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS reach FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_has_all(reach, ['A', 'R']) AS covered, l_orderkey || '_report.json' AS report, l_orderkey || '_final.mp4' AS film FROM r""")
def coverage_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("reach"))
    names = corrections.artefact_pair(F.col("l_orderkey").cast("string"))
    return r.select("l_orderkey", corrections.reaches_all(F.col("reach"), F.array(F.lit("A"), F.lit("R"))).alias("covered"), names["report"].alias("report"), names["film"].alias("film"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice <= 150000")
def usable_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.usable_cache(table(spark, sf_dir, "orders"), {"o_orderpriority": "1-URGENT", "o_orderstatus": "O"}, {"o_totalprice": 150000.0}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey DESC LIMIT 400")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"), F.struct("o_orderdate", "o_orderkey").alias("started"))
    return corrections.newest_runs(runs).select("o_orderkey")
