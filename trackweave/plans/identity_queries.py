"""The whole identity chain on order lines: a clip is a range of orders, a track a line number, a frame an order.

Line 6 stands on line 5 for all of some clips (a duplicate), most of others and a part of the rest; line 7
is read as two numbers; kits are open for line 2 in some clips; every second clip numbers its kit clusters the
other way round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import identity
from trackweave.plans.registry import query, table

CLIP = 1500

_CHAIN = f"""WITH t AS (SELECT l_orderkey // {CLIP} AS clip, l_orderkey % {CLIP} AS frame, l_linenumber AS tid, l_suppkey, l_quantity FROM lineitem),
b AS (SELECT *, CASE WHEN tid = 6 AND frame < CASE clip % 5 WHEN 4 THEN {CLIP} WHEN 3 THEN 900 ELSE 225 END THEN 5 ELSE tid END AS place FROM t),
reads AS (SELECT clip, frame, tid, CAST(CASE WHEN tid = 7 AND l_suppkey % 2 = 0 THEN 4 WHEN l_quantity > 40 AND tid < 7 THEN tid % 6 + 1 ELSE tid END AS VARCHAR) AS value FROM t),
kits AS (SELECT clip, frame, tid, CASE WHEN tid = 2 AND clip % 3 = 0 THEN l_suppkey % 2 WHEN l_suppkey % 10 = 0 THEN (tid + clip + 1) % 2 ELSE (tid + clip) % 2 END AS cluster FROM t),
ros AS (SELECT CAST(n AS VARCHAR) AS number, CASE WHEN n % 2 = 1 THEN 'east' ELSE 'west' END AS club, 'player ' || n AS name FROM range(1, 8) r(n)),
life AS (SELECT clip, tid, min(frame) AS f, max(frame) AS l FROM b GROUP BY clip, tid),
meet AS (SELECT x.clip, x.frame, x.tid AS p, y.tid AS q FROM b x JOIN b y ON x.clip = y.clip AND x.frame = y.frame AND x.tid < y.tid AND x.place = y.place),
isl AS (SELECT *, sum(CASE WHEN frame - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY clip, p, q ORDER BY frame) AS i FROM (SELECT *, lag(frame) OVER (PARTITION BY clip, p, q ORDER BY frame) AS before FROM meet)),
ov AS (SELECT clip, p, q, min(frame) AS s, max(frame) AS e FROM isl GROUP BY clip, p, q, i HAVING max(frame) - min(frame) + 1 >= 100),
kind AS (SELECT ov.*, CASE WHEN (e - s + 1) / least(a.l - a.f + 1, z.l - z.f + 1) >= 0.9 THEN 'duplicate' ELSE 'collapse' END AS kind FROM ov JOIN life a ON a.clip = ov.clip AND a.tid = p JOIN life z ON z.clip = ov.clip AND z.tid = q),
col AS (SELECT clip, p AS tid, s, e FROM kind WHERE kind = 'collapse' UNION ALL SELECT clip, q, s, e FROM kind WHERE kind = 'collapse'),
num AS (SELECT clip, tid, value, count(*) AS votes FROM reads WHERE NOT EXISTS (SELECT 1 FROM col WHERE col.clip = reads.clip AND col.tid = reads.tid AND frame BETWEEN s AND e) GROUP BY clip, tid, value),
tot AS (SELECT clip, tid, sum(votes) AS votes FROM num GROUP BY clip, tid),
retired AS (SELECT clip, CASE WHEN coalesce(a.votes, 0) < coalesce(z.votes, 0) THEN p ELSE q END AS tid FROM (SELECT DISTINCT clip, p, q FROM kind WHERE kind = 'duplicate') k LEFT JOIN (SELECT clip AS c, tid, votes FROM tot) a ON a.c = clip AND a.tid = p LEFT JOIN (SELECT clip AS c, tid, votes FROM tot) z ON z.c = clip AND z.tid = q),
unvouched AS (SELECT life.clip, life.tid FROM life JOIN (SELECT clip, tid, sum(e - s + 1) AS n FROM col GROUP BY clip, tid) c USING (clip, tid) WHERE n / (l - f + 1) > 0.5 AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.clip = life.clip AND r.tid = life.tid)),
gone AS (SELECT clip, tid FROM retired UNION ALL SELECT clip, tid FROM unvouched),
kv AS (SELECT clip, tid, cluster, count(*) AS votes, row_number() OVER (PARTITION BY clip, tid ORDER BY count(*) DESC, cluster) AS r FROM kits GROUP BY clip, tid, cluster),
kl AS (SELECT clip, tid, max(cluster) FILTER (r = 1) AS cluster, coalesce(max(votes) FILTER (r = 1), 0) - coalesce(max(votes) FILTER (r = 2), 0) >= greatest(2, 0.2 * sum(votes)) AS decisive, sum(votes) AS n FROM kv GROUP BY clip, tid),
mixed AS (SELECT clip, tid FROM kl WHERE n >= 15 AND NOT decisive AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.clip = kl.clip AND g.tid = kl.tid)),
standing AS (SELECT * FROM num WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.clip = num.clip AND g.tid = num.tid)),
live AS (SELECT * FROM standing WHERE NOT EXISTS (SELECT 1 FROM mixed m WHERE m.clip = standing.clip AND m.tid = standing.tid)),
nr AS (SELECT *, row_number() OVER (PARTITION BY clip, tid ORDER BY votes DESC, value) AS r FROM standing),
nl AS (SELECT clip, tid, max(value) FILTER (r = 1) AS top, max(value) FILTER (r = 2) AS nxt, max(votes) FILTER (r = 1) AS v1, coalesce(max(votes) FILTER (r = 2), 0) AS v2, sum(votes) AS n FROM nr GROUP BY clip, tid),
way AS (SELECT nl.clip, count(*) FILTER ((cluster = 0) = (club = 'east')) AS straight, count(*) FILTER ((cluster = 0) = (club = 'west')) AS crossed FROM nl JOIN kl USING (clip, tid) JOIN ros ON number = top WHERE v1 >= 2 AND v1 > v2 GROUP BY nl.clip),
clubs AS (SELECT clip, cluster, CASE WHEN (cluster = 0) = (straight >= crossed) THEN 'east' ELSE 'west' END AS club FROM way, (VALUES (0), (1)) c(cluster) WHERE abs(straight - crossed) >= 2),
placed AS (SELECT nl.clip, nl.tid, CASE WHEN NOT kl.decisive AND v1 - v2 >= greatest(2, 0.2 * nl.n) AND o.club <> clubs.club THEN o.club ELSE clubs.club END AS club FROM nl JOIN (SELECT DISTINCT clip, tid FROM live) USING (clip, tid) JOIN kl USING (clip, tid) JOIN clubs ON clubs.clip = nl.clip AND clubs.cluster = kl.cluster JOIN ros o ON o.number = top),
best AS (SELECT live.clip, live.tid, live.votes, placed.club, number, name, row_number() OVER (PARTITION BY live.clip, live.tid ORDER BY live.votes DESC) AS r FROM live JOIN placed USING (clip, tid) JOIN ros ON number = value AND ros.club = placed.club),
split AS (SELECT clip, tid FROM nl WHERE NOT v1 - v2 >= greatest(2, 0.2 * n) AND nxt IS NOT NULL AND CAST(top AS INTEGER) % 2 <> CAST(nxt AS INTEGER) % 2)"""


def chain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.expr(f"l_orderkey div {CLIP}").alias("clip"), (F.col("l_orderkey") % CLIP).alias("frame"), F.col("l_linenumber").cast("long").alias("tid"), "l_suppkey", "l_quantity")
    tid, clip, odd = F.col("tid"), F.col("clip"), F.col("l_suppkey") % 2
    until = F.when(clip % 5 == 4, CLIP).when(clip % 5 == 3, 900).otherwise(225)
    x = F.when((tid == 6) & (F.col("frame") < until), 500.0).otherwise(100.0 * tid)
    tracks = rows.select("clip", "frame", "tid", x.alias("x1"), F.lit(0.0).alias("y1"), (x + 80).alias("x2"), F.lit(20.0).alias("y2"))
    number = F.when((tid == 7) & (odd == 0), 4).when((F.col("l_quantity") > 40) & (tid < 7), tid % 6 + 1).otherwise(tid)
    reads = rows.select("clip", "frame", "tid", number.cast("string").alias("value"))
    cluster = F.when((tid == 2) & (clip % 3 == 0), odd).when(F.col("l_suppkey") % 10 == 0, (tid + clip + 1) % 2).otherwise((tid + clip) % 2)
    kits = rows.select("clip", "frame", "tid", cluster.cast("int").alias("cluster"))
    n = F.col("id")
    roster = spark.range(1, 8).select(F.when(n % 2 == 1, "east").otherwise("west").alias("club"), n.cast("string").alias("number"), F.concat(F.lit("player "), n).alias("name"))
    return identity.resolved(tracks, reads, kits, roster, fps=100)


@query(f"""{_CHAIN} SELECT best.clip, best.tid, best.number, best.club, CASE WHEN s.tid IS NULL THEN name END AS name, CASE WHEN s.tid IS NOT NULL THEN 'split-identity' WHEN votes < 3 THEN 'tentative' END AS ignored, CAST(votes AS DOUBLE) AS votes
FROM best LEFT JOIN split s ON s.clip = best.clip AND s.tid = best.tid WHERE r = 1""")
def identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir)["identities"].select("clip", "tid", "number", "club", "name", "ignored", "votes")


@query(f"""{_CHAIN} SELECT clip, tid, 'retired' AS gate FROM retired UNION ALL SELECT clip, tid, 'unvouched' FROM unvouched UNION ALL SELECT clip, tid, 'mixed' FROM mixed UNION ALL SELECT clip, cluster, club FROM clubs""")
def identity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates take out of every clip, and the club of each of its clusters."""
    out = chain(spark, sf_dir)
    gates = [out[g].select("clip", F.col("tid").cast("long").alias("tid"), F.lit(g).alias("gate")) for g in ("retired", "unvouched", "mixed")]
    return gates[0].unionByName(gates[1]).unionByName(gates[2]).unionByName(out["clubs"].select("clip", F.col("cluster").cast("long").alias("tid"), F.col("club").alias("gate")))
