"""Queries over the operators that carry state along a clip or a job, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.plans.inputs import EVENTS_SQL, events
from trackweave.plans.registry import query, table
from trackweave.streaming import heartbeat, pictures, shots, stitching

# Every order of a clip is a seed, every line number a lane on a wide circle; a lane's box moves a little, at times by
# 200 pixels, which is still its player by distance, at times by 300, which is a new one.
_LANES = """l AS (SELECT DISTINCT l_orderkey // 200 AS clip, l_orderkey AS frame, l_linenumber AS lane FROM lineitem)"""


@query(f"""WITH {_LANES},
p AS (SELECT *, lag(frame) OVER (PARTITION BY clip, lane ORDER BY frame) AS seen FROM l),
f AS (SELECT clip, frame, lag(frame) OVER (PARTITION BY clip ORDER BY frame) AS before, lead(frame) OVER (PARTITION BY clip ORDER BY frame) AS after FROM (SELECT DISTINCT clip, frame FROM l)),
b AS (SELECT p.clip, p.frame, lane, seen IS NULL OR seen <> before OR abs((frame // 5 % 3 = 0)::INT * 200 + (frame // 7 % 4 = 0)::INT * 300 - (before // 5 % 3 = 0)::INT * 200 - (before // 7 % 4 = 0)::INT * 300) > 250 AS born, after FROM p JOIN f USING (clip, frame)),
n AS (SELECT *, CASE WHEN born THEN row_number() OVER (PARTITION BY clip, born ORDER BY frame, lane) END AS fresh FROM b),
t AS (SELECT *, last_value(fresh IGNORE NULLS) OVER (PARTITION BY clip, lane ORDER BY frame) AS tid FROM n),
nx AS (SELECT t.*, lead(frame) OVER w AS nf, lead(born) OVER w AS nb FROM t WINDOW w AS (PARTITION BY clip, lane ORDER BY frame))
SELECT clip, frame, CAST(lane AS BIGINT) AS box, CAST(tid AS BIGINT) AS tid, CASE WHEN born THEN 'born' ELSE 'kept' END AS event FROM t
UNION ALL SELECT clip, after, NULL, CAST(tid AS BIGINT), 'lost' FROM nx WHERE after IS NOT NULL AND (nf IS NULL OR nf <> after OR nb)""")
def reseeded_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, lane = F.col("l_orderkey"), F.col("l_linenumber")
    far = lambda by, of, d: F.when(F.expr(f"l_orderkey div {by}") % of == 0, d).otherwise(0)
    x = F.round(20000 * F.cos(lane * 0.9)) + far(5, 3, 200) + far(7, 4, 300) + frame % 3
    y = F.round(20000 * F.sin(lane * 0.9))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    boxes = rows.select(F.expr("l_orderkey div 200").alias("clip"), frame.alias("frame"), lane.cast("long").alias("box"), x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 200).alias("y2"), F.lit(None).cast("long").alias("held"))
    return stitching.reseeded(boxes).select("clip", "frame", "box", "tid", "event")


@query("""WITH RECURSIVE v AS (SELECT vec_id // 64 AS clip, vec_id AS frame, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS pos, embedding FROM embeddings),
c AS (SELECT a.clip, a.pos AS i, b.pos AS j, (k - 1) // 16 AS cell, corr(a.embedding[k]::DOUBLE, b.embedding[k]::DOUBLE) AS r FROM v a JOIN v b ON a.clip = b.clip AND b.pos - a.pos BETWEEN 1 AND 6, range(1, 65) x(k) GROUP BY ALL),
s AS (SELECT clip, i, j, avg(r) AS s FROM c GROUP BY clip, i, j),
d AS (SELECT clip, j AS pos FROM s WHERE j = i + 1 AND s < 0.05),
m AS (SELECT d.clip, d.pos, min(s.j) AS back FROM d LEFT JOIN s ON s.clip = d.clip AND s.i = d.pos - 1 AND s.j > d.pos AND s.s >= 0.05 GROUP BY d.clip, d.pos),
o AS (SELECT clip, pos, coalesce(back, pos + 5) AS until, CASE WHEN back IS NULL THEN 'cut' ELSE 'flash' END AS kind FROM m),
t AS (SELECT clip, pos, until, kind FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY pos) AS r FROM o) WHERE r = 1
 UNION ALL SELECT n.clip, n.pos, n.until, n.kind FROM (SELECT o.*, row_number() OVER (PARTITION BY o.clip ORDER BY o.pos) AS r FROM t JOIN o ON o.clip = t.clip AND o.pos > t.until) n WHERE r = 1)
SELECT t.clip, v.frame, t.kind FROM t JOIN v ON v.clip = t.clip AND v.pos = t.pos""")
def picture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pictures of four cells."""
    frames = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("clip"), F.col("vec_id").alias("frame"), F.col("embedding").alias("vector"))
    return pictures.picture_changes(frames, cells=4, limit=0.05)


@query(f"""WITH RECURSIVE {EVENTS_SQL},
f AS (SELECT user_id AS clip, us, bool_or(event_type = 'click') AS jump, bool_or(event_type = 'view') AS layup, bool_or(event_type NOT IN ('click', 'view')) AS basket FROM e GROUP BY user_id, us),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY us) AS i FROM f UNION ALL SELECT u.clip, m.us, false, false, false, u.n + 1 FROM (SELECT clip, count(*) AS n FROM f GROUP BY clip) u, (SELECT max(us) AS us FROM f) m),
s AS (SELECT clip, 0::BIGINT AS i, NULL::BIGINT AS opened, NULL::VARCHAR AS kind, NULL::BIGINT AS started, NULL::BIGINT AS made, NULL::BIGINT AS missed_at, NULL::VARCHAR AS missed_kind, NULL::BIGINT AS t0, NULL::VARCHAR AS event, NULL::VARCHAR AS of FROM r WHERE i = 1
 UNION ALL SELECT clip, i, CASE WHEN made_now THEN NULL WHEN starts THEN us ELSE held END, CASE WHEN made_now THEN NULL WHEN starts THEN CASE WHEN jump THEN 'jump' ELSE 'layup' END ELSE held_kind END, CASE WHEN starts THEN us ELSE started END, CASE WHEN made_now THEN us ELSE made END,
  CASE WHEN late THEN opened + 43200000000 END, CASE WHEN late THEN kind END, CASE WHEN made_now OR starts THEN us END, CASE WHEN made_now THEN 'made' WHEN starts THEN 'start' END, CASE WHEN made_now THEN held_kind WHEN starts THEN CASE WHEN jump THEN 'jump' ELSE 'layup' END END
 FROM (SELECT *, basket AND held IS NOT NULL AS made_now, NOT (basket AND held IS NOT NULL) AND (jump OR layup) AND held IS NULL AND (started IS NULL OR us - started >= 3600000000) AND (made IS NULL OR us - made >= 7200000000) AS starts
  FROM (SELECT r.*, s.opened, s.kind, s.started, s.made, coalesce(r.us >= s.opened + 43200000000, false) AS late, CASE WHEN r.us >= s.opened + 43200000000 THEN NULL ELSE s.opened END AS held, CASE WHEN r.us >= s.opened + 43200000000 THEN NULL ELSE s.kind END AS held_kind FROM s JOIN r ON r.clip = s.clip AND r.i = s.i + 1)))
SELECT clip, t0 AS us, event, of AS kind FROM s WHERE t0 IS NOT NULL UNION ALL SELECT clip, missed_at, 'missed', missed_kind FROM s WHERE missed_at IS NOT NULL""")
def shot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as starts, all other events as makes; the times are hours instead of seconds."""
    e = events(spark, sf_dir)
    some = lambda c: F.bool_or(c)
    kind = F.col("event_type")
    flags = e.groupBy(F.col("user_id").alias("clip"), "us").agg(some(kind == "click").alias("jump"), some(kind == "view").alias("layup"), some(~kind.isin("click", "view")).alias("basket"))
    return shots.shots(flags.select("clip", F.timestamp_micros("us").alias("at"), "jump", "layup", "basket"), reset=43200.0, apart=3600.0, cooldown=7200.0)


@query(f"""WITH RECURSIVE {EVENTS_SQL},
x AS (SELECT user_id AS job, us, event_id AS done, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt FROM (SELECT user_id, us, max(event_id) AS event_id FROM e GROUP BY user_id, us)),
w AS (SELECT job, i, us AS wrote, us, done, true AS writes FROM x WHERE i = 1 UNION ALL SELECT x.job, x.i, CASE WHEN x.us - w.wrote >= 3600000000 THEN x.us ELSE w.wrote END, x.us, x.done, x.us - w.wrote >= 3600000000 FROM w JOIN x ON x.job = w.job AND x.i = w.i + 1),
z AS (SELECT max(us) AS z FROM x)
SELECT job, us, 'beat' AS kind, done FROM w WHERE writes
UNION ALL SELECT job, us + 43200000000, 'quiet', done FROM x, z WHERE coalesce(nxt, z) >= us + 43200000000
UNION ALL SELECT job, us + 172800000000, 'stale', done FROM x, z WHERE coalesce(nxt, z) >= us + 172800000000""")
def job_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs whose events are updates; a beat an hour at most, quiet after twelve hours, stale after two days."""
    e = events(spark, sf_dir).groupBy(F.col("user_id").alias("job"), "us").agg(F.max("event_id").alias("done"))
    updates = e.select("job", F.timestamp_micros("us").alias("at"), F.lit("running").alias("state"), "done", F.lit(None).cast("long").alias("total"))
    return heartbeat.pulses(updates, every=3600.0, quiet=43200.0, stale=172800.0).select("job", "us", "kind", "done")
