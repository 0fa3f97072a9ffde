"""Queries over box scores and thresholds on several features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import boxscores, evaluate
from trackweave.plans.inputs import EVENTS_SQL, events
from trackweave.plans.registry import query, table

_TYPES = {"purchase": "shot_made", "click": "shot_missed", "view": "rebound", "signup": "assist", "error": "turnover"}
_UNTIL = "2024-01-15"
_GAME = f"""{EVENTS_SQL}, g AS (SELECT event_id, user_id // 10 AS game, user_id AS player, us AS t, event_type, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS points, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS team FROM e),
p AS (SELECT c_custkey // 10 AS game, c_custkey AS player FROM customer WHERE c_custkey % 7 > 0), k AS (SELECT g.* FROM g SEMI JOIN p ON p.game = g.game AND p.player = g.player)"""


def _game(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of games of ten users, and the customers who play them; every seventh is on no list, many have no event."""
    i = F.col("event_id")
    kind = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    points = F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, 3).otherwise(2)
    team = F.when(i % 4 == 0, F.lit(None)).when(i % 2 == 0, "home").otherwise("away")
    rows = events(spark, sf_dir).select("event_id", F.expr("user_id div 10").alias("game"), F.col("user_id").alias("player"), F.col("us").alias("t"), kind[F.col("event_type")].alias("type"), points.alias("points"), team.alias("team"))
    c = F.col("c_custkey")
    return rows, table(spark, sf_dir, "customer").where(c % 7 > 0).select(F.expr("c_custkey div 10").alias("game"), c.alias("player"))


def _until():
    return F.unix_micros(F.lit(_UNTIL).cast("timestamp"))


@query(f"""WITH {_GAME}, l AS (SELECT game, player, sum(points) FILTER (event_type = 'purchase') AS pts, count(*) FILTER (event_type = 'purchase') AS fgm, count(*) FILTER (event_type IN ('purchase', 'click')) AS fga, count(*) FILTER (event_type = 'purchase' AND points = 3) AS tpm, count(*) FILTER (event_type IN ('purchase', 'click') AND points = 3) AS tpa,
 count(*) FILTER (event_type = 'view') AS reb, count(*) FILTER (event_type = 'signup') AS ast, count(*) FILTER (event_type = 'error') AS turnovers FROM g WHERE t <= epoch_us(TIMESTAMP '{_UNTIL}') GROUP BY game, player)
SELECT p.game, p.player, CAST(coalesce(pts, 0) AS BIGINT) AS pts, coalesce(fgm, 0) AS fgm, coalesce(fga, 0) AS fga, coalesce(tpm, 0) AS tpm, coalesce(tpa, 0) AS tpa, coalesce(reb, 0) AS reb, coalesce(ast, 0) AS ast, coalesce(turnovers, 0) AS turnovers FROM p LEFT JOIN l USING (game, player)""")
def stat_lines_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxscores.stat_lines(*_game(spark, sf_dir), _until())


@query(f"""WITH {_GAME}, s AS (SELECT game, sum(points) FILTER (team = 'home') AS home, sum(points) FILTER (team IS DISTINCT FROM 'home') AS away FROM k WHERE event_type = 'purchase' AND t <= epoch_us(TIMESTAMP '{_UNTIL}') GROUP BY game)
SELECT game, CAST(coalesce(home, 0) AS BIGINT) AS home, CAST(coalesce(away, 0) AS BIGINT) AS away FROM (SELECT DISTINCT game FROM p) LEFT JOIN s USING (game)""")
def side_totals_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxscores.side_totals(*_game(spark, sf_dir), _until())


@query(f"""WITH {_GAME} SELECT event_id, game, player, CAST(points AS INTEGER) AS points, CAST(sum(CASE WHEN team = 'home' THEN points ELSE 0 END) OVER w AS BIGINT) AS home, CAST(sum(CASE WHEN team = 'home' THEN 0 ELSE points END) OVER w AS BIGINT) AS away
FROM k WHERE event_type = 'purchase' AND points > 0 WINDOW w AS (PARTITION BY game ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""")
def running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxscores.running_score(*_game(spark, sf_dir)).select("event_id", "game", "player", "points", "home", "away")


@query("""WITH r AS (SELECT l_orderkey // 500 AS team, l_suppkey AS player, count(*) FILTER (l_returnflag = 'A') AS m2, count(*) AS a2, count(*) FILTER (l_returnflag = 'R') AS m3, count(*) AS a3, count(*) FILTER (l_linestatus = 'F') AS mf, count(*) AS af, count(*) FILTER (l_linenumber = 1) AS oreb, count(*) FILTER (l_linenumber = 2) AS dreb, count(*) FILTER (l_linenumber = 3) AS ast,
 coalesce(nullif(count(*) FILTER (l_linenumber > 4), 1), 0) AS stl, count(*) FILTER (l_linenumber > 5) AS blk, min(l_linenumber)::BIGINT AS tov, max(l_linenumber)::BIGINT AS pf FROM lineitem GROUP BY ALL),
d AS (SELECT *, 2 * m2 + 3 * m3 + mf AS pts, m2 + m3 AS fgm, a2 + a3 AS fga, oreb + dreb AS reb FROM r)
SELECT team, player, false AS totals, m2, a2, m3, a3, mf, af, oreb, dreb, ast, stl, blk, tov, pf, pts, fgm, fga, reb, pts = max(pts) OVER w AS top_pts, reb = max(reb) OVER w AS top_reb, ast = max(ast) OVER w AS top_ast FROM d WINDOW w AS (PARTITION BY team)
UNION ALL SELECT team, NULL, true, CAST(COLUMNS(* EXCLUDE (team, player)) AS BIGINT), false, false, false FROM (SELECT team, NULL AS player, sum(COLUMNS(* EXCLUDE (team, player))) FROM d GROUP BY team)""")
def team_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in stretches of orders as players of a team; their lines stand for shots and rebounds."""
    line, n = F.col("l_linenumber"), F.count("*")
    on = F.count_if
    steals = on(line > 4)
    counts = {
        "m2": on(F.col("l_returnflag") == "A"), "a2": n, "m3": on(F.col("l_returnflag") == "R"), "a3": n, "mf": on(F.col("l_linestatus") == "F"), "af": n, "oreb": on(line == 1), "dreb": on(line == 2), "ast": on(line == 3),
        "stl": F.when(steals != 1, steals), "blk": on(line > 5), "tov": F.min(line), "pf": F.max(line),
    }
    li = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 500").alias("team"), F.col("l_suppkey").alias("player"))
    return boxscores.sheet(li.agg(*[v.alias(k) for k, v in counts.items()]))


_RANGES = {"height": (14, 40), "conf": (0.3, 0.7), "sharpness": (50, 400)}
_CUTS = ", ".join(f"('{f}', {low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * {i} / 3)" for f, (low, high) in _RANGES.items() for i in range(4))


@query(f"""WITH r AS (SELECT l_quantity AS height, CASE WHEN l_linenumber < 7 THEN l_discount * 10 END AS conf, l_extendedprice / 100 AS sharpness, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS good FROM lineitem),
f AS (SELECT 'height' AS feature, height AS v, good FROM r UNION ALL SELECT 'conf', conf, good FROM r UNION ALL SELECT 'sharpness', sharpness, good FROM r), c(feature, cut) AS (VALUES {_CUTS})
SELECT feature, round(cut, 6) AS cut, count(*) FILTER (coalesce(v >= cut, false)) AS kept, count(*) FILTER (NOT coalesce(v >= cut, false) AND NOT good) AS bad_dropped, count(*) FILTER (NOT coalesce(v >= cut, false) AND good) AS good_lost FROM f JOIN c USING (feature) GROUP BY feature, cut""")
def feature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reads: quantity as height, discount as confidence, price as sharpness; some have no confidence, others no verdict."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("height"), F.when(F.col("l_linenumber") < 7, F.col("l_discount") * 10).alias("conf"), (F.col("l_extendedprice") / 100).alias("sharpness"), F.when(flag == "R", True).when(flag == "A", False).alias("good"))
    return evaluate.feature_sweep(rows, _RANGES, F.col("good")).withColumn("cut", F.round("cut", 6))
