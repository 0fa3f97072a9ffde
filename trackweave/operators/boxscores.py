"""Box scores: every player's line and both sides' points at a time, the running score, a team's sheet with its best and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = ("pts", "fgm", "fga", "tpm", "tpa", "reb", "ast", "turnovers")
#: What a sheet's rows have of each player; points, rebounds and shots follow from these.
COUNTS = ("m2", "a2", "m3", "a3", "mf", "af", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf")


def _made() -> Column:
    return F.col("type") == "shot_made"


def _known(events: DataFrame, players: DataFrame, until: Column | None) -> DataFrame:
    """Events of known players up to ``until``; those without a time are at no time, so they count only without ``until``."""
    rows = events if until is None else events.where(F.col("t") <= until)
    return rows.join(players.select("game", "player").distinct(), ["game", "player"], "left_semi")


def stat_lines(events: DataFrame, players: DataFrame, until: Column | None = None) -> DataFrame:
    """game, player and ``LINE`` of every player at ``until`` (all events without it), zeros where nothing has happened.

    ``events``: game, player, t, type (shot_made, shot_missed, rebound, assist, turnover; others don't count), points (of a
    shot, or null), team. A made shot without points is a goal without points. Rows of players are counted once.
    """
    n = F.count_if
    shot = F.col("type").isin("shot_made", "shot_missed")
    three = F.col("points") == 3
    kind = lambda name: n(F.col("type") == name)
    pts = F.sum(F.when(_made(), F.col("points").cast("long")))
    values = (pts, n(_made()), n(shot), n(_made() & three), n(shot & three), kind("rebound"), kind("assist"), kind("turnover"))
    rows = events if until is None else events.where(F.col("t") <= until)
    lines = rows.groupBy("game", "player").agg(*[v.alias(c) for c, v in zip(LINE, values)])
    return players.select("game", "player").distinct().join(lines, ["game", "player"], "left").na.fill(0, list(LINE))


def _sides() -> tuple[Column, Column]:
    """Points of an event for the home side and for the other, which has those without a team too."""
    worth = F.when(_made(), F.coalesce(F.col("points").cast("long"), F.lit(0))).otherwise(F.lit(0))
    home = F.coalesce(F.col("team") == "home", F.lit(False))
    return F.when(home, worth).otherwise(F.lit(0)), F.when(home, F.lit(0)).otherwise(worth)


def side_totals(events: DataFrame, players: DataFrame, until: Column | None = None) -> DataFrame:
    """game, home, away of every game that has players; what unknown players make counts for nobody."""
    home, away = _sides()
    points = _known(events, players, until).groupBy("game").agg(F.sum(home).alias("home"), F.sum(away).alias("away"))
    return players.select("game").distinct().join(points, "game", "left").na.fill(0, ["home", "away"])


def running_score(events: DataFrame, players: DataFrame) -> DataFrame:
    """Scoring events of known players with ``home`` and ``away`` after them, in order of t and ``event_id``."""
    home, away = _sides()
    w = Window.partitionBy("game").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    scored = _known(events, players, None).where(_made() & (F.col("points") > 0))
    return scored.withColumns({"home": F.sum(home).over(w), "away": F.sum(away).over(w)})


def sheet(rows: DataFrame) -> DataFrame:
    """A team's sheet: team, player, ``COUNTS``, pts, fgm, fga, reb, and whether the player has the team's most points, rebounds and assists.

    ``rows``: team, player and ``COUNTS``, nulls as 0. Ties are all marked. Each team has one more row, ``totals``, with the
    sums of its players and no marks. Maxima and totals are one aggregate, which Spark joins back.
    """
    c = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0))
    derived = {"pts": 2 * c("m2") + 3 * c("m3") + c("mf"), "fgm": c("m2") + c("m3"), "fga": c("a2") + c("a3"), "reb": c("oreb") + c("dreb")}
    lines = rows.select("team", "player", *[c(k).alias(k) for k in COUNTS], *[v.alias(k) for k, v in derived.items()])
    numbers, marked = [*COUNTS, *derived], ("pts", "reb", "ast")
    teams = lines.groupBy("team").agg(*[F.sum(k).alias(k) for k in numbers], *[F.max(k).alias(f"top_{k}") for k in marked])
    tops = teams.select(F.col("team").alias("_team"), *[F.col(f"top_{k}").alias(f"_{k}") for k in marked])
    best = lines.join(tops, F.col("team").eqNullSafe(F.col("_team")))
    players = best.select("team", "player", F.lit(False).alias("totals"), *numbers, *[(F.col(k) == F.col(f"_{k}")).alias(f"top_{k}") for k in marked])
    sums = teams.select("team", F.lit(None).cast(rows.schema["player"].dataType).alias("player"), F.lit(True).alias("totals"), *numbers, *[F.lit(False).alias(f"top_{k}") for k in marked])
    return players.unionByName(sums)
