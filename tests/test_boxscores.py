"""Box scores and feature thresholds on small hand-made games."""

from pyspark.sql import functions as F

from trackweave.operators import boxscores, evaluate

EVENT = "event_id long, game string, player long, t double, type string, points int, team string"


def game(spark):
    rows = [
        (1, "a", 1, 1.0, "shot_made", 2, "home"),
        (2, "a", 2, 2.0, "shot_made", 3, "away"),
        (3, "a", 1, 3.0, "shot_missed", 3, "home"),
        (4, "a", 9, 4.0, "shot_made", 2, "home"),  # on no list
        (5, "a", 2, 5.0, "shot_made", 2, None),  # without a team: the other side's
        (6, "a", 1, 5.0, "shot_made", None, "home"),  # a goal without points
        (7, "a", 1, 6.0, "rebound", None, "home"),
        (8, "a", 2, None, "assist", None, "away"),  # without a time: counts at the end only
        (9, "a", 2, 8.0, "turnover", None, "away"),
        (10, "a", 2, 8.5, "foul", None, "away"),
        (11, "b", 1, 1.0, "shot_made", 3, "home"),
    ]
    players = [("a", 1), ("a", 2), ("a", 3), ("a", 1), ("b", 1), ("c", 4)]
    return spark.createDataFrame(rows, EVENT), spark.createDataFrame(players, "game string, player long")


def lines(df):
    return {(r.game, r.player): tuple(r[c] for c in boxscores.LINE) for r in df.collect()}


def test_lines_keep_players_without_events(spark):
    events, players = game(spark)
    nothing = (0,) * 8
    assert lines(boxscores.stat_lines(events, players)) == {
        ("a", 1): (2, 2, 3, 0, 1, 1, 0, 0),
        ("a", 2): (5, 2, 2, 1, 1, 0, 1, 1),
        ("a", 3): nothing,
        ("b", 1): (3, 1, 1, 1, 1, 0, 0, 0),
        ("c", 4): nothing,
    }
    early = lines(boxscores.stat_lines(events, players, F.lit(2.0)))
    assert early[("a", 1)] == (2, 1, 1, 0, 0, 0, 0, 0) and early[("a", 2)] == (3, 1, 1, 1, 1, 0, 0, 0)
    assert lines(boxscores.stat_lines(events.limit(0), players))[("a", 1)] == nothing
    assert lines(boxscores.stat_lines(events, players.limit(0))) == {}


def test_points_of_the_sides(spark):
    events, players = game(spark)
    said = lambda df: {r.game: (r.home, r.away) for r in df.collect()}
    assert said(boxscores.side_totals(events, players)) == {"a": (2, 5), "b": (3, 0), "c": (0, 0)}
    assert said(boxscores.side_totals(events, players, F.lit(1.5))) == {"a": (2, 0), "b": (3, 0), "c": (0, 0)}
    found = boxscores.running_score(events, players).orderBy("event_id").select("event_id", "home", "away").collect()
    assert [tuple(r) for r in found] == [(1, 2, 0), (2, 2, 3), (5, 2, 5), (11, 3, 0)]


def test_sheet_marks_ties_and_sums_nulls_as_nothing(spark):
    names = ", ".join(f"{c} int" for c in boxscores.COUNTS)
    blank = dict.fromkeys(boxscores.COUNTS, 0)
    rows = [("x", 1, blank | {"m2": 3, "oreb": 1}), ("x", 2, blank | {"m3": 2, "dreb": 2, "ast": None}), ("x", 3, blank | {"mf": 1, "tov": None}), (None, 4, dict.fromkeys(boxscores.COUNTS))]
    df = spark.createDataFrame([(t, p, *v.values()) for t, p, v in rows], f"team string, player long, {names}")
    got = {(r.team, r.player): r for r in boxscores.sheet(df).collect()}
    assert len(got) == 6
    one, two, three, total = (got["x", p] for p in (1, 2, 3, None))
    assert (one.pts, two.pts, three.pts, total.pts) == (6, 6, 1, 13)
    assert (one.top_pts, two.top_pts, three.top_pts) == (True, True, False)
    assert (one.top_reb, two.top_reb, two.reb, total.reb) == (False, True, 2, 3)
    assert one.top_ast and two.top_ast and total.totals and not (total.top_pts or one.totals)
    assert got[None, 4].top_pts and got[None, 4].pts == 0 and got[None, None].totals


def test_feature_sweep_counts_as_a_plain_loop(spark):
    rows = [(h, c, g) for h in (None, 1.0, 2.0, 3.0) for c in (0.1, 0.5) for g in (True, False, None)]
    df = spark.createDataFrame(rows, "h double, c double, g boolean")
    ranges = {"h": (1, 4), "c": (0.1, 0.7)}
    want = set()
    for ix, (name, (low, high)) in enumerate(ranges.items()):
        for i in range(4):
            cut = low + (high - low) * i / 3
            reaches = [r[ix] is not None and r[ix] >= cut for r in rows]
            want.add((name, round(cut, 9), sum(reaches), sum(not k and r[2] is False for k, r in zip(reaches, rows)), sum(not k and r[2] is True for k, r in zip(reaches, rows))))
    got = evaluate.feature_sweep(df, ranges, F.col("g")).collect()
    assert {(r.feature, round(r.cut, 9), r.kept, r.bad_dropped, r.good_lost) for r in got} == want and len(got) == 8
    assert all(r.kept == 0 for r in evaluate.feature_sweep(df.limit(0), ranges, F.col("g")).collect())
