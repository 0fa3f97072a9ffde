from trackweave.operators import identity


def test_chain_names_tracks_merges_and_drops_collapsed_reads(spark):
    tracks, reads, kit = [], [], []

    def add(tid, frames, x, number, cluster):
        for f in frames:
            tracks.append((1, f, tid, float(x), 0.0, x + 8.0, 20.0))
            if f % 10 == 0:
                reads.append((1, f, tid, number))
                kit.append((1, f, tid, cluster))

    add(1, range(0, 300), 0, "4", 0)
    add(2, range(310, 600), 0, "4", 0)
    add(3, range(0, 600), 50, "7", 0)
    add(4, range(0, 600), 100, "9", 1)
    add(5, range(0, 600), 150, "11", 1)
    # Track 6 runs onto track 5 for two seconds in mid-life and is read as 5's number there.
    add(6, list(range(0, 200)) + list(range(330, 600)), 220, "12", 1)
    for f in range(200, 330):
        tracks.append((1, f, 6, 150.0, 0.0, 158.0, 20.0))
        reads.append((1, f, 6, "11"))
    roster = spark.createDataFrame([("home", "4", "A"), ("home", "7", "B"), ("away", "9", "C"), ("away", "11", "D"), ("away", "12", "E")], "club string, number string, name string")
    out = identity.resolved(
        spark.createDataFrame(tracks, "clip long, frame int, tid long, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(reads, "clip long, frame int, tid long, value string"),
        spark.createDataFrame(kit, "clip long, frame int, tid long, cluster int"),
        roster,
    )
    got = {r.tid: (r.club, r.number, r.name, r.merged_into) for r in out["identities"].collect()}
    assert got == {1: ("home", "4", "A", None), 2: ("home", "4", "A", 1), 3: ("home", "7", "B", None), 4: ("away", "9", "C", None), 5: ("away", "11", "D", None), 6: ("away", "12", "E", None)}
    assert {(r.tid, r.start, r.end) for r in out["collapse"].collect()} == {(5, 200, 329), (6, 200, 329)}


ROSTER = [("home", "4", "A"), ("home", "7", "B"), ("home", "33", "F"), ("away", "9", "C"), ("away", "11", "D"), ("away", "12", "E"), ("away", "8", "G")]


def chain(spark, lives):
    """lives: tid, frames, x, numbers by turns, clusters by turns."""
    tracks, reads, kit = [], [], []
    for tid, frames, x, numbers, clusters in lives:
        for i, f in enumerate(frames):
            tracks.append((1, f, tid, float(x), 0.0, x + 8.0, 20.0))
            if i % 10 == 0:
                reads.append((1, f, tid, numbers[i // 10 % len(numbers)]))
                kit.append((1, f, tid, clusters[i // 10 % len(clusters)]))
    return identity.resolved(
        spark.createDataFrame(tracks, "clip long, frame int, tid long, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(reads, "clip long, frame int, tid long, value string"),
        spark.createDataFrame(kit, "clip long, frame int, tid long, cluster int"),
        spark.createDataFrame(ROSTER, "club string, number string, name string"),
    )


BASE = [(1, range(0, 600), 0, ["4"], [0]), (2, range(0, 600), 50, ["7"], [0]), (3, range(0, 600), 100, ["9"], [1]), (4, range(0, 600), 150, ["11"], [1])]


def test_gates_of_the_chain(spark):
    lives = [
        *BASE,
        (20, range(0, 600), 300, ["12"], [0, 1]),  # two kits, half and half: no name
        (21, range(0, 600), 350, ["33", "8"], [0]),  # two numbers of two clubs: followed two players
        (22, range(0, 100), 400, ["12"], [0, 1]),  # few crops, open colours, but only one club has 12
    ]
    out = chain(spark, lives)
    got = {r.tid: (r.club, r.number, r.name, r.ignored) for r in out["identities"].collect()}
    assert {r.tid for r in out["mixed"].collect()} == {20} and 20 not in got
    assert got[21] == ("home", "33", None, "split-identity")
    assert got[22] == ("away", "12", "E", None)
    assert got[1][:3] == ("home", "4", "A") and got[4][:3] == ("away", "11", "D")


def test_duplicates_go_in_order_and_a_later_pair_keeps_its_track(spark):
    # 30, 31 and 32 run on one another from the start: 31 falls to 30, so the pair of 31 and 32 is not judged again.
    pairs = spark.createDataFrame([(1, 30, 31, 9, 5), (1, 31, 32, 5, 3), (1, 40, 41, 2, 2), (2, 30, 31, 1, 4)], "clip long, first_name long, second_name long, first_votes long, second_votes long")
    from trackweave.operators import assign

    got = {(r.clip, r.tid): r.kept for r in assign.retired_in_order(pairs, "clip").collect()}
    assert got == {(1, 31): 30, (1, 41): 40, (2, 30): 31}


def test_votes_of_merged_tracks_are_judged_together(spark):
    # 50 and 51 are one player; together their kit votes are enough to be mixed, alone they are not.
    lives = [*BASE, (50, range(0, 100), 300, ["12"], [0, 1]), (51, range(110, 250), 300, ["12"], [0, 1])]
    out = chain(spark, lives)
    assert {r.tid for r in out["mixed"].collect()} == {51}  # the one with more votes leads
    assert not {50, 51} & {r.tid for r in out["identities"].collect()}


def test_sides_follow_most_players(spark):
    from trackweave.operators import votes

    rows = [("east", "away"), ("east", "away"), ("east", "home"), ("west", "home"), (None, "home")]
    got = {r.club: r.side for r in votes.side_convention(spark.createDataFrame(rows, "club string, side string")).collect()}
    assert got == {"east": "away", "west": "home"}
    assert votes.side_convention(spark.createDataFrame(rows[:3], "club string, side string")).count() == 0


def test_clusters_are_numbered_anew_in_every_clip(spark):
    """Clip 1, the same clip with its clusters swapped, and one whose clusters say nothing: in one table or each alone."""

    def rows(clip, swap, open_kit=False):
        tracks, reads, kit = [], [], []
        for tid, frames, x, numbers, clusters in BASE:
            for i, f in enumerate(frames):
                tracks.append((clip, f, tid, float(x), 0.0, x + 8.0, 20.0))
                if i % 10 == 0:
                    reads.append((clip, f, tid, numbers[0]))
                    kit.append((clip, f, tid, tid % 2 if open_kit else clusters[0] ^ swap))
        return tracks, reads, kit

    def named(clips):
        parts = [rows(*c) for c in clips]
        tracks, reads, kit = ([r for p in parts for r in p[i]] for i in range(3))
        out = identity.resolved(
            spark.createDataFrame(tracks, "clip long, frame int, tid long, x1 double, y1 double, x2 double, y2 double"),
            spark.createDataFrame(reads, "clip long, frame int, tid long, value string"),
            spark.createDataFrame(kit, "clip long, frame int, tid long, cluster int"),
            spark.createDataFrame(ROSTER, "club string, number string, name string"),
        )
        return {(r.clip, r.tid): (r.club, r.number, r.name) for r in out["identities"].collect()}

    want = {1: ("home", "4", "A"), 2: ("home", "7", "B"), 3: ("away", "9", "C"), 4: ("away", "11", "D")}
    every = named([(1, 0), (2, 1), (3, 0), (4, 0, True)])
    assert every == {(c, t): v for c in (1, 2, 3) for t, v in want.items()}
    assert named([(2, 1)]) == {(2, t): v for t, v in want.items()}
