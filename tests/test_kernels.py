import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from trackweave.operators import assign, court
from trackweave.streaming import stateful


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        w = rng.integers(0, 9, (n, m)).astype(float)
        got = sum(w[r, c] for r, c in assign.best_assignment(w))
        a, b = (w, m) if n <= m else (w.T, n)
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(b), len(a)))
        assert got == best


def test_suppression_keeps_no_overlap_and_is_idempotent():
    rng = np.random.default_rng(2)
    b = rng.uniform(0, 10, (40, 2))
    boxes = np.c_[b, b + rng.uniform(2, 6, (40, 2))]
    kept = assign.kept_after_suppression(boxes, 0.5)
    over = assign.iou_matrix(boxes[kept], boxes[kept])
    assert (over[~np.eye(len(kept), dtype=bool)] <= 0.5).all()
    assert assign.kept_after_suppression(boxes[kept], 0.5) == list(range(len(kept)))


@pytest.mark.parametrize(
    "lives, options, want",
    [
        ([(3, "21", 12, 100, 260, 0), (8, "21", 7, 250, 700, 0)], {}, {8: 3}),  # eleven frames together
        ([(3, "21", 12, 100, 260, 0), (8, "21", 7, 250, 700, 0)], {"overlap": 10}, {}),
        ([(3, "21", 12, 100, 260, 0), (8, "21", 7, 120, 240, 0)], {}, {}),
        ([(3, "6", 12, 0, 90, 0), (8, "6", 9, 120, 200, 1)], {}, {}),
        ([(3, "6", 12, 0, 90, None), (8, "6", 9, 120, 200, 1), (9, "6", 8, 300, 350, 0)], {}, {8: 3, 9: 3}),  # the leader's kit alone counts
        ([(3, "6", 12, 0, 90, 1), (8, "6", 9, 300, 400, 1), (9, "6", 8, 60, 320, 1)], {}, {8: 3}),  # against all that joined
        ([(3, "6", 12, 0, 90, 1), (8, "6", 4, 300, 400, 1)], {}, {}),
    ],
)
def test_tracklet_merge(lives, options, want):
    pdf = pd.DataFrame(lives, columns=["tid", "number", "votes", "start", "end", "kit"])
    assert assign.merged_tracklets(pdf, **options) == want


def test_most_votes_for_all_numbers_lead():
    pdf = pd.DataFrame([(3, "6", 9, 9, 0, 90, 1), (8, "6", 8, 14, 200, 300, 1)], columns=["tid", "number", "votes", "total", "start", "end", "kit"])
    assert assign.merged_tracklets(pdf) == {3: 8}


def test_homography_from_points_and_lines():
    h = np.array([[40, 3, 100], [2, 35, 60], [0.002, 0.001, 1]])
    to = lambda p: (lambda q: q[:, :2] / q[:, 2:])(np.c_[p, np.ones(len(p))] @ h.T)
    p = np.array([[0, 0], [28, 0], [28, 15], [0, 15], [14, 7.5]], float)
    assert np.allclose(court.homography(p, to(p)), h, atol=1e-6)
    lines = np.array([[1, 0, 0], [1, 0, -28], [0, 1, 0], [0, 1, -15], [1, 1, -20]], float)
    images = np.array([np.linalg.inv(h).T @ x for x in lines])
    assert np.allclose(court.homography(np.empty((0, 2)), np.empty((0, 2)), lines, images), h, atol=1e-5)
    assert np.allclose(court.homography(p[[0, 1, 4]], to(p[[0, 1, 4]]), lines[3:], images[3:]), h, atol=1e-5)
    assert court.homography(p[:3], to(p[:3]), lines[:2], images[:2]) is None, "points on the lines"
    assert court.homography(p[:3], to(p[:3])) is None
    flat = np.array([[0, 0], [1, 0], [2, 0], [3, 0]], float)
    assert court.homography(flat, to(flat)) is None


def test_hull_and_two_means():
    assert court.hull_area(np.array([[0, 0], [2, 0], [2, 3], [0, 3], [1, 1]], float)) == 6
    assert court.hull_area(np.array([[0, 0], [1, 1], [2, 2]], float)) == 0
    x = np.r_[np.random.default_rng(0).normal(0, 1, (20, 3)), np.random.default_rng(1).normal(9, 1, (20, 3))]
    label = court.two_means(x)
    assert len(set(label[:20])) == len(set(label[20:])) == 1 and label[0] != label[-1]
    assert court.two_means(x[:1]).tolist() == [0] and court.two_means(x[:0]).tolist() == []
    assert set(court.two_means(np.ones((4, 2))).tolist()) == {0}


def test_cover_and_matches():
    assert assign.greedy_cover({1: {1, 2}, 2: {2, 3, 4}, 3: {1}, 4: {5}}, 3) == [2, 1, 4]
    a = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [50, 50, 60, 60]], float)
    assert assign.matched_counts(a, a[[0, 2]]) == (2, 1, 0)


def test_cuts_and_debounce():
    def like(a, i):
        return 1.0 if scene[a] == scene[i] else 0.0

    scene = [0] * 10 + [1] * 2 + [0] * 10 + [2] * 10
    similar = np.array([1.0] + [like(i - 1, i) for i in range(1, len(scene))])
    assert stateful.confirmed_cuts(similar, like) == [22]
    t = np.arange(20) / 10
    assert stateful.debounced(np.isin(np.arange(20), [1, 2, 3, 15]), t) == [1, 15]


def frames():
    rng = random.Random(1)
    rows, where = [], {c: [(5.0, 5.0), (20.0, 10.0)] for c in (1, 2)}
    for f in range(60):
        for c, pts in where.items():
            for i, (x, y) in enumerate(pts):
                if rng.random() < 0.9:
                    rows.append((c, f, i, x, y))
                pts[i] = (x + rng.uniform(-1, 1), y + rng.uniform(-1, 1))
    return rows


def test_tracker_stream_equals_batch(spark, tmp_path):
    schema = "clip long, frame long, point long, x double, y double"
    rows = frames()
    want = sorted(map(tuple, stateful.tracked(spark.createDataFrame(rows, schema)).collect()))
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stateful.tracked_stream(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tracked").collect())) == want
    assert len({r[5] for r in want if r[0] == 1}) < 8


def test_every_row_is_in_a_frame_that_is_judged(spark):
    from trackweave.plans import kernel_queries

    sf = "/root/testdata/sf0.001"
    got = {(r.clip, r.frame) for r in kernel_queries.homography_dlt(spark, sf).select("clip", "frame").collect()}
    orders = [r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()]
    assert got == {(k // 4000, k // 4) for k in orders}


def many_boxes(n, seed, crowd=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(12), rng.randrange(8)
        rows.append((i // crowd, rng.randrange(5), float(x), float(y), float(x + rng.choice([0, 6, 9, 14])), float(y + rng.choice([5, 8])), rng.choice([1.0, 2.0, 3.0, None])))
    return rows


BOXES = "frame long, tid int, x1 double, y1 double, x2 double, y2 double, score double"


def in_frames(rows, order):
    for f in sorted({r[0] for r in rows}):
        yield f, sorted((r for r in rows if r[0] == f), key=order)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_suppression_of_frames_is_spark_s_own_and_equals_the_plain_form(spark):
    rows = many_boxes(700, 3)
    out = assign.suppressed(spark.createDataFrame(rows, BOXES), ["frame"], "score", "tid", 0.5)
    want = []
    for _, mine in in_frames(rows, lambda r: (r[6] is None, -(r[6] or 0), r[1], *r[2:6])):
        want += [mine[i] for i in assign.kept_after_suppression(np.array([r[2:6] for r in mine]), 0.5)]
    key = lambda r: tuple(-1.0 if v is None else v for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert len(want) < len(rows) and "Python" not in plan_of(out) and "Pandas" not in plan_of(out)


def test_matches_of_frames_are_spark_s_own_and_equal_the_plain_form(spark):
    rows = [(*r[:6], i % 3 > 0) for i, r in enumerate(many_boxes(700, 4))]
    out = assign.match_rates(spark.createDataFrame(rows, BOXES.replace("score double", "truth boolean")), ["frame"], "truth", "tid", 0.5)
    box = lambda rs: np.array([r[2:6] for r in rs], float).reshape(-1, 4)
    want = [(f, *assign.matched_counts(box([r for r in mine if not r[6]]), box([r for r in mine if r[6]]), 0.5)) for f, mine in in_frames(rows, lambda r: r[1:6])]
    assert sorted(map(tuple, out.collect())) == want
    assert sum(w[1] for w in want) > 20 and "Python" not in plan_of(out) and "Pandas" not in plan_of(out)


@pytest.mark.parametrize("both", [False, True])
def test_conflicts_of_frames_are_spark_s_own_and_equal_the_plain_form(spark, both):
    rows = many_boxes(700, 5)
    out = assign.without_conflicts(spark.createDataFrame(rows, BOXES), ["frame"], "tid", "score", 0.8, drop_both=both)
    want = []
    for _, mine in in_frames(rows, lambda r: (r[1], r[6] is None, -(r[6] or 0), *r[2:6])):
        gone = set()
        for i, j in itertools.combinations(range(len(mine)), 2):
            (a, b, c, d), (e, f, g, h) = mine[i][2:6], mine[j][2:6]
            shared, small = max(0, min(c, g) - max(a, e)) * max(0, min(d, h) - max(b, f)), min((c - a) * (d - b), (g - e) * (h - f))
            if i in gone or j in gone or small <= 0 or shared / small < 0.8:
                continue
            weaker = mine[i][6] is not None and mine[j][6] is not None and mine[i][6] < mine[j][6]
            gone |= {i, j} if both else {i if weaker else j}
        want += [m for i, m in enumerate(mine) if i not in gone]
    key = lambda r: tuple(-1.0 if v is None else v for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert len(want) < len(rows) and "Python" not in plan_of(out) and "Pandas" not in plan_of(out)


def test_frames_are_calibrated_by_batches_as_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows = []
    for f in range(300):
        n = int(rng.integers(1, 14))
        p = rng.integers(0, [29, 16], (n, 2)).astype(float) if f % 5 else np.c_[np.arange(n), np.zeros(n)] + (np.arange(n)[:, None] == 0) * [0, 9.0 * (f % 2)]
        q = np.c_[40 * p[:, 0] + 3 * p[:, 1] + 100, 2 * p[:, 0] + 35 * p[:, 1] + 60] / (0.002 * p[:, :1] + 0.001 * p[:, 1:] + 1) + (f % 3) * (f % 5 > 0) * rng.normal(0, 8, (n, 2))
        rows += [(f // 40, f, *map(float, r)) for r in np.c_[p, q]]
    schema = "clip long, frame long, court_x double, court_y double, x double, y double"
    out = court.calibrated(spark.createDataFrame([*rows, (0, 0, None, 1.0, 1.0, 1.0), (9, 999, 1.0, float("nan"), 1.0, 1.0)], schema))
    got = {r.frame: r for r in out.collect()}
    assert got[999].reason == "too few landmarks" and len(got) == 301 and "FlatMapGroupsInPandas" not in plan_of(out)
    assert {r.reason for r in got.values()} >= {None, "too few landmarks", "small coverage", "large residual"}
    for f, mine in in_frames([r[1:] for r in rows], lambda r: r[1:]):
        h, error, reason = court.solved_frame(pd.DataFrame(mine, columns=["frame", "court_x", "court_y", "x", "y"]))
        assert (got[f].reason, got[f].solved) == (reason, h is not None)
        assert np.isnan(error) and np.isnan(got[f].rms_px) or abs(error - got[f].rms_px) < 1e-6
        assert h is None or np.allclose(np.array(got[f].h).reshape(3, 3), h, rtol=1e-5, atol=1e-6)


def test_tracker_ranks_only_pairs_inside_the_gate():
    rng = np.random.default_rng(9)
    tracker, live, nxt = stateful.CourtTracker(), {}, 1
    for _ in range(40):
        points = rng.uniform(0, 12, (25, 2))
        pairs = sorted((float(np.hypot(s[0] + s[2] - p[0], s[1] + s[3] - p[1])), i, t) for t, s in tracker.live.items() for i, p in enumerate(points))
        want, used = {}, set()
        for d, i, t in pairs:
            if d <= tracker.gate and i not in want and t not in used:
                want[i] = t
                used.add(t)
        first = tracker.nxt
        got = tracker.step(points)
        assert {i: t for i, t in enumerate(got) if t < first} == want
    began = time.perf_counter()
    wide = stateful.CourtTracker()
    for _ in range(6):
        wide.step(rng.uniform(0, 2000, (400, 2)))
    assert time.perf_counter() - began < 4, "two thousand tracks and 400 points a frame"


def test_groups_of_few_rows_go_to_python_by_batches(spark):
    rng = np.random.default_rng(5)
    columns = ["clip", "tid", "number", "votes", "total", "start", "end", "kit"]
    rows = [(c, t, str(int(rng.integers(3))), int(rng.integers(3, 9)), int(rng.integers(9, 12)), s := int(rng.integers(80)), s + int(rng.integers(5, 40)), [None, 0.0, 1.0][int(rng.integers(3))]) for c in range(300) for t in range(1, 7)]
    df = spark.createDataFrame(rows, "clip long, tid long, number string, votes long, total long, start long, end long, kit double")
    out = assign.tracklet_merges(df, "clip")
    want = {(c, t, to) for c, part in pd.DataFrame(rows, columns=columns).groupby("clip") for t, to in assign.merged_tracklets(part).items()}
    assert want and {tuple(r) for r in out.collect()} == want
    votes = spark.createDataFrame([(c, t, n, float(1 + (c + t * n) % 4)) for c in range(50) for t in range(1, 4) for n in (1, 2, 3)], "clip long, tid long, number long, votes double")
    pairs = assign.assigned(votes, ["clip"], "tid", "number", "votes", 3)
    assert pairs.groupBy("clip", "tid").count().where("count > 1").count() == pairs.groupBy("clip", "number").count().where("count > 1").count() == 0
    for made in (out, pairs):  # no pandas frame for each of the groups, which are as many as there are clips
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
