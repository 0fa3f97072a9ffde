import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions.courts import EIGHTEEN, Court, candidates, landmark_table, on_landmarks
from trackweave.operators import calibration, planes, registration
from trackweave.operators.tasks import ROWS_A_TASK

H = np.array([[40, 3, 100], [2, 35, 60], [0.002, 0.001, 1]])
CORNERS = np.array([[0, 0], [28, 0], [28, 15], [0, 15]], float)


def falsified(rng, n, share, noise=0.0):
    p = np.c_[rng.uniform(0, 28, n), rng.uniform(0, 15, n)]
    q = calibration.projected(H, p) + rng.normal(0, 1, (n, 2)) * noise
    wrong = rng.choice(n, int(share * n), replace=False)
    q[wrong] += rng.choice([-1, 1], (len(wrong), 2)) * rng.uniform(60, 300, (len(wrong), 2))
    return p, q, wrong


def test_third_of_false_landmarks_is_seen_through():
    rng = np.random.default_rng(1)
    for _ in range(100):
        p, q, wrong = falsified(rng, int(rng.integers(10, 24)), 0.3)
        found = calibration.robust_frame(p, q)
        assert found["reason"] is None and found["inliers"] == len(p) - len(wrong)
        assert np.allclose(found["h"] / found["h"][2, 2], H, atol=1e-6)


def test_noise_keeps_the_court_in_place():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(60):
        p, q, wrong = falsified(rng, 18, 0.3, noise=1.0)
        found = calibration.robust_frame(p, q)
        assert len(p) - len(wrong) - 1 <= found["inliers"] <= len(p) - len(wrong) + 1
        off.append(np.abs(calibration.projected(found["h"], CORNERS) - calibration.projected(H, CORNERS)).max())
    assert np.median(off) < 6


def test_best_subset_of_a_small_frame_is_found_by_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, q, _ = falsified(rng, 9, 0.34, noise=0.5)
        _, inside = calibration.consensus(p, q)
        most = 0
        for four in itertools.combinations(range(9), 4):
            h = calibration.homography(p[list(four)], q[list(four)])
            if h is not None:
                most = max(most, int((np.hypot(*(calibration.projected(h, p) - q).T) <= 8).sum()))
        assert inside.sum() >= most


def test_all_subsets_are_tried_where_the_draws_may_have_missed():
    """Seven of 24 landmarks are in place; no draw of these frames has four of them."""
    for seed in (3, 4):
        rng = np.random.default_rng(seed)
        p = np.c_[rng.uniform(0, 28, 24), rng.uniform(0, 15, 24)]
        q, wrong = calibration.projected(H, p), rng.permutation(24)[7:]
        q[wrong] = rng.uniform(0, 2000, (17, 2))
        h, inside = calibration.consensus(p, q)
        assert set(np.flatnonzero(inside)) == set(range(24)) - set(wrong) and np.allclose(h / h[2, 2], H, atol=1e-6)


def test_frames_are_solved_as_a_stack():
    """Each frame has what it has alone, whatever its neighbours are: all false, on a line, without finite numbers."""
    rng = np.random.default_rng(6)
    frames = [falsified(rng, 15, share, noise)[:2] for share in (0.1, 0.3, 0.5) for noise in (0.0, 1.0) for _ in range(8)]
    p, q = (np.stack(side) for side in zip(*frames))
    q[3], p[5, :, 1], q[9, 2], p[11, 4] = rng.uniform(0, 900, (15, 2)), p[5, :, 0] / 2, np.nan, np.inf
    h, inliers, error, reason = calibration.robust_frames(p, q, least=9)
    for i in range(len(p)):
        alone = calibration.robust_frame(p[i], q[i], least=9)
        assert (inliers[i], reason[i]) == (alone["inliers"], alone["reason"]) and np.allclose(error[i], alone["rms_px"], equal_nan=True)
        assert np.isnan(h[i]).all() if alone["h"] is None else np.allclose(h[i] / h[i, 2, 2], alone["h"] / alone["h"][2, 2], atol=1e-6)
    assert {None, "too few landmarks agree", "small coverage", "undetermined"} == set(reason)


def test_more_landmarks_more_tasks(spark):
    rows = spark.range(40).selectExpr("id div 20 as clip", "id div 10 as frame", "double(id) as court_x", "double(id % 7) as court_y", "double(id) as x", "double(id) as y")
    out = calibration.robust_calibrated(rows, count=6 * ROWS_A_TASK)
    assert out.count() == 4 and ", 6)" in out._jdf.queryExecution().toString()


def test_guards_refuse():
    rng = np.random.default_rng(4)
    p, q, _ = falsified(rng, 12, 0.25)
    assert calibration.robust_frame(p[:4], q[:4])["reason"] == "too few landmarks"
    assert calibration.robust_frame(p / 10, calibration.projected(H, p / 10))["reason"] == "small coverage"
    assert calibration.robust_frame(p, q, judge="all")["reason"] == "large residual"
    line = np.c_[np.linspace(0, 28, 8), np.linspace(0, 15, 8)]
    assert calibration.robust_frame(line, calibration.projected(H, line), area=0)["reason"] == "undetermined"
    assert calibration.robust_frame(p, rng.uniform(0, 900, (12, 2)))["h"] is None
    same = np.repeat(p[:1], 6, axis=0)
    assert calibration.robust_frame(same, same, area=0)["reason"] == "undetermined"


def test_frames_of_a_table_and_rows_without_a_place(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for frame in range(12):
        p, q, wrong = falsified(rng, 14, 0.3)
        rows += [(1, frame, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
        want[frame] = 14 - len(wrong)
    rows += [(1, 0, None, 1.0, 2.0, 3.0), (2, 0, 1.0, 1.0, 5.0, 5.0)]
    got = {(r["clip"], r["frame"]): r for r in calibration.robust_calibrated(spark.createDataFrame(rows, "clip int, frame int, court_x double, court_y double, x double, y double")).collect()}
    assert {f: got[1, f]["inliers"] for f in want} == want and all(got[1, f]["solved"] for f in want)
    assert (got[2, 0]["solved"], got[2, 0]["reason"]) == (False, "too few landmarks")
    assert calibration.robust_calibrated(spark.createDataFrame([], "clip int, frame int, court_x double, court_y double, x double, y double")).count() == 0


def test_reference_gate_joins_landmarks_and_judges_all(spark):
    marks = landmark_table(spark, EIGHTEEN)
    seen = calibration.projected(H, np.array(EIGHTEEN))
    rows = [(1, f, str(i), float(x), float(y), 0.9 if f < 2 or i < 5 else 0.2) for f in range(3) for i, (x, y) in enumerate(seen)]
    rows += [(1, 0, "99", 1.0, 1.0, 0.9)] + [(1, 1, "0", 500.0, 500.0, 0.9)]
    got = {r["frame"]: (r["solved"], r["reason"], r["landmarks"]) for r in calibration.reference_gate(spark.createDataFrame(rows, "clip int, frame int, name string, x double, y double, confidence double"), marks).collect()}
    assert got == {0: (True, None, 18), 1: (False, "large residual", 19), 2: (False, "too few landmarks", 5)}


def test_court_tables(spark):
    court = Court()
    points, lines = court.landmarks(), court.lines()
    assert len(points) == 20 and len(lines) == 9 and list(points)[:4] == ["corner_ws", "corner_wn", "corner_es", "corner_en"]
    assert points["ekey_ft_n"] == (28 - 5.8, 7.5 + 2.45) and points["w3pt_n"] == (0.0, 15 - 0.9) and points["circle_s"] == (14.0, 5.7)
    assert lines["ft_e"] == ((28 - 5.8, 7.5 - 2.45), (28 - 5.8, 7.5 + 2.45))
    marks = landmark_table(spark, points)
    mirror = {r["ix"]: r["mirror"] for r in planes.mirror_partners(marks, 28.0, "ix", "court_x", "court_y").collect()}
    assert all(mirror[mirror[i]] == i for i in range(20))  # every landmark has its partner, so labels can be flipped
    known = candidates()
    assert len(known) == 23 and known["e_3pt_n"] == (28.0, 14.1) and known["w_ft_mid"] == (5.79, 7.59)
    assert on_landmarks(spark.createDataFrame([("corner_ws", 0.9), ("corner_en", 0.1), ("nowhere", 0.9)], "name string, confidence double"), marks, 0.5).count() == 1


def matrix_at(t):
    return np.array([[40 + t, 3, 100 + 7 * t], [2, 35, 60 - 3 * t], [0.002, 0.001, 1]])


def test_bridge_moves_corners_in_a_straight_line(spark):
    solved = {0: 0, 5: 1, 15: 2, 35: 3, 60: 4, 65: 5}
    rows = [(1, f, matrix_at(solved[f]).ravel().tolist() if f in solved else None) for f in range(0, 90, 5)] + [(2, 10, None)]
    got = {r["frame"]: r for r in calibration.bridged(spark.createDataFrame(rows, "clip int, frame int, h array<double>"), 5).where("clip = 1").collect()}
    assert {f for f, r in got.items() if r["interpolated"]} == {10, 20, 25, 30}  # the gap after 35 has four samples, that after 65 no end
    assert {f: got[f]["bridge"] for f in (10, 20, 25, 30)} == {10: 1, 20: 3, 25: 3, 30: 3}
    for f, a, b, t in ((10, 1, 2, 1 / 2), (20, 2, 3, 1 / 4), (30, 2, 3, 3 / 4)):
        want = (1 - t) * calibration.projected(matrix_at(a), CORNERS) + t * calibration.projected(matrix_at(b), CORNERS)
        assert np.allclose(calibration.projected(np.array(got[f]["h"]).reshape(3, 3), CORNERS), want, atol=1e-6)


def test_four_corners_have_no_matrix_on_a_line(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    flat = F.array(*[point(i, i) for i in range(4)])
    assert spark.range(1).select(calibration.quad_matrix(flat, 28.0, 15.0).alias("h")).first()["h"] is None


def sequential(rows):
    """The chain as a plain loop over the frames of a clip."""
    before, out = None, {}
    for frame, direct, inliers, overlap, step, steps in rows:
        if direct is not None and inliers >= 25 and overlap >= 0.3:
            before, method = np.reshape(direct, (3, 3)), "direct"
        elif step is not None and steps >= 25 and before is not None:
            before, method = np.reshape(step, (3, 3)) @ before, "chained"
        else:
            before, method = None, "failed"
        out[frame] = (method, before)
    return out


@pytest.mark.parametrize("width", [3, 7, 4096])
def test_chain_equals_a_sequential_fold(spark, width):
    rng = np.random.default_rng(width)
    rows, want = [], {}
    for clip in (1, 2):
        mine = []
        for frame in range(0, 400, 2):
            turn = rng.normal(0, 0.05)
            step = np.array([[np.cos(turn), -np.sin(turn), rng.normal()], [np.sin(turn), np.cos(turn), rng.normal()], [0, 0, 1]])
            direct = None if rng.random() < 0.2 else (np.eye(3) + rng.normal(0, 0.01, (3, 3))).ravel().tolist()
            mine.append((frame, direct, int(rng.integers(0, 60)), float(rng.random()) * (0.2 if clip == 2 else 0.45), None if rng.random() < 0.05 else step.ravel().tolist(), int(rng.integers(20, 200))))
        want |= {(clip, f): v for f, v in sequential(mine).items()}
        rows += [(clip, *r) for r in mine]
    links = spark.createDataFrame(rows, "clip int, frame int, direct array<double>, direct_inliers int, overlap double, step array<double>, step_inliers int").repartition(5)
    got = {(r["clip"], r["frame"]): r for r in registration.chained(links, width=width).collect()}
    assert {k: r["method"] for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((r["h"] is None) == (want[k][1] is None) and (r["h"] is None or np.allclose(np.reshape(r["h"], (3, 3)), want[k][1], atol=1e-9)) for k, r in got.items())
    assert {v[0] for v in want.values()} == {"direct", "chained", "failed"}


def test_chain_streams_sorted_rows_through_its_blocks(spark):
    """Batches that part blocks, frames before zero, one long chain over many blocks; no task lists a block or a whole clip's frames."""
    step = lambda f: [1.0, 0.0, float(f % 7), 0.0, 1.0, float(f % 5), 0.0, 0.0, 1.0]
    mine = [(f, step(f) if f in (-40, 90) else None, 60, 0.9, None if f == 70 else step(f), 60) for f in range(-50, 130)]
    want = sequential(mine)
    links = spark.createDataFrame([(c, *r, "x") for c in ("a", "b") for r in mine], "clip string, frame long, direct array<double>, direct_inliers int, overlap double, step array<double>, step_inliers int, note string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = registration.chained(links, width=16, keep=["note"])
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.columns == ["clip", "frame", "note", "method", "h"] and len(got) == 360 and {r["note"] for r in got} == {"x"}
    assert all(r["method"] == want[r["frame"]][0] and (r["h"] is None if r["method"] == "failed" else np.array_equal(np.reshape(r["h"], (3, 3)), want[r["frame"]][1])) for r in got)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_clicks_of_many_frames_meet_on_the_hub(spark):
    """Five frames seen through known cameras; only neighbours are linked, so clicks come along one, two or three links."""
    court = Court()
    points, lines = court.landmarks(), court.lines()
    cameras = {f: matrix_at(i) for i, f in enumerate((10, 20, 30, 40, 50))}
    see = lambda f, xy: calibration.projected(cameras[f], np.array([xy], float))[0].tolist()
    clicks = []
    for f, names in {10: ["corner_ws", "half_s"], 20: ["circle_s", "circle_n", "half_n", "wkey_ft_s"], 30: ["corner_es"], 40: ["ekey_ft_s", "half_n"], 50: ["e3pt_n"]}.items():
        clicks += [(1, f, "point", n, *see(f, points[n]), None, None) for n in names]
    a, b = lines["sideline_n"]
    clicks.append((1, 40, "line", "sideline_n", *see(40, (a[0] + 3, a[1])), *see(40, (b[0] - 9, b[1]))))
    clicks.append((1, 30, "line", "no such line", 1.0, 2.0, 3.0, 4.0))
    clicks = [c if c[3] != "corner_es" else (*c[:4], c[4] + 90.0, *c[5:]) for c in clicks]  # one bad click
    link = lambda f, g, n: (1, f, g, (cameras[g] @ np.linalg.inv(cameras[f])).ravel().tolist(), n)
    links = [link(10, 20, 80), link(30, 20, 60), link(40, 30, 60), link(40, 50, 30), link(10, 50, 24), (1, 50, 20, None, 90)]
    df = spark.createDataFrame(clicks, "clip int, frame int, kind string, name string, x1 double, y1 double, x2 double, y2 double")
    registrations = spark.createDataFrame(links, "clip int, a int, b int, h array<double>, inliers int")
    assert registration.hubs(df).collect()[0]["hub"] == 20
    paths = {r["frame"]: r for r in registration.paths_to_hub(registrations, registration.hubs(df)).collect()}
    assert {f: r["hops"] for f, r in paths.items()} == {20: 0, 10: 1, 30: 1, 40: 2, 50: 3}
    for f, r in paths.items():
        m = np.reshape(r["h"], (3, 3))
        assert np.allclose(m / m[2, 2], (lambda w: w / w[2, 2])(cameras[20] @ np.linalg.inv(cameras[f])), atol=1e-9)
    out = {r["name"]: r for r in registration.fused_calibration(df, registrations, points, lines).collect()}
    assert len(out) == 10 and out["half_n"]["frame"] == 40  # of two clicks of a name the later frame's counts
    assert out["corner_es"]["again"] and {r["verdict"] for r in out.values()} == {"failed"}
    clean = {r["name"]: r for r in registration.fused_calibration(df.where("name <> 'corner_es'"), registrations, points, lines).collect()}
    assert all(r["residual"] < 1e-6 and r["verdict"] == "usable" and not r["again"] for r in clean.values())
    m = np.reshape(clean["half_n"]["h"], (3, 3))
    assert np.allclose(m / m[2, 2], cameras[20], atol=1e-6)
    thin = registration.fused_calibration(df.where("name in ('circle_s', 'circle_n', 'ekey_ft_s', 'wkey_ft_s')"), registrations, points, {}).collect()
    assert {r["verdict"] for r in thin} == {"thin"}
    few = registration.fused_calibration(df.where("name in ('circle_s', 'circle_n')"), registrations, points, lines).collect()
    assert {r["verdict"] for r in few} == {"undetermined"}


def test_overlap_of_a_frame_by_sampling(spark):
    rng = np.random.default_rng(12)
    quads, want = [], {}
    xs, ys = np.meshgrid((np.arange(300) + 0.5) / 300 * 60, (np.arange(200) + 0.5) / 200 * 40)
    for i in range(60):
        turn, middle, size = rng.uniform(0, 6.28), rng.uniform(-10, 60, 2), rng.uniform(5, 60, 2)
        corners = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * size / 2
        quad = corners @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]]) + middle
        inside = np.ones(xs.shape, bool)
        for p, q in zip(quad, np.roll(quad, -1, axis=0)):
            inside &= (q[0] - p[0]) * (ys - p[1]) - (q[1] - p[1]) * (xs - p[0]) >= 0
        quads.append((i, [tuple(map(float, p)) for p in (quad if i % 6 else quad[::-1])]))
        want[i] = inside.mean() if i % 6 else 0.0
    quads += [(100, None), (101, []), (102, [(0.0, 0.0), (5.0, 5.0)]), (103, [(0.0, 0.0), (60.0, 0.0), (0.0, 40.0)]), (104, [(float("nan"), 0.0)] * 4)]
    want |= {100: 0.0, 101: 0.0, 102: 0.0, 103: 0.5, 104: 0.0}
    got = {r["i"]: r["overlap"] for r in planes.rectangle_overlap(spark.createDataFrame(quads, "i int, quad array<struct<x:double,y:double>>"), "quad", 60.0, 40.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.01 for i in want)
    assert sum(0.02 < v < 0.98 for v in want.values()) > 15


def test_clips_are_dealt_to_all_tasks(spark):
    from trackweave.operators import registration
    from trackweave.streaming import heartbeat

    clicks = spark.createDataFrame([(c, "point", "a", 0, 1.0, 1.0, None, None, 0) for c in range(40)], "clip long, kind string, name string, frame long, x1 double, y1 double, x2 double, y2 double, hops int")
    updates = spark.createDataFrame([(j, "running", 1, 2) for j in range(40)], "job long, state string, done long, total long").selectExpr("*", "timestamp_seconds(job) as at")
    for out in (registration.fused_solve(clicks, {"a": (0.0, 0.0)}, {}), heartbeat.pulses(updates)):
        assert out.count() == 40
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, "few bytes and much work: adaptive execution must not put the tasks together"
