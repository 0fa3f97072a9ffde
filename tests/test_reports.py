import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import names
from trackweave.operators import assign, layout, paths, reports, runs, timejoin
from trackweave.sources import sidecars

PATHS = "clip long, tid long, frame long, x double, y double"


def plain_clean(points, sigma=3.5, least=0.6 * 0.3048, longest=18, pad=2, window=9):
    """One run of (x, y) by plain loops and numpy's fits."""
    p = np.array(points, float)
    n = len(p)
    if n < 5:
        return p, np.zeros(n, bool)
    d = np.hypot(*np.diff(p, axis=0).T)
    m = np.median(d)
    s = 1.4826 * np.median(np.abs(d - m))
    jumps = [i + 1 for i in range(n - 1) if d[i] > max(least, m + sigma * s)]
    off, k = np.zeros(n, bool), 0
    while k + 1 < len(jumps):
        if jumps[k + 1] - jumps[k] <= longest:
            off[max(0, jumps[k] - pad) : jumps[k + 1] + pad] = True
            k += 2
        else:
            k += 1
    if off.any():
        if off[0] or off[-1]:
            off[:] = False
        else:
            good = np.flatnonzero(~off)
            for c in (0, 1):
                p[off, c] = np.interp(np.flatnonzero(off), good, p[good, c])
    w = min(window, n - (n + 1) % 2)
    out = p.copy()
    for i in range(n):
        low = min(max(i - w // 2, 0), n - w)
        for c in (0, 1):
            out[i, c] = np.polyval(np.polyfit(np.arange(w), p[low : low + w, c], 2), i - low)
    return out, off


def test_paths_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    rows, want, edited = [], {}, 0
    for clip in (1, 2):
        for tid in range(6):
            at = 0
            for length in (3, 4, 5, 8, 9, 40, 90):
                p = np.cumsum(rng.normal(0, 0.05, (length, 2)), axis=0) + rng.uniform(0, 20, 2)
                for _ in range(int(rng.integers(0, 4)) if length > 20 else 0):
                    a = int(rng.integers(0, length - 1))
                    p[a : a + int(rng.choice([1, 3, 10, 18, 19, 30]))] += rng.choice([-4, 5], 2)
                out, off = plain_clean(p)
                edited += off.sum()
                for i in range(length):
                    rows.append((clip, tid, at + i, *map(float, p[i])))
                    want[clip, tid, at + i] = (*out[i], bool(off[i]))
                at += length + 1 + tid % 2
    got = paths.cleaned(spark.createDataFrame(rows, PATHS).repartition(4), ["clip", "tid"]).collect()
    assert len(got) == len(want) and edited > 50
    for r in got:
        x, y, off = want[r.clip, r.tid, r.frame]
        assert r.edited == off and abs(r.x - x) <= 0.0051 and abs(r.y - y) <= 0.0051
    assert paths.cleaned(spark.createDataFrame([], PATHS), ["clip", "tid"]).count() == 0


def test_smoothing_keeps_parabolas_and_lessens_wobble(spark):
    rng = np.random.default_rng(8)
    rows = [(1, 1, i, 0.01 * i * i - 0.3 * i, 5.0 + 0.2 * i) for i in range(40)] + [(1, 2, i, 0.2 * i + rng.normal(0, 0.05), rng.normal(0, 0.05)) for i in range(40)]
    df = spark.createDataFrame(rows, PATHS)
    out = paths.cleaned(df, ["clip", "tid"], sigma=50.0, places=9)
    exact = {(r.tid, r.frame): (r.x, r.y) for r in df.collect()}
    assert all(abs(r.x - exact[1, r.frame][0]) < 1e-8 and abs(r.y - exact[1, r.frame][1]) < 1e-8 for r in out.where("tid = 1").collect())
    before, after = ({r.tid: r.wobble for r in paths.wobble(d, ["clip", "tid"]).collect()} for d in (df, out))
    assert after[2] < before[2] / 3 and len(before) == 2


def test_stacked_labels_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for frame in range(40):
        for name in range(rng.randrange(1, 11)):
            x = rng.uniform(0, 300)
            rows.append((frame, name, x, x + rng.uniform(30, 120), float(rng.choice([100, 110, 120, 134, 150, 180]))))
    want = {}
    for frame in range(40):
        taken = []
        for _, name, x1, x2, y in sorted([r for r in rows if r[0] == frame], key=lambda r: (r[4], r[1])):
            row = 0
            while any(abs(y + row * 34 - t[2]) < 34 and not (x2 < t[0] or x1 > t[1]) for t in taken):
                row += 1
            want[frame, name] = row
            taken.append((x1, x2, y + row * 34))
    got = layout.stacked(spark.createDataFrame(rows, "frame long, name long, x1 double, x2 double, y2 double"), ["frame"], "name").collect()
    assert {(r.frame, r.name): r.row for r in got} == want
    assert all(r.label_y == r.y2 + 34 * r.row for r in got) and max(want.values()) > 2


def test_cover_gives_way_to_sharper_frames(spark):
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(2, 12)
        reach = {i: {i} for i in range(n)}
        for _ in range(rng.randrange(3 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            reach[a].add(b)
            reach[b].add(a)
        sharp = {i: float(rng.randrange(6)) for i in range(n)}
        chosen = assign.greedy_cover(reach, 4)
        want = sorted({max([k for k in sorted(reach[c]) if reach[k] >= reach[c]] or [c], key=lambda k: sharp[k]) for c in chosen})
        got = assign.refined_cover({k: sum(1 << m for m in v) for k, v in reach.items()}, sharp, 4, {k: k for k in reach})
        assert [g[0] for g in got] == want and all(g[2] == len(reach[g[0]]) for g in got)
    edges = spark.createDataFrame([(1, 10, 20), (1, 10, 30), (1, 20, 30), (1, 40, 50), (1, 40, 99)], "clip int, key long, member long")
    sharp = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0), (1, 30, 2.0), (1, 40, 1.0), (1, 50, 1.0), (2, 7, 5.0)], "clip int, key long, sharp double")
    assert sorted(map(tuple, assign.refined_covers(edges, sharp, "clip", 5).collect())) == [(1, 20, 10, 3), (1, 40, 40, 2), (2, 7, 7, 1)]


def five_a_side(spark, frames=30):
    people = [(t, f"{t}", "east" if t < 5 else "west", f"player {t}") for t in range(10)]
    tracks = spark.createDataFrame([(1, f, t) for f in range(frames) for t in range(10)], "clip int, frame int, tid long")
    identities = spark.createDataFrame([(1, t, c, n, name, None) for t, n, c, name in people], "clip int, tid long, club string, number string, name string, ignored string")
    labels = spark.createDataFrame([(1, f, t, c, n) for f in range(frames) for t, n, c, _ in people], "clip int, frame int, tid long, club string, number string")
    return tracks, identities, labels


def test_a_clean_clip_is_ready(spark):
    r = reports.clip_report(*five_a_side(spark)).collect()[0]
    assert (r.verdict, r.players, r.club_sizes, r.mean_labels, r.full_share, r.doubles, r.clashes, r.lowest, r.gates) == ("ready", 10, [5, 5], 10.0, 1.0, 0, 0, 10, [])


def test_each_check_fails_by_itself(spark):
    tracks, identities, labels = five_a_side(spark, 40)

    def failed(t=tracks, i=identities, lab=labels):
        out = reports.clip_report(t, i, lab, fps=20.0)
        row = reports.failed_checks(reports.checks(out)).collect()[0]
        assert row.total == 4 and row.passed == 4 - len(row.notes)
        return row.notes, out.collect()[0]

    notes, row = failed(lab=labels.where("not (frame < 3 and tid = 4)"))
    assert notes == ["1: labels in every frame - 3 of 40 frames short"] and row.short_frames == 3 and row.lowest == 9
    notes, row = failed(i=identities.withColumn("ignored", F.when(F.col("tid") == 9, "mixed-kit")))
    assert notes == ["1: five a side - 4, 5"] and row.gates == ["mixed-kit 1"]
    again = spark.createDataFrame([(1, 11, "east", "3", "player 3", None)], identities.schema)
    late = tracks.unionByName(spark.createDataFrame([(1, f, 11) for f in range(30, 40)], tracks.schema))
    notes, row = failed(t=late, i=identities.unionByName(again))
    assert notes == [] and row.clashes == 0  # ten frames together are half a second, no more
    notes, row = failed(t=tracks.unionByName(spark.createDataFrame([(1, f, 11) for f in range(29, 40)], tracks.schema)), i=identities.unionByName(again))
    assert notes == ["1: no shared identity - 1 pairs"] and row.players == 10
    notes, _ = failed(lab=labels.unionByName(spark.createDataFrame([(1, 5, 11, "east", "3")], labels.schema)))
    assert notes == ["1: no player drawn twice - 1 frames"]


def test_frames_without_labels_and_clips_without_names_count(spark):
    tracks, identities, labels = five_a_side(spark, 4)
    row = reports.clip_report(tracks, identities.where("false"), labels.where("frame = 0")).collect()[0]
    assert (row.frames, row.mean_labels, row.lowest, row.players, row.tracks, row.club_sizes, row.verdict) == (4, 2.5, 0, 0, 0, [], "not ready")


def test_routes_count_their_own_runs(spark):
    rep = spark.createDataFrame([("a_fused", 0.9, 0.5), ("a", 0.95, 0.4), ("b", 0.0, 0.1), ("c", None, None)], "stem string, precision double, coverage double")
    done = [("out/a_tracks.json", 60.0), ("out/a_report.json", 30.0), ("out/a_fused_ident.json", 12.0), ("out/other.mp4", 999.0), ("x/b_oncourt_tracks.json", 600.0), (None, 5.0)]
    videos = spark.createDataFrame([("a", "v1"), ("a_fused", "v1"), ("b", "v2")], "stem string, video string")
    got = {r.stem: (r.video, r.minutes, r.best) for r in reports.routes(rep, spark.createDataFrame(done, "artifact string, elapsed double"), videos).collect()}
    assert got == {"a": ("v1", 1.5, True), "a_fused": ("v1", 0.2, False), "b": ("v2", None, False), "c": (None, None, False)}


def test_identities_do_not_overrule_people(spark):
    players = spark.createDataFrame([(1, 1, "9", "Old", "human", "home"), (1, 2, "9", "Old", None, "home"), (1, 3, "9", "Old", "ocr", "away"), (1, 4, "9", "Old", "ignored", "home"), (1, 5, "9", "Old", None, "home"), (1, 6, "9", "Old", None, "home")], "clip int, tid long, number string, name string, identity string, side string")
    found = spark.createDataFrame([(1, 1, "4", "A", "east"), (1, 2, "4", "A", "east"), (1, 3, "77", None, None), (1, 4, "4", "A", "east"), (1, 5, None, None, "east")], "clip int, tid long, number string, name string, club string")
    sides = spark.createDataFrame([(1, "east", "away"), (1, "west", "home")], "clip int, club string, side string")
    got = {r.tid: tuple(r)[2:] for r in runs.applied_identities(players, found, sides).collect()}
    old = ("9", "Old")
    assert got == {1: (*old, "human", "home", False), 2: ("4", "A", "jersey-ocr", "away", True), 3: ("77", None, "jersey-ocr", "away", False), 4: (*old, "ignored", "home", False), 5: (*old, None, "home", False), 6: (*old, None, "home", False)}


def test_nearest_with_an_offset_and_fill_that_clears(spark):
    q = spark.createDataFrame([("k", 10, 1), ("k", 30, 2)], "k string, t long, q long")
    p = spark.createDataFrame([("k", 112, 7), ("k", 125, 8)], "k string, t long, p long")
    got = {r.q: (r.t, r.near_p, r.distance) for r in timejoin.nearest(q, p, ["k"], "t", "q", "p", 6, later_wins=False, offset=100).collect()}
    assert got == {1: (10, 7, 2), 2: (30, 8, 5)}
    rows = spark.createDataFrame([("k", 0, "a"), ("k", 3, "b")], "k string, t long, v string")
    fill = lambda **o: [r.v for r in timejoin.forward_filled(rows, ["k"], "t", ["v"], **o).orderBy("t").collect()]
    assert fill() == ["a", "a", "a", "b"] and fill(every=1) == ["a", None, None, "b"] and fill(every=3) == ["a", "a", "a", "b"]


@pytest.mark.parametrize(
    "expression, want",
    [
        (lambda s: names.padded_clock(s), ["00:05", "01:22", "61:01", "00:59"]),
        (lambda s: names.padded_clock(s, rounded=True), ["00:05", "01:23", "61:01", "00:60"]),
        (lambda s: names.tenths_clock(s), ["0:05.0", "1:22.6", "61:01.0", "0:59.5"]),
        (lambda s: names.eta_text(s), ["5s", "83s", "61m", "60s"]),
        (lambda s: names.stamp(s), ["1970-01-01 00:00:05", "1970-01-01 00:01:22", "1970-01-01 01:01:01", "1970-01-01 00:00:59"]),
        (lambda s: names.iso(s), ["1970-01-01T00:00:05.000Z", "1970-01-01T00:01:22.600Z", "1970-01-01T01:01:01.000Z", "1970-01-01T00:00:59.500Z"]),
    ],
)
def test_clock_formats(spark, expression, want):
    rows = spark.createDataFrame([(0, 5.0), (1, 82.6), (2, 3661.0), (3, 59.5)], "i int, s double")
    assert [r.v for r in rows.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()] == want


def test_eta_of_the_unknown_and_of_hours(spark):
    rows = spark.createDataFrame([(0, None), (1, float("nan")), (2, -1.0), (3, 5400.0), (4, 9000.0)], "i int, s double")
    assert [r.v for r in rows.select("i", names.eta_text(F.col("s")).alias("v")).orderBy("i").collect()] == ["-", "-", "-", "1.5h", "2.5h"]


def test_counts_and_maps(spark):
    row = spark.createDataFrame([(["b", "a", "b", "c", "a", "d"], {"x": "1", "y": "2", "z": "1"})], "v array<string>, m map<string,string>")
    got = row.select(names.top_counts(F.col("v"), 2).alias("t"), names.inverted(F.col("m")).alias("m")).first()
    assert [tuple(t) for t in got.t] == [("b", 2), ("a", 2)] and got.m == {"1": "z", "2": "y"}


def test_backups_provenance_and_caches(spark, tmp_path):
    path, backup = str(tmp_path / "t"), str(tmp_path / "b")
    spark.createDataFrame([(1, "film")], "i int, source string").write.parquet(path)
    assert sidecars.backup_once(spark, path, backup)
    spark.createDataFrame([(2, "new")], "i int, source string").write.mode("overwrite").parquet(path)
    assert not sidecars.backup_once(spark, path, backup) and spark.read.parquet(backup).first()["i"] == 1
    once = spark.read.parquet(backup).select(sidecars.with_provenance(F.col("source"), "cleaned").alias("source"))
    assert once.select(sidecars.with_provenance(F.col("source"), "cleaned").alias("s")).first()["s"] == "film · cleaned" == once.first()["source"]
    cache = str(tmp_path / "vectors")
    assert sidecars.cached_vectors(spark, cache) is None
    spark.createDataFrame([(0, 1, [0.5], ["red", "blue"])], "frame long, det int, vector array<float>, words array<string>").write.parquet(cache)
    assert sidecars.cached_vectors(spark, cache).count() == 1 and sidecars.cached_vectors(spark, cache, ["red", "blue"]).count() == 1
    assert sidecars.cached_vectors(spark, cache, ["blue", "red"]) is None
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "seg19_fused_tracks.json").write_text('{"video": "seg_01m10.87s_19s.mp4", "fps": 60, "frames": {}}')
    assert [tuple(r) for r in sidecars.sidecar_videos(spark, str(tmp_path / "out")).collect()] == [("seg19_fused", "seg_01m10.87s_19s.mp4")]


def test_no_task_sorts_a_whole_track_to_find_its_runs(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 8)
    rng = random.Random(4)
    frames = sorted({f for a in range(-60, 200, 20) for f in range(a, a + rng.randrange(1, 20))} | set(range(60, 110)) | {207, 208, 300})
    rows = [(t, 3, f, float(f), 1.0) for t in (1, 2) for f in frames]
    out = paths.with_runs(spark.createDataFrame(rows, PATHS).repartition(4), ["clip", "tid"], "frame")
    want, run = {}, 0
    for before, f in zip([None, *frames], frames):
        run += before is None or f - before > 1
        want[f] = run
    got = out.collect()
    assert len(got) == len(rows) and {(r.clip, r._run) for r in got} == {(c, r) for c in (1, 2) for r in {x._run for x in got if x.clip == c}}
    for c in (1, 2):
        mine = {r.frame: r._run for r in got if r.clip == c}
        assert len({(want[f], r) for f, r in mine.items()}) == len(set(want.values())) == len(set(mine.values()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and "row_number() windowspecdefinition(clip#" in plan  # by clip, track and block
