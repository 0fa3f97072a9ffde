"""Stateful operators: batch against plain rules and brute force, stream against batch, and a sink that survives a restart."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from trackweave.streaming import heartbeat, pictures, shots, stitching

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIRST = int(START.timestamp() * 1_000_000)


def streamed(spark, tmp_path, rows, schema, cuts, operator, name):
    """Rows of ``operator`` over a stream that brings ``rows`` in parts cut at the given places; the stream starts anew for each."""
    places = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(places, places[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = operator(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def brute_stitch(tracks, boxes, overlap, reach):
    """Best one-to-one pairing by overlap over all permutations, then by distance over what is left."""
    from trackweave.operators.assign import iou_matrix

    def best(weight, bigger):
        n, m = weight.shape
        size = max(n, m)
        w = np.zeros((size, size))
        w[:n, :m] = weight
        return bigger(itertools.permutations(range(size)), key=lambda p: sum(w[i, p[i]] for i in range(size)))

    over = iou_matrix(tracks, boxes)
    total = sum(over[i, j] for i, j in enumerate(best(over, max)) if i < len(tracks) and j < len(boxes))
    out = stitching.stitched(tracks, boxes, overlap, reach)
    kept = sum(over[i, j] for j, i in enumerate(out) if i is not None and over[i, j] >= overlap)
    return total, kept, out


def test_stitch_is_best_by_overlap_then_by_distance():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        make = lambda k: (lambda p: np.c_[p, p + rng.uniform(20, 60, (k, 2))])(rng.uniform(0, 150, (k, 2)))
        tracks, boxes = make(n), make(m)
        total, kept, out = brute_stitch(tracks, boxes, 0.0, -1.0)
        assert abs(total - kept) < 1e-9 and len({i for i in out if i is not None}) == sum(i is not None for i in out)
        by_distance = stitching.stitched(tracks, boxes, 2.0, 1e9)  # no overlap is enough
        middle = lambda b: (b[:2] + b[2:]) / 2
        far = lambda pairs: sum(np.linalg.norm(middle(tracks[i]) - middle(boxes[j])) for j, i in pairs)
        got = [(j, i) for j, i in enumerate(by_distance) if i is not None]
        assert len(got) == min(n, m)
        few, many = (range(n), range(m)) if n <= m else (range(m), range(n))
        want = min(far([(j, i) if n <= m else (i, j) for i, j in zip(few, p)]) for p in itertools.permutations(many, len(few)))
        assert abs(far(got) - want) < 1e-6


def test_two_tracks_on_one_player_part_again():
    tracks = np.array([[100, 0, 140, 100], [104, 0, 144, 100]], float)
    boxes = np.array([[102, 0, 142, 100], [300, 0, 340, 100]], float)
    assert sorted(stitching.stitched(tracks, boxes)) == [0, 1]
    assert sorted(stitching.stitched(tracks, boxes, reach=50.0), key=str) in ([0, None], [1, None])


SEED_SCHEMA = "clip long, frame long, box long, x1 double, y1 double, x2 double, y2 double, held long"


def seeds():
    """Clips of players who wander, vanish and jump; every fifth frame is a fresh seed, others are carried or missing."""
    rng = random.Random(4)
    rows = []
    for clip in (1, 2, 3):
        where = [[100.0 * k, 50.0] for k in range(5)]
        for frame in range(60):
            for p in where:
                p[0] += rng.uniform(-15, 15)
                p[1] += rng.uniform(-5, 5)
                if rng.random() < 0.02:
                    p[0] += rng.choice([200, 900])
            if frame % 5 == 0:
                here = [p for p in where if rng.random() < 0.85]
                rows += [(clip, frame, i, x, y, x + 40, y + 100, None) for i, (x, y) in enumerate(here)]
    return sorted(rows, key=lambda r: (r[1], r[0], r[2]))


def test_seeds_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = seeds()
    want = sorted(map(tuple, stitching.reseeded(spark.createDataFrame(rows, SEED_SCHEMA)).collect()), key=repr)
    cuts = [next(i for i, r in enumerate(rows) if r[1] == f) for f in (15, 40)]
    assert streamed(spark, tmp_path, rows, SEED_SCHEMA, cuts, stitching.reseeded_stream, "seeds") == want
    assert {r[-1] for r in want} == {"born", "kept", "lost"}
    born, lost = [r[7] for r in want if r[0] == 1 and r[-1] == "born"], [r[7] for r in want if r[0] == 1 and r[-1] == "lost"]
    assert sorted(born) == list(range(1, len(born) + 1)) and set(lost) <= set(born) and len(set(lost)) == len(lost)


def test_held_boxes_say_where_tracks_are(spark):
    box = lambda x: (x, 0.0, x + 40.0, 100.0)
    rows = [(1, 0, 0, *box(0.0), None), (1, 0, 1, *box(500.0), None), (1, 1, 0, *box(250.0), 1), (1, 1, 1, *box(700.0), 2), (1, 2, 0, *box(705.0), None), (1, 2, 1, *box(255.0), None), (1, 3, 0, *box(5000.0), None)]
    got = [(r.frame, r.box, r.tid, r.event) for r in stitching.reseeded(spark.createDataFrame(rows, SEED_SCHEMA)).orderBy("frame", "box", "tid").collect()]
    assert got == [(0, 0, 1, "born"), (0, 1, 2, "born"), (1, 0, 1, "held"), (1, 1, 2, "held"), (2, 0, 2, "kept"), (2, 1, 1, "kept"), (3, None, 1, "lost"), (3, None, 2, "lost"), (3, 0, 3, "born")]


PICTURES = "clip long, frame long, vector array<double>"


def plain_changes(vectors, cells, limit, hold):
    prev, pending, out = None, None, []
    for i, v in enumerate(vectors):
        if pending is not None:
            if pictures._alike(pending[1], v, cells) >= limit:
                out.append((pending[0], "flash"))
                pending = None
            elif i - pending[0] >= hold:
                out.append((pending[0], "cut"))
                pending = None
        elif prev is not None and pictures._alike(prev, v, cells) < limit:
            pending = (i, prev)
        prev = v
    return out + ([(pending[0], "cut")] if pending else [])


def films():
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for clip in (1, 2, 3):
        scene, vectors = rng.random(24), []
        for f in range(80):
            if rng.random() < 0.08:
                scene = rng.random(24)
            white = rng.random() < 0.1
            vectors.append((rng.random(24) if white else scene + rng.normal(0, 0.05, 24)).tolist())
        vectors[-2] = rng.random(24).tolist()  # something is open at the end
        rows += [(clip, f, v) for f, v in enumerate(vectors)]
        want |= {(clip, f): k for f, k in plain_changes(vectors, 4, 0.55, 5)}
    return sorted(rows, key=lambda r: r[1]), want


def test_changes_of_pictures_equal_a_plain_loop(spark, tmp_path):
    rows, want = films()
    df = spark.createDataFrame(rows, PICTURES)
    assert {(r.clip, r.frame): r.kind for r in pictures.picture_changes(df, cells=4).collect()} == want
    assert set(want.values()) == {"cut", "flash"}
    ended = [*rows, *[(c, 10_000, None) for c in (1, 2, 3)]]
    got = streamed(spark, tmp_path, ended, PICTURES, [90, 100, 171], lambda s: pictures.picture_changes_stream(s, cells=4), "films")
    assert {(c, f): k for c, f, k in got} == want and len(got) == len(want)


def test_even_pictures_are_alike_and_short_clips_have_no_change(spark):
    assert pictures._alike(np.ones(8), np.ones(8) * 3, 4) == 1.0
    rows = [(1, 0, [1.0] * 8), (1, 1, [2.0] * 8), (2, 0, [0.0, 1.0] * 4), (3, 0, None)]
    assert pictures.picture_changes(spark.createDataFrame(rows, PICTURES), cells=4).count() == 0
    flip = spark.createDataFrame([(1, 0, [0.0, 1.0] * 4), (1, 1, [1.0, 0.0] * 4)], PICTURES)
    assert [tuple(r) for r in pictures.picture_changes(flip, cells=4).collect()] == [(1, 1, "cut")]


FLAGS = "clip long, at timestamp, jump boolean, layup boolean, basket boolean"


def plain_shots(rows, end):
    """Every clip by a plain loop; times in milliseconds."""
    out = []
    for clip in sorted({r[0] for r in rows}):
        opened, started, made = None, -9000, -9000
        for _, t, jump, layup, basket in [r for r in rows if r[0] == clip]:
            if opened and t >= opened[0] + 1700:
                out.append((clip, opened[0] + 1700, "missed", opened[1]))
                opened = None
            if basket and opened:
                out.append((clip, t, "made", opened[1]))
                opened, made = None, t
            elif (jump or layup) and not opened and t - started >= 500 and t - made >= 500:
                opened, started = (t, "jump" if jump else "layup"), t
                out.append((clip, t, "start", opened[1]))
        if opened and end >= opened[0] + 1700:
            out.append((clip, opened[0] + 1700, "missed", opened[1]))
    return out


def test_shots_of_batch_and_stream_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(11)
    plain = [(c, t * 100, rng.random() < 0.08, rng.random() < 0.05, rng.random() < 0.1) for t in range(0, 400) for c in (1, 2) if c == 1 or t < 150]
    plain.append((2, 14_950, True, False, False))
    plain.sort(key=lambda r: (r[1], r[0]))
    rows = [(c, START + timedelta(milliseconds=t), j, y, b if b else None) for c, t, j, y, b in plain]
    want = sorted((c, FIRST + t * 1000, e, k) for c, t, e, k in plain_shots(plain, plain[-1][1]))
    df = spark.createDataFrame(rows, FLAGS)
    assert sorted(map(tuple, shots.shots(df).collect())) == want
    assert {w[2] for w in want} == {"start", "made", "missed"}
    got = streamed(spark, tmp_path, rows, FLAGS, [120, 300], shots.shots_stream, "shots")
    assert sorted(got) == want


def test_a_shot_times_out_and_a_make_cools_down(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), True, False, False), (1, at(1.0), True, True, False), (1, at(1.7), False, False, True), (1, at(2.0), False, True, False), (1, at(2.1), False, False, True), (1, at(2.5), True, False, False), (1, at(2.6), True, False, False)]
    got = sorted(((r.us - FIRST) / 1e6, r.event, r.kind) for r in shots.shots(spark.createDataFrame(rows, FLAGS)).collect())
    assert got == [(0.0, "start", "jump"), (1.7, "missed", "jump"), (2.0, "start", "layup"), (2.1, "made", "layup"), (2.6, "start", "jump")]


UPDATES = "job string, at timestamp, state string, done long, total long"


def jobs():
    rng = random.Random(5)
    rows = []
    for j, (begin, steps, end) in {"a": (0, 300, "done"), "b": (10, 40, None), "c": (20, 60, "failed"), "d": (0, 1, None), "e": (2500, 10, None)}.items():
        t = float(begin)
        for i in range(steps):
            t += rng.choice([0.2, 0.4, 3.0, 120.0 if rng.random() < 0.1 else 0.3])
            rows.append((j, t, "running", i, steps if rng.random() < 0.5 else None))
        if end:
            rows.append((j, t + 0.1, end, steps, steps))
            rows.append((j, t + 5, "running", 0, 0))
    rows.append(("z", 6000.0, "running", 1, 1))
    return [(j, START + timedelta(milliseconds=round(t * 1000)), s, d, n) for j, t, s, d, n in sorted(rows, key=lambda r: r[1])]


def test_pulses_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = jobs()
    want = sorted(map(tuple, heartbeat.pulses(spark.createDataFrame(rows, UPDATES)).collect()), key=repr)
    assert streamed(spark, tmp_path, rows, UPDATES, [90, 250], heartbeat.pulses_stream, "pulses") == want
    by_kind = {}
    for job, us, kind, _, _ in want:
        by_kind.setdefault(kind, []).append((job, us))
    assert {"beat", "quiet", "stale", "done", "failed"} == set(by_kind)
    assert {j for j, _ in by_kind["stale"]} >= {"b", "d", "e"} and not {"a", "c"} & {j for j, _ in by_kind["stale"]}
    for job in "abcde":  # no two beats within a second
        beats = sorted(us for j, us in by_kind["beat"] if j == job)
        assert all(b - a >= 1_000_000 for a, b in zip(beats, beats[1:]))
    # Every timer stands 90 or 1800 seconds after an update that no other follows in time.
    seen = {(r[0], int(r[1].timestamp() * 1e6)) for r in rows}
    assert all((j, us - 90_000_000) in seen for j, us in by_kind["quiet"]) and all((j, us - 1_800_000_000) in seen for j, us in by_kind["stale"])


def test_upserts_resume_from_their_checkpoint(spark, tmp_path):
    rows = jobs()
    path, keys, order = str(tmp_path / "table"), ["job"], ["us"]
    parts = [rows[:80], rows[80:200], rows[200:260], rows[260:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, UPDATES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        source = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = heartbeat.pulses_stream(source).writeStream.foreachBatch(heartbeat.upserts(path, keys, order, compact_every=3)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    all_rows = heartbeat.pulses(spark.createDataFrame(rows, UPDATES))
    want = {r.job: r.us for r in all_rows.groupBy("job").agg({"us": "max"}).withColumnRenamed("max(us)", "us").collect()}
    assert {r.job: r.us for r in heartbeat.current(spark, path, keys, order).collect()} == want


def test_a_batch_written_twice_or_left_unfinished_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    write = heartbeat.upserts(path, ["k"], ["at"], compact_every=3)
    assert heartbeat.current(spark, path, ["k"], ["at"]) is None
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    table = lambda: sorted(tuple(r) for r in heartbeat.current(spark, path, ["k"], ["at"]).collect())
    batches = [[(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], [(2, 5, "y")], [(1, 1, "late"), (3, 1, "n")], [(3, 2, "m")], [(1, 9, "c")], [(2, 6, "z")], [(4, 1, "q")], [(4, 2, "r")], [(5, 1, "s")]]
    for n, rows in enumerate(batches):
        write(frame(rows), n)
        before = table()
        write(frame(rows), n)  # the driver died after the write and before the commit
        assert table() == before
    assert table() == [(1, 9, "c"), (2, 6, "z"), (3, 2, "m"), (4, 2, "r"), (5, 1, "s")]
    frame([(1, 99, "half")]).write.parquet(f"{path}/batch-000000000009")
    (tmp_path / "table" / "batch-000000000009" / "_SUCCESS").unlink()
    assert (1, 9, "c") in table()
    left = sorted(p.name for p in (tmp_path / "table").iterdir())
    assert "base-000000000008" in left and "base-000000000002" not in left and "batch-000000000000" not in left


@pytest.mark.parametrize("operator, schema", [(stitching.reseeded, SEED_SCHEMA), (shots.shots, FLAGS), (heartbeat.pulses, UPDATES), (lambda d: pictures.picture_changes(d, cells=4), PICTURES)])
def test_empty_tables(spark, operator, schema):
    assert operator(spark.createDataFrame([], schema)).count() == 0


def test_seeds_without_a_choice_and_with_one_take_what_the_assignment_takes(monkeypatch):
    from trackweave.operators.assign import best_assignment, iou_matrix

    rng = np.random.default_rng(8)
    asked = []
    monkeypatch.setattr(stitching, "best_assignment", lambda w: asked.append(w.shape) or best_assignment(w))
    for k in range(300):
        at = rng.uniform(0, 4000 if k % 2 else 150, (6, 2))
        tracks, boxes = np.c_[at, at + 100], np.c_[at, at + 100][rng.permutation(6)[: k % 6 + 1]] + rng.integers(-60, 60)
        over = iou_matrix(tracks, boxes)
        want = {j: i for i, j in best_assignment(over) if over[i, j] >= 0.2}
        got = stitching.stitched(tracks, boxes, reach=0.0)
        assert got == [want.get(j) for j in range(len(boxes))]
    assert sum(s[0] > 1 for s in asked) < 500, "frames without a choice need no assignment"


def test_single_rows_take_their_greatest_weight():
    from trackweave.operators.assign import best_assignment

    assert best_assignment(np.array([[1.0, 3.0, 3.0]])) == [(0, 1)] and best_assignment(np.array([[1.0], [3.0]])) == [(1, 0)]
    assert best_assignment(np.empty((1, 0))) == [] and best_assignment(np.empty((0, 0))) == []


def test_small_tables_are_assigned_as_large_ones(monkeypatch):
    from trackweave.operators import assign

    rng = np.random.default_rng(10)
    tables = [np.round(rng.uniform(-3, 3, rng.integers(1, 9, 2)), rng.integers(0, 4)) for _ in range(300)]
    small = [assign.best_assignment(w) for w in tables]
    monkeypatch.setattr(assign, "SMALL", -1)
    assert small == [assign.best_assignment(w) for w in tables]


def test_few_and_many_boxes_overlap_alike(monkeypatch):
    rng = np.random.default_rng(11)
    for _ in range(100):
        a, b = (np.c_[p, p + rng.integers(0, 9, p.shape)].astype(float) for p in (rng.integers(0, 20, (6, 2)), rng.integers(0, 20, (7, 2))))
        few = stitching._overlaps(a, b)
        with monkeypatch.context() as m:
            m.setattr(stitching, "SMALL", 0)
            assert few == stitching._overlaps(a, b)
