import pytest
from pyspark.sql import functions as F

from trackweave.functions import boxes, names
from trackweave.operators import runs, spans, votes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name, want", [("Ada Quill Jr.", "Quill Jr."), ("Otto van Dern IV", "Dern IV"), ("Mara Finch", "Finch"), ("Solo", "Solo"), ("Bo Reyes sr", "Reyes sr")])
def test_surname(spark, name, want):
    assert value(spark, names.surname(F.lit(name))) == want


@pytest.mark.parametrize("a, b, want", [("8", "48", True), ("4", "48", True), ("9", "48", False), ("3", "6", False), ("40", "41", False), ("48", "84", False), ("60", "60", True)])
def test_clipped_reading(spark, a, b, want):
    assert value(spark, names.clipped_reading(F.lit(a), F.lit(b))) is want


def test_text_functions(spark):
    assert value(spark, names.clock_seconds(F.lit("1:05"))) == 65.0
    assert value(spark, names.clock_seconds(F.lit("9.5"))) == 9.5
    assert value(spark, names.clock_text(F.lit(65.9))) == "1:05"
    assert value(spark, names.original_name(F.lit("shot_12_jpg.rf.abc123.jpg"))) == "shot_12"
    assert value(spark, names.stem(F.lit("a/b/clip.mp4"))) == "clip"
    assert value(spark, names.route(F.lit("out/x_oncourt_tracks.json"))) == "x_oncourt"
    assert value(spark, names.embedded_json(F.lit('so {"a": 1} there'))) == '{"a": 1}'
    assert value(spark, names.embedded_json(F.lit("so {a there}"))) is None
    key, val = names.assignment(F.lit(" 12 = 4=5 "))
    assert (value(spark, key), value(spark, val)) == ("12", "4=5")
    assert value(spark, names.play_kind(F.lit("Bad pass steal"), F.lit(True))) == "loss"
    assert value(spark, names.segment_name(F.lit(65.25), F.lit(12.4))) == "seg_01m05.25s_12s"


def test_matrices(spark):
    h = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 3, 2, 0, 0, 1)])
    eye = value(spark, boxes.product(h, boxes.inverse(h)))
    assert [round(x, 9) for x in eye] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    singular = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 2, 4, 6, 0, 0, 1)])
    assert value(spark, boxes.inverse(singular)) is None


@pytest.mark.parametrize("counts, decisive", [({"a": 11, "b": 10}, False), ({"a": 30, "b": 2}, True), ({"a": 2}, True), ({"a": 1}, False)])
def test_decisive(spark, counts, decisive):
    v = spark.createDataFrame([(1, k, n) for k, n in counts.items()], "tid int, value string, votes long")
    assert votes.leaders(v, ["tid"], "value").first().decisive is decisive


def test_span_edges(spark):
    rows = spark.createDataFrame([(7, f) for f in (0, 5, 10, 16, 40)], "tid int, frame int")
    got = sorted((r.start, r.end) for r in spans.islands(rows, ["tid"], "frame", 5).collect())
    assert got == [(0, 10), (16, 16), (40, 40)], "a gap of exactly the limit joins, one more does not"
    touching = spark.createDataFrame([(7, 100, 200), (7, 201, 260), (7, 262, 300), (7, 110, 120)], "tid int, start int, end int")
    assert sorted((r.start, r.end) for r in spans.coalesced(touching, ["tid"]).collect()) == [(100, 260), (262, 300)]
    span = spark.createDataFrame([(7, 100, 200)], "tid int, start int, end int")
    asked = spark.createDataFrame([(7, f) for f in (99, 100, 200, 201)] + [(8, 150)], "tid int, frame int")
    assert sorted(map(tuple, spans.outside(asked, span, ["tid"], "frame").collect())) == [(7, 99), (7, 201), (8, 150)]


def test_lifecycle_and_carry_over(spark):
    log = spark.createDataFrame([("a", 1, "running", 1, 4), ("a", 2, "failed", 2, 4), ("a", 3, "done", 9, 4), ("b", 1, "running", 1, 0)], "run string, seq int, state string, done int, total int")
    got = {r.run: (r.state, r.position) for r in runs.lifecycle(log).collect()}
    assert got == {"a": ("failed", 1.0), "b": ("running", None)}
    new = spark.createDataFrame([(1, "P1"), (2, "P2")], "id int, name string")
    old = spark.createDataFrame([(1, "Ann")], "id int, name string")
    assert sorted(map(tuple, runs.carried_over(new, old, ["id"], ["name"]).collect())) == [(1, "Ann"), (2, "P2")]


def test_decimals_are_rounded_by_a_double_s_exact_value(spark):
    import random

    rng = random.Random(5)
    hours = [3.55, 1.65, 2.25, 1.75, 0.05, 123456.85, *(rng.randrange(150, 9999) / 100 for _ in range(300))]
    seconds = [x * 3600 for x in hours] + [12780.0, 0.5, 1.5, 88.5, 89.5, 150.0, 210.0, 5399.0, 2.5 * 60 * 3, 1e17, float("inf")]
    rows = spark.createDataFrame(list(enumerate(seconds)), "i int, s double").select("i", names.eta_text(F.col("s")).alias("e"), names.tenths_clock(F.when(F.col("s") < 1e9, F.col("s"))).alias("t")).orderBy("i").collect()
    eta = lambda s: f"{s:.0f}s" if s < 90 else f"{s / 60:.0f}m" if s < 5400 else f"{s / 3600:.1f}h" if s < 1e99 else "Infinityh"
    assert [r.e for r in rows] == [eta(s) for s in seconds]
    assert [r.t for r in rows[:-2]] == [f"{int(s // 60)}:{s - s // 60 * 60:04.1f}" for s in seconds[:-2]]
