from pyspark.sql import functions as F

from trackweave.sources import exports


def test_folder_skips_broken_files_and_reads_named_fields(spark, tmp_path):
    (tmp_path / "a_run.json").write_text('{"job": "x", "total": 4, "other": [1]}')
    (tmp_path / "b_run.json").write_text('{"job": "y"')
    (tmp_path / "c.txt").write_text("{}")
    rows = exports.folder(spark, str(tmp_path), "job string, total long", "*_run.json")
    assert [(r.job, r.total, r.file) for r in rows.collect()] == [("x", 4, "a_run.json")]


def test_clicks_and_annotations(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, []), (3, None)], "id int, points array<double>")
    assert [r.id for r in exports.clicked(rows).collect()] == [1]
    lines = spark.createDataFrame([("f.12",), ("f.x1",), ("g.3",), ("f.",), (None,)], "name string")
    assert [r.number for r in exports.annotations(lines, "name", "f.").collect()] == [12]


def test_coco_subset(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b")], "id int, file string")
    marks = spark.createDataFrame([(7, 1), (8, 2), (9, 1)], "ann int, image_id int")
    kept, left = exports.coco_subset(images, marks, spark.createDataFrame([(1,), (1,), (5,)], "id int"))
    assert [r.file for r in kept.collect()] == ["a"] and sorted(r.ann for r in left.collect()) == [7, 9]


def test_pose_line(spark):
    point = lambda x, y, seen: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(seen).alias("seen"))
    points = F.array(point(10.0, 50.0, True), point(60.0, 30.0, True), point(0.0, 0.0, False))
    row = spark.range(1).select(exports.pose_line(points, 100.0, 100.0).alias("line"), exports.pose_line(F.array(point(1.0, 1.0, False)), 100.0, 100.0).alias("none")).first()
    # x from 0 (clipped) to 80, y from 10 to 70
    assert row.line == "0 0.400000 0.400000 0.800000 0.600000 0.100000 0.500000 2 0.600000 0.300000 2 0.000000 0.000000 0"
    assert row.none is None
