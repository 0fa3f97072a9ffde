"""Tasks grow in number with the rows, not in what one holds."""

from pyspark.sql import functions as F

from trackweave.operators import measures
from trackweave.operators.tasks import ROWS_A_TASK, spread


def test_more_rows_more_tasks(spark):
    few = spark.range(10)
    assert spread(few, "id").rdd.getNumPartitions() == spread(few, "id", count=10).rdd.getNumPartitions() == 4
    assert spread(few, "id", count=9 * ROWS_A_TASK + 1).rdd.getNumPartitions() == 10


def test_segment_report_deals_frames_by_their_number(spark):
    spine = spark.range(40).select(F.expr("id div 20").alias("clip"), F.col("id").alias("frame"))
    labels = spark.range(200).select(F.expr("id % 30 div 20").alias("clip"), (F.col("id") % 30).alias("frame"), (F.col("id") % 4).alias("tid"), (F.col("id") % 3).alias("club"))
    plain = measures.segment_report(labels, spine, "clip", "frame", "tid", "club", full=4)
    many = measures.segment_report(labels, spine, "clip", "frame", "tid", "club", full=4, count=6 * ROWS_A_TASK)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, many.collect()))
    assert plain.agg(F.sum("frames"), F.sum("labels"), F.sum("short_frames")).first()[:] == (40, 200, 10)
    plan = many._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(clip#") and "REPARTITION_BY_NUM" in plan and ", 6)" in plan
