"""Scans of folders of run files, and label exports. Files that cannot be read as JSON give no rows; a pattern without files gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One row for each readable JSON document under ``path`` whose name fits, with its ``file`` name; only the schema's fields are read."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("_broken is null").drop("_broken")


def clicked(calibrations: DataFrame, points: str = "points") -> DataFrame:
    """Click calibrations with at least one point."""
    return calibrations.where(F.size(F.coalesce(F.col(points), F.array())) > 0)


def annotations(lines: DataFrame, column: str, prefix: str) -> DataFrame:
    """Annotation rows of a prefix whose name goes on with digits alone, with that ``number``."""
    found = F.regexp_extract(F.col(column), rf"^\Q{prefix}\E([0-9]+)$", 1)
    return lines.where(found != "").withColumn("number", found.cast("long"))


def coco_subset(images: DataFrame, annotated: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The images whose id is in ``keep`` (id), and their annotations (image_id)."""
    kept = images.join(keep.select("id").distinct(), "id", "left_semi")
    return kept, annotated.join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def pose_line(points: Column, width: float, height: float, margin: float = 20.0) -> Column:
    """A YOLO pose label of landmarks (array of x, y, seen): class 0, the box of the seen ones with a margin, clipped to the frame, then
    all points by share of the frame with visibility 2 or 0; null when none is seen."""
    seen = F.filter(points, lambda p: p["seen"])
    side = lambda c, size: (F.greatest(F.lit(0.0), F.array_min(F.transform(seen, lambda p: p[c])) - margin), F.least(F.lit(size), F.array_max(F.transform(seen, lambda p: p[c])) + margin))
    (x1, x2), (y1, y2) = side("x", width), side("y", height)
    number = lambda v: F.format_string("%.6f", v.cast("double"))
    box = F.concat_ws(" ", F.lit("0"), *map(number, ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)))
    one = lambda p: F.when(p["seen"], F.concat_ws(" ", number(p["x"] / width), number(p["y"] / height), F.lit("2"))).otherwise(F.lit("0.000000 0.000000 0"))
    return F.when(F.size(seen) > 0, F.concat_ws(" ", box, F.array_join(F.transform(points, one), " ")))
