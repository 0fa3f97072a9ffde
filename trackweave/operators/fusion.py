"""Joins of boxes and labels inside frames, and the fusion of two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.boxes import box, contains, over_first, over_smaller, over_union


def overlapping_in_frame(rows: DataFrame, keys: list[str], name: str, least: float = 0.75) -> DataFrame:
    """Pairs of boxes of one frame whose overlap covers ``least`` of the smaller; the frame is the join key."""
    a, b = rows.alias("a"), rows.alias("b")
    share = over_smaller(box("a"), box("b"))
    on = F.col(f"a.{name}") < F.col(f"b.{name}")
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return a.join(b, on & (share >= least)).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{name}").alias("first_name"), F.col(f"b.{name}").alias("second_name"), share.alias("share"))


def best_match(inner: DataFrame, outer: DataFrame, keys: list[str], inner_id: str, outer_id: str, least: float = 0.9, *, last_wins: bool = True) -> DataFrame:
    """Each inner box with the outer box of its frame that covers most of it; nothing under ``least``. Ties by ``outer_id``."""
    a, b = inner.alias("a"), outer.alias("b")
    share = over_first(box("a"), box("b"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{inner_id}").alias("inner_id"), F.col(f"b.{outer_id}").alias("outer_id"), share.alias("share")).where(F.col("share") >= least)
    tie = F.desc("outer_id") if last_wins else F.asc("outer_id")
    w = Window.partitionBy(*keys, "inner_id").orderBy(F.desc("share"), tie)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def adopted(detections: DataFrame, tracks: DataFrame, clip: list[str], frame: str, name: str, every: int, least: float = 0.4) -> DataFrame:
    """Detections with the track id they overlap most on the tracker's grid.

    A frame looks at its grid frame, or at the next one when that has no tracks. Best
    overlap above ``least``, ties to the smaller id; unmatched detections are left out.
    """
    have = tracks.select(*clip, F.col(frame).alias("_grid")).distinct()
    asked = detections.select(*clip, frame).distinct().withColumn("_low", F.col(frame) - F.col(frame) % every)
    at_low = have.withColumnRenamed("_grid", "_low").withColumn("_has", F.lit(True))
    asked = asked.join(at_low, [*clip, "_low"], "left").withColumn("_grid", F.when(F.col("_has"), F.col("_low")).otherwise(F.col("_low") + every)).drop("_low", "_has")
    a = detections.join(asked, [*clip, frame]).alias("a")
    b = tracks.withColumnRenamed(frame, "_grid").alias("b")
    on = F.col("a._grid") == F.col("b._grid")
    for k in clip:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    share = over_union(box("a"), box("b"))
    best = a.join(b, on).where(share > least).groupBy(*[F.col(f"a.{c}").alias(c) for c in detections.columns]).agg(F.max(F.struct(share.alias("share"), (-F.col(f"b.{name}")).alias("minus"))).alias("_m"))
    return best.select(*detections.columns, (-F.col("_m.minus")).alias(f"adopted_{name}"), F.col("_m.share").alias("share"))


def one_per_frame(rows: DataFrame, keys: list[str], identity: str, size: str, tie: str) -> DataFrame:
    """One row of each identity in each frame: the largest, ties to the smaller ``tie``."""
    w = Window.partitionBy(*keys, identity).orderBy(F.desc(size), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fused(first: DataFrame, second: DataFrame, keys: list[str], strength: str) -> DataFrame:
    """Labels of two passes by frame and identity: where both have one the stronger stays, ties to the first."""
    a, b = first.select(*keys, F.col(strength).alias("_a")), second.select(*keys, F.col(strength).alias("_b"))
    both = a.join(b, keys, "full_outer")
    source = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") >= F.col("_b"), "both_a").otherwise("both_b")
    return both.select(*keys, source.alias("source"), F.greatest("_a", "_b").alias(strength))


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """How many points of a frame lie in its box, for each row of ``boxes``; 0 where none does."""
    a, b = boxes.alias("a"), points.alias("b")
    on = contains(box("a"), F.col("b.x"), F.col("b.y"))
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return a.join(b, on, "left").groupBy(*[F.col(f"a.{c}").alias(c) for c in [*keys, *group]]).agg(F.count("b.x").alias("n_inside"))


def relabelled_overlaps(spans: DataFrame, counts: DataFrame, span_key: list[str], least: float = 2.0) -> DataFrame:
    """Collapse spans whose median count of bodies is ``least`` or more are occlusions; spans without samples stay."""
    middle = counts.groupBy(*span_key).agg(F.percentile("n_inside", F.lit(0.5)).alias("middle"))
    kind = F.when((F.col("kind") == "collapse") & (F.col("middle") >= least), "occlusion").otherwise(F.col("kind"))
    return spans.join(middle, span_key, "left").withColumn("kind", kind)


def cooccurring(rows: DataFrame, name: list[str], at: str, who: str) -> DataFrame:
    """Pairs of different rows under one name that share times, with how many."""
    seen = rows.select(*name, at, who).distinct()
    a, b = seen.alias("a"), seen.alias("b")
    on = F.col(f"a.{who}") < F.col(f"b.{who}")
    for k in [*name, at]:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in name], F.col(f"a.{who}").alias("first_name"), F.col(f"b.{who}").alias("second_name")).agg(F.count("*").alias("shared"))


def nearest_landmark(points: DataFrame, landmarks: DataFrame, *, sightings: int = 4, spread: float = 1.5, reach: float = 2.0) -> DataFrame:
    """Each steady point's nearest landmark within reach. ``landmarks`` is a court's fixed table (some dozens of rows)."""
    steady = points.where((F.col("sightings") >= sightings) & (F.col("spread") <= spread))
    d = F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))
    best = steady.join(F.broadcast(landmarks), d <= reach).groupBy("name").agg(F.min(F.struct(d.alias("d"), F.col("landmark").alias("l"))).alias("_m"))
    return best.select("name", F.col("_m.l").alias("landmark"), F.col("_m.d").alias("distance"))
