"""Scoring and grading of identities: precision, coverage, culprits, reports, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.fusion import one_per_frame
from trackweave.operators.spans import first_covering, outside

PLAYERS = 10


def drawn(tracks: DataFrame, identities: DataFrame, collapse: DataFrame) -> DataFrame:
    """The labels a viewer sees: numbered, not ignored, outside collapse spans, one per player and frame (the largest box)."""
    named = identities.where("number is not null and ignored is null").select("clip", "tid", "number", "club", F.coalesce("merged_into", "tid").alias("player"))
    rows = outside(tracks.join(named, ["clip", "tid"]), collapse, ["clip", "tid"], "frame")
    sized = rows.withColumn("_size", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return one_per_frame(sized, ["clip", "frame"], "player", "_size", "tid").drop("_size")


def judged(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """``verdict`` of each label against the first truth segment that covers it.

    No segment or an unknown player without a club: unknown. An unknown player of a known
    club convicts a label of the other club. Number and club (where the truth has one)
    must both agree.
    """
    hit = first_covering(labels, truth, ["clip", "tid"], ["clip", "frame", "tid"], "frame", "seg_ix", ["number", "club"])
    same_club = F.col("hit_club").isNull() | (F.col("hit_club") == F.col("club"))
    verdict = (
        F.when(F.col("hit_number").isNull(), "unknown")
        .when((F.col("hit_number") == "?") & same_club, "unknown")
        .when((F.col("hit_number") == F.col("number")) & same_club, "right")
        .otherwise("wrong")
    )
    return hit.withColumn("verdict", verdict)


def score(verdicts: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row a clip: right, wrong, unknown, precision (NaN if nothing was judged) and coverage of ten players in every frame."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    per_frame = verdicts.where("verdict = 'right'").groupBy("clip", "frame").agg(F.count_distinct("number", F.coalesce("club", F.lit(""))).alias("n"))
    found = per_frame.groupBy("clip").agg(F.sum("n").alias("found"))
    totals = verdicts.groupBy("clip").agg(count("right").alias("n_right"), count("wrong").alias("n_wrong"), count("unknown").alias("n_unknown"))
    frames = tracks.groupBy("clip").agg(F.count_distinct("frame").alias("n_frames"))
    out = frames.join(totals, "clip", "left").join(found, "clip", "left").na.fill(0, ["n_right", "n_wrong", "n_unknown", "found"])
    judged_n = F.col("n_right") + F.col("n_wrong")
    return out.select("clip", "n_frames", "n_right", "n_wrong", "n_unknown", F.when(judged_n > 0, F.col("n_right") / judged_n).otherwise(F.lit(float("nan"))).alias("precision"), (F.col("found") / (F.col("n_frames") * PLAYERS)).alias("coverage"))


def culprits(verdicts: DataFrame) -> DataFrame:
    """Wrong labels by track, what was said and what was true."""
    return verdicts.where("verdict = 'wrong'").groupBy("clip", "tid", F.col("number").alias("said"), F.col("hit_number").alias("true_number")).agg(F.count("*").alias("frames"))


def frame_report(labels: DataFrame, spine: DataFrame, keys: list[str], at: str, need: int) -> DataFrame:
    """By key: steps of the spine, mean labels, share of steps with ``need`` or more, short steps; empty steps count as 0."""
    n = spine.join(labels.groupBy(*keys, at).agg(F.count("*").alias("n")), [*keys, at], "left").na.fill(0, ["n"])
    return n.groupBy(*keys).agg(F.count("*").alias("steps"), F.avg("n").alias("mean_labels"), F.avg((F.col("n") >= need).cast("double")).alias("share_full"), F.count_if(F.col("n") < need).alias("short_steps"), F.max("n").alias("most"))


def histogram(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys, value.alias("n")).agg(F.count("*").alias("rows"))


def threshold_sweep(rows: DataFrame, feature: str, good: Column, cuts: DataFrame) -> DataFrame:
    """For each cut (a few rows): rows kept, bad ones dropped, good ones lost when the feature must reach it.

    Rows are counted once by the number of cuts they reach; the cuts then add these counts up.
    """
    values = [r["cut"] for r in cuts.orderBy("cut").collect()]
    reached = sum((F.when(F.col(feature) >= c, 1).otherwise(0) for c in values), F.lit(0))
    counts = rows.groupBy(reached.alias("reached")).agg(F.count("*").alias("n"), F.count_if(good).alias("g"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("cut")) for i, c in enumerate(values)]))
    joined = counts.select("*", cells.alias("c")).select("n", "g", "reached", "c.i", "c.cut")
    keep = F.col("reached") > F.col("i")
    return joined.groupBy("cut").agg(F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(~keep, F.col("n") - F.col("g")).otherwise(0)).alias("bad_dropped"), F.sum(F.when(~keep, F.col("g")).otherwise(0)).alias("good_lost"))


def feature_sweep(rows: DataFrame, features: dict[str, tuple[float, float]], good: Column, steps: int = 4) -> DataFrame:
    """feature, cut, kept, bad_dropped, good_lost: what a threshold on each feature would keep and cost, at ``steps`` even cuts of its range.

    A null feature reaches no cut; a row whose ``good`` is null is neither good nor bad. All cuts are counted in one pass
    without a row for each of them, and only their counts leave the tasks.
    """
    cuts = [(f, low + (high - low) * i / max(1, steps - 1)) for f, (low, high) in features.items() for i in range(steps)]
    reach = [F.coalesce(F.col(f) >= cut, F.lit(False)) for f, cut in cuts]
    counts = rows.agg(*[F.struct(F.count_if(r).alias("kept"), F.count_if(~r & ~good).alias("bad_dropped"), F.count_if(~r & good).alias("good_lost")).alias(f"c{i}") for i, r in enumerate(reach)])
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(float(cut)).alias("cut"), *[F.col(f"c{i}.{k}").alias(k) for k in ("kept", "bad_dropped", "good_lost")]) for i, (f, cut) in enumerate(cuts)]
    return counts.select(F.inline(F.array(*cells)))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Precision and recall, 0 where nothing was found or there was nothing to find."""
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)


def verdict_of(checks: DataFrame, keys: list[str]) -> DataFrame:
    """All checks of a clip passed; how many did."""
    return checks.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count("*").alias("checks"), F.bool_and("passed").alias("verdict"))
