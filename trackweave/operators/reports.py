"""The report of a clip's identities with its checks, and the table of routes that reports are compared in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.names import route
from trackweave.operators.spans import lifetimes, overlapping_pairs

FULL = 10


def players(identities: DataFrame) -> DataFrame:
    """clip, club, number, tid of the tracks that carry a name and aren't ignored; a player may have several."""
    return identities.where("name is not null and ignored is null").select("clip", "club", "number", "tid")


def clashes(identities: DataFrame, tracks: DataFrame, fps: float = 59.94, least: float = 0.5) -> DataFrame:
    """clip, club, number, first_name, second_name, shared: pairs of a player's tracks whose lives share more than ``least`` seconds."""
    lives = players(identities).join(lifetimes(tracks, ["clip", "tid"], "frame"), ["clip", "tid"]).withColumn("club", F.coalesce("club", F.lit("?")))
    return overlapping_pairs(lives, ["clip", "club", "number"], "tid", fps * least, "first_at", "last_at")


def clip_report(tracks: DataFrame, identities: DataFrame, labels: DataFrame, *, fps: float = 59.94, full: int = FULL) -> DataFrame:
    """One row a clip. ``tracks``: clip, frame, tid; ``identities``: clip, tid, club, number, name, ignored; ``labels``: the
    drawn ones (clip, frame, tid, club, number).

    frames, seconds, tracks, players, club_sizes (players by club, sorted), mean_boxes, mean_labels, full_share, proxy (mean over
    ``full``), short_frames, lowest, doubles (frames times players drawn more than once), clashes, gates (ignored tracks by
    reason), five_a_side, and verdict: ready when the lineup is five a side, no frame is short, nobody is drawn twice and no
    player's tracks live together. Frames without a label count.
    """
    boxes = tracks.groupBy("clip", "frame").agg(F.count("*").alias("boxes"))
    drawn = labels.groupBy("clip", "frame", "club", "number").agg(F.count("*").alias("n")).groupBy("clip", "frame").agg(F.sum("n").alias("labels"), F.count_if(F.col("n") > 1).alias("twice"))
    per_frame = boxes.join(drawn, ["clip", "frame"], "left").na.fill(0, ["labels", "twice"])
    short = F.col("labels") < full
    out = per_frame.groupBy("clip").agg(
        F.count("*").alias("frames"), F.avg("boxes").alias("mean_boxes"), F.avg("labels").alias("mean_labels"), F.avg((~short).cast("int")).alias("full_share"),
        F.count_if(short).alias("short_frames"), F.min("labels").alias("lowest"), F.sum("twice").alias("doubles"),
    )
    sizes = players(identities).select("clip", "club", "number").distinct().groupBy("clip", "club").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("clip").agg(F.sum("n").alias("players"), F.sort_array(F.collect_list("n")).alias("club_sizes"))
    gates = identities.where("ignored is not null").groupBy("clip", "ignored").agg(F.count("*").alias("n")).groupBy("clip").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "ignored", "n"))).alias("gates"))
    known = identities.groupBy("clip").agg(F.count("*").alias("tracks"))
    met = clashes(identities, tracks, fps).groupBy("clip").agg(F.count("*").alias("clashes"))
    for side in (known, sizes, gates, met):  # one row a clip each
        out = out.join(side, "clip", "left")
    out = out.na.fill(0, ["tracks", "players", "clashes"])
    out = out.withColumn("club_sizes", F.coalesce("club_sizes", F.array().cast("array<bigint>"))).withColumn("gates", F.coalesce("gates", F.array().cast("array<string>")))
    out = out.withColumn("seconds", F.col("frames") / fps).withColumn("proxy", F.col("mean_labels") / full)
    out = out.withColumn("five_a_side", F.col("club_sizes") == F.array(F.lit(5).cast("bigint"), F.lit(5).cast("bigint")))
    ready = F.col("five_a_side") & (F.col("short_frames") == 0) & (F.col("doubles") == 0) & (F.col("clashes") == 0)
    return out.withColumn("verdict", F.when(ready, "ready").otherwise("not ready"))


def checks(reports: DataFrame, key: str = "clip") -> DataFrame:
    """key, ix, name, passed, detail: the four checks of each report (``clip_report``)."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rows = [
        ("five a side", F.col("five_a_side"), F.array_join("club_sizes", ", ")),
        ("labels in every frame", F.col("short_frames") == 0, text(F.col("short_frames").cast("string"), " of ", F.col("frames").cast("string"), " frames short")),
        ("no player drawn twice", F.col("doubles") == 0, text(F.col("doubles").cast("string"), " frames")),
        ("no shared identity", F.col("clashes") == 0, text(F.col("clashes").cast("string"), " pairs")),
    ]
    cells = F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(n).alias("name"), p.alias("passed"), d.alias("detail")) for i, (n, p, d) in enumerate(rows)])
    return reports.select(key, F.inline(cells))


def failed_checks(checked: DataFrame, key: str = "clip") -> DataFrame:
    """key, passed, total, notes: how many checks passed, and "key: name - detail" of those that did not, in order."""
    note = F.when(~F.col("passed"), F.struct("ix", F.concat(F.col(key).cast("string"), F.lit(": "), "name", F.lit(" - "), "detail").alias("note")))
    notes = F.transform(F.array_sort(F.collect_list(note)), lambda n: n["note"])
    return checked.groupBy(key).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), notes.alias("notes"))


def routes(reports: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """``reports`` (stem, precision, coverage) with video, minutes and best.

    ``runs``: artifact, elapsed; a run counts for the one route whose file it wrote, so a fused route does not have the passes
    it was made from; null where no run is known. ``sources``: stem, video, from the tracks sidecars. ``best``: the video's
    highest precision, if over 0.
    """
    spent = runs.select(route(F.col("artifact")).alias("stem"), F.coalesce("elapsed", F.lit(0.0)).alias("elapsed")).where("stem is not null").groupBy("stem").agg((F.sum("elapsed") / 60).alias("minutes"))
    out = reports.join(sources.select("stem", "video").distinct(), "stem", "left").join(spent.where("minutes > 0"), "stem", "left")
    top = out.groupBy("video").agg(F.max("precision").alias("_top"))
    return out.join(top.withColumnRenamed("video", "_video"), F.col("video").eqNullSafe(F.col("_video")), "left").withColumn("best", F.coalesce((F.col("precision") == F.col("_top")) & (F.col("_top") > 0), F.lit(False))).drop("_top", "_video")
