"""Counts, rates, shares and rankings over runs, plays, labels and windows. Empty groups give no rows, no attempts give 0 percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.tasks import spread


def ranked(rows: DataFrame, order: list[Column], limit: int, keys: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows of each key in order, with their rank; without keys those of the whole table, found by a top-k sort."""
    if keys:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit)
    top = rows.orderBy(*order).limit(limit)  # at most ``limit`` rows go on to one task
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint"))


def reason_groups(failures: DataFrame, reason: str) -> DataFrame:
    """Failures by the head of their reason: up to the first comma, then up to " in view"."""
    head = F.split(F.split(F.col(reason), ",")[0], " in view")[0]
    return failures.groupBy(head.alias("reason")).agg(F.count("*").alias("n"))


def percent(made: Column, attempts: Column) -> Column:
    return F.when(attempts > 0, made / attempts * 100).otherwise(0.0)


def bar_span(*values: Column) -> Column:
    """Length of the axis of a bar comparison: 100, or the largest value beyond."""
    return F.greatest(F.lit(100.0), *values)


def accuracy(truth: DataFrame, predicted: DataFrame, keys: list[str], actual: str, guess: str) -> DataFrame:
    """hits, total and accuracy over all truth rows; rows without a prediction are errors."""
    both = truth.join(predicted.select(*keys, F.col(guess).alias("_guess")), keys, "left")
    hit = F.count_if(F.col("_guess") == F.col(actual))
    return both.agg(hit.alias("hits"), F.count("*").alias("total")).withColumn("accuracy", F.when(F.col("total") > 0, F.col("hits") / F.col("total")))


def landmark_spread(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per landmark its median place and the median distance to it."""
    middle = points.groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("mid_x"), F.percentile(y, F.lit(0.5)).alias("mid_y"))
    far = points.join(middle, key).withColumn("_d", F.hypot(F.col(x) - F.col("mid_x"), F.col(y) - F.col("mid_y")))
    return far.groupBy(key, "mid_x", "mid_y").agg(F.percentile("_d", F.lit(0.5)).alias("spread"), F.count("*").alias("n"))


def job_rates(jobs: DataFrame, now: float, *, quiet: float = 90.0, stale: float = 1800.0) -> DataFrame:
    """``jobs`` (started, updated, done, total; seconds) with elapsed, rate, eta, silence and pulse (live, quiet, stale)."""
    elapsed, silence = F.lit(now) - F.col("started"), F.lit(now) - F.col("updated")
    rate = F.when((elapsed > 0) & (F.col("done") > 0), F.col("done") / elapsed)
    return jobs.select("*", elapsed.alias("elapsed"), rate.alias("rate"), ((F.col("total") - F.col("done")) / rate).alias("eta"), silence.alias("silence"), F.when(silence > stale, "stale").when(silence > quiet, "quiet").otherwise("live").alias("pulse"))


def live_counts(runs: DataFrame, clip: str, state: str, silence: str, stale: float = 1800.0) -> DataFrame:
    """Distinct clips by the base name of their path, and runs that are running and not silent for long."""
    name = F.element_at(F.split(F.col(clip), "/"), -1)
    return runs.agg(F.count_distinct(name).alias("clips"), F.count_if((F.col(state) == "running") & (F.col(silence) <= stale)).alias("live"))


def mean_per_frame(labels: DataFrame, source: str, frame: str, spine: DataFrame) -> DataFrame:
    """Mean number of labels a frame of each source, over all frames of ``spine``."""
    frames = spine.select(frame).distinct().agg(F.count("*").alias("_frames"))
    counted = labels.groupBy(source).agg(F.count("*").alias("labels"))
    return counted.join(F.broadcast(frames)).select(source, "labels", (F.col("labels") / F.col("_frames")).alias("per_frame"))  # one row


def jitter(points: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Length of the step from each sample to the next one of its key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("step", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))


def duration_share(spans: DataFrame, keys: list[str], clip: str, fps: float) -> DataFrame:
    """Seconds of each key's spans (start, end; both included) and their share of the clip from its first to its last frame."""
    held = spans.groupBy(clip, *keys).agg((F.sum(F.col("end") - F.col("start") + 1) / fps).alias("seconds"))
    whole = spans.groupBy(clip).agg(((F.max("end") - F.min("start") + 1) / fps).alias("_clip"))
    return held.join(whole, clip).withColumn("share", F.col("seconds") / F.col("_clip")).drop("_clip")


def best_contrast(vectors: DataFrame, key: str, vector: str, dims: int, least: int = 2) -> DataFrame:
    """Per key the pair of dimensions whose difference parts the vectors best: distance of the means of its two signs in
    average deviations, times how even the sides are; the first pair on a tie."""
    at = lambda i: F.get(F.col(vector), F.lit(i)).cast("double")
    pairs = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), (at(p) - at(q)).alias("s")) for p in range(dims) for q in range(p + 1, dims)]
    x = vectors.select(key, F.inline(F.array(*pairs)))
    up, down = F.when(F.col("s") > 0, F.col("s")), F.when(F.col("s") <= 0, F.col("s"))
    g = x.groupBy(key, "p", "q").agg(F.count(up).alias("n1"), F.count(down).alias("n0"), F.avg(up).alias("m1"), F.avg(down).alias("m0"), F.stddev_pop(up).alias("d1"), F.stddev_pop(down).alias("d0"))
    sep = F.abs(F.col("m1") - F.col("m0")) / F.nullif((F.col("d1") + F.col("d0")) / 2, F.lit(0.0))
    scored = g.where((F.col("n1") >= least) & (F.col("n0") >= least)).withColumn("contrast", F.round(sep * F.least("n1", "n0") / (F.col("n1") + F.col("n0")) / 0.5, 6))
    return ranked(scored, [F.col("contrast").desc_nulls_last(), F.col("p"), F.col("q")], 1, [key]).select(key, "p", "q", "contrast")


def windows_inside(contacts: DataFrame, players: DataFrame, keys: list[str], *, width: int, stride: int | None = None, full: int = 10) -> DataFrame:
    """Sliding windows from the first frame of each key that end by its last one, with their measures.

    ``contacts``: keys, start, end (end excluded); ``players``: keys, frame, n, one row for each frame. Gives contact
    (frames of contact inside), short_share (share of frames with fewer than ``full`` players), least and mean players.
    A frame or contact finds its windows by arithmetic, so there is no range join.
    """
    stride = stride or max(1, width // 2)
    bounds = players.groupBy(*keys).agg(F.min("frame").alias("t0"), (F.max("frame") + 1).alias("t1"))
    count = F.floor((F.col("t1") - F.col("t0") - width) / stride)

    def placed(rows: DataFrame, start: Column, end: Column) -> DataFrame:
        first = F.greatest(F.lit(0), F.floor((start - F.col("t0") - width) / stride) + 1)
        last = F.least(count, F.ceil((end - F.col("t0")) / stride) - 1)
        found = rows.join(bounds, keys).where(last >= first).withColumn("_k", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        return found.withColumn("window_start", F.col("t0") + F.col("_k") * stride)

    frames = placed(players, F.col("frame"), F.col("frame") + 1)
    seen = frames.groupBy(*keys, "window_start").agg(F.avg((F.col("n") < full).cast("int")).alias("short_share"), F.min("n").alias("least"), F.avg("n").alias("mean"))
    spans = placed(contacts, F.col("start"), F.col("end"))
    inside = F.least(F.col("end"), F.col("window_start") + width) - F.greatest(F.col("start"), F.col("window_start"))
    touched = spans.groupBy(*keys, "window_start").agg(F.sum(inside).alias("contact"))
    return seen.join(touched, [*keys, "window_start"], "left").withColumn("contact", F.coalesce("contact", F.lit(0)))


def best_windows(windows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Least contact first, then the smallest share of short frames, then most players; the earlier on a tie."""
    return ranked(windows, [F.asc("contact"), F.asc("short_share"), F.desc("mean"), F.asc("window_start")], limit, keys)


def wobble(samples: DataFrame, keys: list[str], order: str, solved: str, matrix: str, probes: list[tuple[float, float]], limit: float = 30.0) -> DataFrame:
    """Mean distance of probe points, projected by each sample's 3 x 3 matrix (array of 9), from the middle of its neighbours'.

    Null unless the sample and both neighbours are solved; ``suspect`` beyond ``limit``.
    """
    w = Window.partitionBy(*keys).orderBy(order)

    def seen(h: Column, x: float, y: float) -> Column:
        z = h[6] * x + h[7] * y + h[8]
        return F.struct(((h[0] * x + h[1] * y + h[2]) / z).alias("x"), ((h[3] * x + h[4] * y + h[5]) / z).alias("y"))

    points = F.when(F.col(solved), F.array(*[seen(F.col(matrix), x, y) for x, y in probes]))
    rows = samples.withColumn("_here", points)
    rows = rows.withColumn("_before", F.lag("_here").over(w)).withColumn("_after", F.lead("_here").over(w))
    gap = lambda p, i: F.hypot(p["x"] - (F.col("_before")[i]["x"] + F.col("_after")[i]["x"]) / 2, p["y"] - (F.col("_before")[i]["y"] + F.col("_after")[i]["y"]) / 2)
    total = F.aggregate(F.transform(F.col("_here"), gap), F.lit(0.0), lambda a, b: a + b)
    known = F.col("_here").isNotNull() & F.col("_before").isNotNull() & F.col("_after").isNotNull()
    out = rows.withColumn("wobble", F.when(known, total / len(probes)))
    return out.withColumn("suspect", F.coalesce(F.col("wobble") > limit, F.lit(False))).drop("_here", "_before", "_after")


def segment_report(labels: DataFrame, spine: DataFrame, clip: str, frame: str, tid: str, club: str, *, full: int = 10, count: int = 0) -> DataFrame:
    """Per clip over all frames of ``spine`` (frames without a label count): frames, labels, doubles (labels beyond the first of
    a track in a frame), the share of frames with ``full`` labels or more, the mean, proxy (mean / ``full``), short frames,
    frames with five of each of two clubs, and verdict (no doubles and every frame full).

    Labels and spine are dealt by frame, in one shuffle each, and everything up to the frame's counts is done there; with
    ``count``, about how many labels there are, no task has more of them in its tables as there are more.
    """
    labels = spread(labels.select(clip, frame, club, tid), clip, frame, count=count)
    spine = spread(spine.select(clip, frame), clip, frame, count=count)
    per_club = labels.groupBy(clip, frame, club).agg(F.count("*").alias("_n"), F.count_distinct(tid).alias("_t"))
    per_frame = per_club.groupBy(clip, frame).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") - F.col("_t")).alias("doubles"), F.sort_array(F.collect_list("_n")).alias("clubs"))
    all_frames = spine.distinct().join(per_frame, [clip, frame], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    five = F.count_if(F.col("clubs") == F.array(F.lit(5).cast("bigint"), F.lit(5).cast("bigint")))
    out = all_frames.groupBy(clip).agg(
        F.count("*").alias("frames"), F.sum("n").alias("labels"), F.coalesce(F.sum("doubles"), F.lit(0)).alias("doubles"),
        F.avg((F.col("n") >= full).cast("int")).alias("full_share"), F.avg("n").alias("mean"), F.count_if(F.col("n") < full).alias("short_frames"), five.alias("five_a_side"),
    )
    return out.withColumn("proxy", F.col("mean") / full).withColumn("verdict", (F.col("doubles") == 0) & (F.col("short_frames") == 0))


def player_timeline(labels: DataFrame, players: DataFrame, player: str, frame: str) -> DataFrame:
    """Frames of each player in order, empty for players without one."""
    found = labels.groupBy(player).agg(F.sort_array(F.collect_set(frame)).alias("frames"))
    kind = found.schema["frames"].dataType.simpleString()
    return players.select(player).distinct().join(found, player, "left").withColumn("frames", F.coalesce("frames", F.array().cast(kind)))
