"""Row filters, samples and status columns of tracks, boxes, plays and annotations.

Nulls compare as unknown, so a row with a null in the tested column is left out, and a
status column takes its next branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEET_IN_A_METRE = 100 / 30.48


def of_classes(boxes: DataFrame, column: str, classes: list) -> DataFrame:
    return boxes.where(F.col(column).isin(classes))


def floor_counts(boxes: DataFrame, keys: list[str], column: str, floors: dict[str, float]) -> DataFrame:
    """Per key how many boxes reach each confidence floor."""
    return boxes.groupBy(*keys).agg(*[F.count_if(F.col(column) >= f).alias(name) for name, f in floors.items()])


def with_samples(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of keys that have ``least`` rows or more."""
    return rows.join(rows.groupBy(*keys).count().where(F.col("count") >= least).select(*keys), keys, "left_semi")


def thinned_empties(images: DataFrame, keys: list[str], order: list[str], empty: Column, every: int = 12) -> DataFrame:
    """All images with boxes, and of each key's empty ones every ``every``-th in order."""
    held = images.withColumn("_empty", F.coalesce(empty, F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(*keys, "_empty").orderBy(*order))
    return held.withColumn("_rank", rank).where("not _empty or _rank % {0} = 0".format(every)).drop("_empty", "_rank")


def linspace_samples(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows at ``k`` even positions from a key's first to its last, rounded half to even."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    at = lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1))), 0)
    return ranked.where(F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(i) == F.col("_rank"))).drop("_rank", "_n")


def status(human: Column, ignored: Column, name: Column, number: Column) -> Column:
    return F.when(human, "human").when(ignored, "ignored").when(name.isNotNull(), "named").when(number.isNotNull(), "number-only").otherwise("anonymous")


def in_tab(state: Column, tab: str) -> Column:
    """Whether a review tab (todo, done, all) shows a status."""
    shown = {"todo": ("number-only", "anonymous"), "done": ("human", "ignored")}.get(tab)
    return state.isin(*shown) if shown else F.lit(True)


def film_stamp(period: Column, clock: Column, opening: float, length: float, played: int = 3) -> Column:
    """Seconds into the film of a play of its period; null outside the film's window of the game clock."""
    t = F.lit(opening) - clock
    return F.when((period == played) & t.between(0, length), F.round(t, 1))


def complete_plays(plays: DataFrame, period: str, clock: str) -> DataFrame:
    return plays.where(F.col(period).isNotNull() & (F.coalesce(F.col(clock), F.lit("")) != ""))


def non_trivial(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    return (F.col(x2) > F.col(x1)) & (F.col(y2) > F.col(y1))


def has_activity(*counters: str) -> Column:
    """Whether any counter is neither null nor zero."""
    out = F.lit(False)
    for c in counters:
        out |= F.coalesce(F.col(c), F.lit(0)) != 0
    return out


def metres_to_feet(x: Column) -> Column:
    return x * FEET_IN_A_METRE


def span_seconds(start: Column, end: Column, fps: float) -> Column:
    """Length of a span of frames, both ends included."""
    return (end - start + 1) / F.lit(fps)


def residual_gate(anchors: DataFrame, keys: list[str], confidence: str, residual: str, *, least: int = 4, floor: float = 0.5, limit: float = 0.5) -> DataFrame:
    """Per key the anchors above the confidence floor, their median residual and whether the solve may be used."""
    good = F.col(confidence) > floor
    found = anchors.groupBy(*keys).agg(F.count_if(good).alias("anchors"), F.percentile(F.when(good, F.col(residual)), F.lit(0.5)).alias("median_residual"))
    return found.withColumn("usable", (F.col("anchors") >= least) & F.coalesce(F.col("median_residual") <= limit, F.lit(False)))


def first_probe(spans: DataFrame, probes: DataFrame, keys: list[str], at: str, count: str, *, step: int, tail: int, need: int) -> DataFrame:
    """Per span (keys, start, end) the first of the probes at start, start + step, ... before end - tail whose count is enough; null without one."""
    hit = spans.join(probes.select(*keys, F.col(at).alias("_at"), F.col(count).alias("_count")), keys)
    ok = (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end") - tail) & ((F.col("_at") - F.col("start")) % step == 0) & (F.col("_count") >= need)
    first = hit.where(ok).groupBy(*keys, "start", "end").agg(F.min("_at").alias("probe"))
    return spans.select(*keys, "start", "end").distinct().join(first, [*keys, "start", "end"], "left")
