"""Paths of tracks: excursions taken out by a robust spread, and smoothing by fixed coefficients; all as windows over a run.

A run is a stretch of consecutive frames of a track. Steps between neighbours that are longer than ``least`` and stand ``sigma``
robust deviations over the run's median step are jumps. Jumps no more than ``longest`` frames apart belong together; of those
the first and second, third and fourth and so on bound an excursion. Its samples, and ``pad`` more on either side, go onto
the line between the nearest samples left. A run with an excursion at its very edge keeps all of its samples.

Then every sample is replaced by the value of the polynomial of degree ``degree`` through its window (least squares); at the
ends of a run the first and last whole windows serve, and runs shorter than a window use the largest odd one they hold.
Runs under ``shortest`` samples stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.tasks import spread

#: Frame numbers of a block in which starts of runs are looked for.
BLOCK = 4096


def smoothing_weights(window: int, degree: int) -> np.ndarray:
    """Row p: weights of a window's samples for the value at its place p."""
    powers = np.arange(window)[:, None] ** np.arange(degree + 1)[None, :].astype(float)
    return powers @ np.linalg.pinv(powers)


def _table(weights: dict[int, np.ndarray], size: Column, place: Column) -> Column:
    """The weights of the window of ``size`` at ``place``."""
    sizes = sorted(weights)
    rows = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights[w]]) for w in sizes])
    return F.get(F.get(rows, ((size - sizes[0]) / 2).cast("int")), place.cast("int"))


def with_runs(rows: DataFrame, keys: list[str], at: str, count: int = 0) -> DataFrame:
    """``rows`` with ``_run``, the same for all of a run and for no other of its track; dealt to tasks by run.

    Starts are found in blocks of ``BLOCK`` frame numbers, where the last frame of a block is also seen by the next one; what goes on
    from the block before has the latest start of the blocks before. So no task sorts a whole track. ``count``: about how many rows there are (``tasks.spread``).
    """
    here, then = F.expr(f"`{at}` div {BLOCK}"), F.expr(f"(`{at}` + 1) div {BLOCK}")
    place = lambda b, seen: F.struct(b.alias("block"), F.lit(seen).alias("seen"))
    seen = rows.withColumn("_e", F.explode(F.when(here == then, F.array(place(here, False))).otherwise(F.array(place(here, False), place(then, True)))))
    seen = seen.withColumn("_block", F.col("_e.block")).withColumn("_seen", F.col("_e.seen")).drop("_e")

    def started(found: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "_block").orderBy(at, F.desc("_seen"))
        new = ~F.col("_seen") & F.coalesce(F.col(at) - F.lag(at).over(w) != 1, F.lit(True))
        start = F.when(new, F.struct(F.col(at).alias("at"), F.row_number().over(w).alias("n")))
        latest = F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return spread(found, *keys, "_block", count=count).withColumn("_run", latest)

    last = started(seen.select(*keys, at, "_block", "_seen")).groupBy(*keys, "_block").agg(F.max("_run").alias("_run"))
    before = F.last("_run", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), before.alias("_before"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_{i}")) & same
    named = started(seen).where("not _seen").join(carried.hint("shuffle_hash"), same, "left").withColumn("_run", F.coalesce("_run", "_before"))
    return spread(named.select(*rows.columns, "_run"), *keys, "_run", count=count)


def cleaned(positions: DataFrame, keys: list[str], at: str = "frame", *, sigma: float = 3.5, least: float = 0.6 * 0.3048, longest: int = 18, pad: int = 2, window: int = 9, degree: int = 2, shortest: int = 5, places: int = 2, count: int = 0) -> DataFrame:
    """``positions`` (keys, at, a whole number, x, y) with cleaned x and y, and ``edited``: whether the sample was part of an excursion; ``count`` as in ``with_runs``."""
    rows = with_runs(positions, keys, at, count)
    run = Window.partitionBy(*keys, "_run")
    order = run.orderBy(at)
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    onwards, after = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(run))
    rows = rows.withColumn("_d", F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)))
    rows = rows.withColumn("_m", F.median("_d").over(run)).withColumn("_s", F.median(F.abs(F.col("_d") - F.col("_m"))).over(run))
    jump = F.coalesce(F.col("_d") > F.greatest(F.lit(least), F.col("_m") + sigma * 1.4826 * F.col("_s")), F.lit(False))
    rows = rows.withColumn("_j", jump)
    at_jump = F.when(F.col("_j"), F.col("_i"))
    last, nxt = F.max(at_jump).over(so_far), F.min(at_jump).over(after)
    rows = rows.withColumn("_first", F.col("_j") & F.coalesce(F.col("_i") - F.max(at_jump).over(before) > longest, F.lit(True)))
    rows = rows.withColumn("_c", F.count_if("_j").over(so_far)).withColumn("_last", last).withColumn("_next", nxt)
    rows = rows.withColumn("_k", F.col("_c") - F.max(F.when(F.col("_first"), F.col("_c"))).over(so_far))
    off = F.coalesce((F.col("_k") % 2 == 0) & (F.col("_next") - F.col("_last") <= longest), F.lit(False))
    rows = rows.withColumn("_off", off).withColumn("_off", F.max("_off").over(order.rowsBetween(-pad, pad)))
    good = F.when(~F.col("_off"), F.struct("_i", "x", "y"))
    rows = rows.withColumn("_a", F.last(good, ignorenulls=True).over(so_far)).withColumn("_b", F.first(good, ignorenulls=True).over(onwards))
    rows = rows.withColumn("_whole", F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).over(run))
    rows = rows.withColumn("edited", F.col("_off") & F.col("_whole") & (F.col("_n") >= shortest))
    t = (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    lined = [F.when(F.col("edited"), F.col(f"_a.{c}") + t * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).otherwise(F.col(c)).alias(c) for c in ("x", "y")]
    rows = rows.withColumn("_p", F.struct(*lined))
    around = F.collect_list("_p").over(order.rowsBetween(1 - window, window - 1))
    size = F.least(F.lit(window), F.col("_n") - (F.col("_n") + 1) % 2)
    low = F.greatest(F.lit(0), F.least(F.col("_i") - F.floor((size - 1) / 2), F.col("_n") - size))
    rows = rows.withColumn("_near", around).withColumn("_size", size.cast("int")).withColumn("_low", low.cast("int"))
    weights = _table({w: smoothing_weights(w, degree) for w in range(shortest + (shortest + 1) % 2, window + 1, 2)}, F.col("_size"), F.col("_i") - F.col("_low"))
    part = F.slice("_near", (F.col("_low") - F.greatest(F.col("_i") - window + 1, F.lit(0)) + 1).cast("int"), F.col("_size"))
    rows = rows.withColumn("_w", weights).withColumn("_near", F.when(F.col("_n") >= shortest, part))
    smooth = lambda c: F.aggregate(F.zip_with("_near", "_w", lambda p, w: p[c] * w), F.lit(0.0), lambda s, v: s + v)
    done = {c: F.when(F.col("_n") >= shortest, F.round(smooth(c), places)).otherwise(F.col(c)) for c in ("x", "y")}
    return rows.select(*[done[c].alias(c) if c in done else F.col(c) for c in positions.columns], "edited")


def wobble(positions: DataFrame, keys: list[str], at: str = "frame", shortest: int = 5) -> DataFrame:
    """keys, run (its first frame), wobble: mean absolute second difference of x and y along each run of ``shortest`` samples or more."""
    rows = with_runs(positions, keys, at)
    order = Window.partitionBy(*keys, "_run").orderBy(at)
    second = lambda c: F.abs(F.col(c) - 2 * F.lag(c).over(order) + F.lag(c, 2).over(order))
    rows = rows.select(*keys, "_run", F.col(at).alias("_at"), ((second("x") + second("y")) / 2).alias("_w"))
    return rows.groupBy(*keys, "_run").agg(F.min("_at").alias("run"), F.count("*").alias("_n"), F.avg("_w").alias("wobble")).where(F.col("_n") >= shortest).drop("_run", "_n")
