"""Joins and windows over time: nearest, forward fill, sliding windows, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], at: str, query_id: str, point_id: str, tolerance: float, *, later_wins: bool = True, offset: float = 0) -> DataFrame:
    """Each query with its nearest point of the same key, null beyond ``tolerance``.

    One sort of queries and points together: the last point before and the first after come
    from two running windows, so no pairs are made. On a tie the later point wins, or the
    earlier. Points at one time: the largest ``point_id``. ``offset``: the points' time at the queries' 0.
    """
    q = queries.select(*keys, (F.col(at) + offset).alias("_t"), F.col(query_id).alias("_q"), F.lit(None).cast(points.schema[point_id].dataType).alias("_p"))
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(queries.schema[query_id].dataType).alias("_q"), F.col(point_id).alias("_p"))
    both = q.unionByName(p)
    row = F.when(F.col("_p").isNotNull(), F.struct("_t", "_p"))
    points_first = F.when(F.col("_p").isNotNull(), 0).otherwise(1)
    before = F.last(row, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", points_first, "_p"))
    after = F.last(row, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_t"), points_first, "_p"))
    found = both.withColumn("_b", before).withColumn("_a", after).where("_q is not null")
    back, ahead = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    pick_after = F.col("_b").isNull() | (F.col("_a").isNotNull() & ((ahead <= back) if later_wins else (ahead < back)))
    best = F.when(pick_after, F.col("_a")).otherwise(F.col("_b"))
    near = found.withColumn("_best", best).withColumn("_d", F.abs(F.col("_best._t") - F.col("_t")))
    ok = F.col("_d") <= tolerance
    return near.select(*keys, F.col("_q").alias(query_id), (F.col("_t") - offset).alias(at), F.when(ok, F.col("_best._p")).alias(f"near_{point_id}"), F.when(ok, F.col("_d")).alias("distance"))


def forward_filled(rows: DataFrame, keys: list[str], at: str, values: list[str], step: int = 1, every: int | None = None) -> DataFrame:
    """A row for every step of each key's range; ``values`` held until the next row that has them.

    ``every``: steps between samples; at 1 every step has been looked at, so one without a row is empty and holds nothing.
    """
    spine = rows.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step).cast(rows.schema[at].dataType))).alias(at))
    w = Window.partitionBy(*keys).orderBy(at)
    sampled = rows.select(*keys, at, F.struct(*values).alias("_v"))
    held = F.col("_v") if every == 1 else F.last("_v", ignorenulls=True).over(w)
    return spine.join(sampled, [*keys, at], "left").withColumn("_h", held).select(*keys, at, *[F.col(f"_h.{v}").alias(v) for v in values], F.col("_v").isNotNull().alias("sampled"))


def key_frames(rows: DataFrame, solves: DataFrame, keys: list[str], at: str, every: int) -> DataFrame:
    """Rows with the solve of their key frame (``at`` rounded down to the grid); unsolved key frames give null."""
    keyed = rows.withColumn("_key", F.col(at) - F.col(at) % every)
    return keyed.join(solves.withColumnRenamed(at, "_key"), [*keys, "_key"], "left").drop("_key")


def windowed(events: DataFrame, start: str, end: str, *, width: int, stride: int | None = None, until: Column | None = None) -> DataFrame:
    """Events joined to each sliding window that they overlap, with the seconds inside it; windows end by ``until``, if given.

    An event finds its windows by arithmetic, so there is no range join.
    """
    stride = stride or max(1, width // 2)
    first = F.greatest(F.lit(0), F.floor((F.col(start) - width) / stride) + 1)
    last = F.ceil(F.col(end) / stride) - 1
    last = last if until is None else F.least(last, F.floor((until - width) / stride))
    placed = events.where(last >= first).withColumn("window_start", F.explode(F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda k: k * stride)))
    inside = F.least(F.col(end), F.col("window_start") + width) - F.greatest(F.col(start), F.col("window_start"))
    return placed.withColumn("inside", inside).where("inside > 0")


def running(rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Running sums of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(value).over(w) for name, value in totals.items()})


def second_difference(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """next - 2 * value + previous where both neighbours are at the next and the previous integer."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = (F.col(at) - F.lag(at).over(w) == 1) & (F.lead(at).over(w) - F.col(at) == 1)
    return rows.withColumn("second_difference", F.when(whole, F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)))


def bridged(rows: DataFrame, keys: list[str], at: str, value: str, longest: int = 3) -> DataFrame:
    """Rows with gaps of up to ``longest`` missing integers filled linearly; ``interpolated`` marks those."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.lead(at).over(w) - F.col(at) - 1
    near = rows.select(*keys, at, value, gap.alias("_gap"), F.lead(value).over(w).alias("_next"))
    filled = near.where((F.col("_gap") >= 1) & (F.col("_gap") <= longest)).select(*keys, F.col(at).alias("_at"), value, "_gap", "_next", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_gap").cast("bigint"))).alias("_k"))
    made = filled.select(*keys, (F.col("_at") + F.col("_k")).cast(rows.schema[at].dataType).alias(at), (F.col(value) + (F.col("_next") - F.col(value)) * F.col("_k") / (F.col("_gap") + 1)).alias(value), F.lit(True).alias("interpolated"))
    return rows.select(*keys, at, F.col(value).cast("double").alias(value), F.lit(False).alias("interpolated")).unionByName(made)


def first_confirmed(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Each key's first value that is read ``n`` times running, and where it is confirmed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_seq", F.row_number().over(w))
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.col("_seq") > 1), 0).otherwise(1)
    run = numbered.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = run.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)))
    hits = counted.where((F.col("_n") == n) & F.col(value).isNotNull())
    return hits.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col("_seq").alias("s")), "_seq").alias("_m")).select(*keys, F.col("_m.v").alias("confirmed"), F.col("_m.s").alias("at_row"))


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n ... of each key in order."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("_i") % n == 0).drop("_i")


def evenly(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """``most`` rows of each key spread evenly over its order; all of a smaller key."""
    part = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    # Row i is taken when it is floor(j * n / most) for some j.
    j = F.ceil(F.col("_i") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | (F.floor(j * F.col("_n") / most) == F.col("_i")) & (j < most)
    return ranked.where(taken).drop("_i", "_n")


def time_split(rows: DataFrame, keys: list[str], order: list[str], train: float = 0.7, valid: float = 0.1) -> DataFrame:
    """``part``: train, valid or test by position in each key's order."""
    part = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    label = F.when(F.col("_i") < F.floor(F.col("_n") * train), "train").when(F.col("_i") < F.floor(F.col("_n") * (train + valid)), "valid").otherwise("test")
    return ranked.withColumn("part", label).drop("_i", "_n")
