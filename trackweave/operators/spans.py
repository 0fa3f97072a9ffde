"""Intervals: lifetimes, islands, coalescing, interval joins. Spans are closed at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifetimes(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last ``at`` and number of rows of each key."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_rows"))


def islands(rows: DataFrame, keys: list[str], at: str, max_gap: int, min_length: int = 1) -> DataFrame:
    """Runs of rows no further apart than ``max_gap``, those shorter than ``min_length`` left out."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = rows.select(*keys, at).withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) <= max_gap, 0).otherwise(1))
    numbered = starts.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows"))
    return found.where(F.col("end") - F.col("start") + 1 >= min_length).drop("_island")


def overlap_kind(found: DataFrame, share: float = 0.9) -> DataFrame:
    """``kind``: duplicate where an island covers most of the shorter lifetime, else collapse. Needs start, end, shorter."""
    return found.withColumn("kind", F.when((F.col("end") - F.col("start") + 1) / F.col("shorter") >= share, "duplicate").otherwise("collapse"))


def contiguous_runs(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive integers among the distinct ``at`` of each key."""
    w = Window.partitionBy(*keys).orderBy(at)
    grouped = rows.select(*keys, at).distinct().withColumn("_group", F.col(at) - F.row_number().over(w))
    return grouped.groupBy(*keys, "_group").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows")).drop("_group")


def coalesced(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans that overlap or touch (next integer) put together."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, start, end).withColumn("_new", F.when(F.col(start) <= reach + 1, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")


def outside(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that no span of their key covers."""
    r, s = rows.alias("r"), spans.alias("s")
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in keys]
    on = F.col(f"r.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    for c in same:
        on = c & on
    return r.join(s, on, "left_anti")


def first_covering(rows: DataFrame, spans: DataFrame, keys: list[str], row_key: list[str], at: str, order: str, take: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each row with the columns ``take`` of the first span by ``order`` that covers it; null without any."""
    r, s = rows.alias("r"), spans.select(*keys, start, end, order, *[c for c in take if c not in (*keys, start, end, order)]).alias("s")
    on = F.col(f"r.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    for k in keys:
        on = (F.col(f"r.{k}") == F.col(f"s.{k}")) & on
    hit = F.min_by(F.struct(*[F.col(f"s.{c}").alias(c) for c in take]), F.col(f"s.{order}"))
    best = r.join(s, on).groupBy(*[F.col(f"r.{k}").alias(k) for k in row_key]).agg(hit.alias("_hit"))
    return rows.join(best, row_key, "left").select(*rows.columns, *[F.col(f"_hit.{c}").alias(f"hit_{c}") for c in take])


def overlapping_pairs(spans: DataFrame, keys: list[str], name: str, least: float, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of different names of one key whose spans share more than ``least``."""
    a, b = spans.alias("a"), spans.alias("b")
    on = F.col(f"a.{name}") < F.col(f"b.{name}")
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    shared = F.least(F.col(f"a.{end}"), F.col(f"b.{end}")) - F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) + 1
    return a.join(b, on & (shared > least)).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{name}").alias("first_name"), F.col(f"b.{name}").alias("second_name"), shared.alias("shared"))


def covered_share(spans: DataFrame, lives: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each life that its spans cover (spans disjoint)."""
    total = spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
    return lives.join(total, keys, "left").withColumn("share", F.coalesce("covered", F.lit(0)) / (F.col("last_at") - F.col("first_at") + 1))
