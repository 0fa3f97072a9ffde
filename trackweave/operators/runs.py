"""Run archives, corrections and merges that respect what a person decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def staged(jobs: DataFrame, stages: DataFrame, job: str) -> DataFrame:
    """``stage`` of each row: the longest prefix of its job, the first stage on equal length, "Other" without any.

    Distinct jobs are few, so they are matched first and joined back.
    """
    distinct = jobs.select(job).distinct()
    hit = distinct.join(F.broadcast(stages), F.startswith(F.col(job), F.col("prefix")))  # a fixed table of stages
    best = hit.groupBy(job).agg(F.max(F.struct(F.length("prefix").alias("n"), (-F.col("ix")).alias("i"), "stage")).alias("m")).select(job, F.col("m.stage").alias("stage"))
    return jobs.join(best, job, "left").withColumn("stage", F.coalesce("stage", F.lit("Other")))


def rollup(runs: DataFrame, spine: DataFrame) -> DataFrame:
    """Runs by stage and state; stages of the spine without runs stay, an empty "Other" does not. Needs stage, state, stale."""
    live = F.col("state") == "running"
    n = runs.groupBy("stage").agg(F.count_if(live & ~F.col("stale")).alias("running"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(live & F.col("stale")).alias("stale"), F.count_if(~F.col("state").isin("running", "done")).alias("failed"))
    out = spine.join(n, "stage", "left").na.fill(0)
    return out.where((F.col("stage") != "Other") | (F.col("running") + F.col("done") + F.col("stale") + F.col("failed") > 0))


def history(runs: DataFrame) -> DataFrame:
    """Per clip: its runs in order, the latest start, time spent, failures. Needs clip, run, started, elapsed, failed."""
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started", "run"))), lambda x: x["run"].cast("string")), ",")
    return runs.groupBy("clip").agg(F.count("*").alias("runs"), F.max("started").alias("latest"), F.sum("elapsed").alias("elapsed"), F.count_if("failed").alias("failed"), in_order.alias("in_order"))


def best(routes: DataFrame) -> DataFrame:
    """``chosen``: the route with the highest precision, then coverage; ``best``: every route at the clip's highest precision above 0."""
    w = Window.partitionBy("clip").orderBy(F.desc("precision"), F.desc("coverage"), "route")
    top = F.max("precision").over(Window.partitionBy("clip"))
    return routes.withColumn("chosen", F.row_number().over(w) == 1).withColumn("best", (F.col("precision") == top) & (F.col("precision") > 0))


def last_action(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last change of each key."""
    return changes.groupBy(*keys).agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_m")).select(*keys, F.col("_m._v").alias(value))


def applied(rows: DataFrame, updates: DataFrame, keys: list[str], value: str, locked: str) -> DataFrame:
    """Rows with updated values, except where a person has locked them."""
    new = updates.select(*keys, F.col(value).alias("_new"))
    out = rows.join(new, keys, "left")
    return out.withColumn(value, F.when(F.col(locked), F.col(value)).otherwise(F.coalesce("_new", value))).drop("_new")


def applied_identities(players: DataFrame, identities: DataFrame, sides: DataFrame) -> DataFrame:
    """``players`` (clip, tid, number, name, identity, side) under new identities, and ``moved``: whether the side changed.

    What a person decided (identity human or ignored) stays, as do players without an identity or a number. All others take
    the number, and the name or none: a number that no roster has must not keep an old name. The ``sides`` (clip, club,
    side) of the clubs win over the colour's.
    """
    new = identities.where("number is not null").select("clip", "tid", F.col("number").alias("_number"), F.col("name").alias("_name"), F.col("club").alias("_club"))
    to = sides.select("clip", F.col("club").alias("_club"), F.col("side").alias("_side"))
    rows = players.join(new, ["clip", "tid"], "left").join(to, ["clip", "_club"], "left")
    open_ = F.col("_number").isNotNull() & ~F.coalesce(F.col("identity").isin("human", "ignored"), F.lit(False))
    rows = rows.withColumn("_open", open_).withColumn("moved", F.coalesce(F.col("_open") & (F.col("_side") != F.col("side")), F.lit(False)))
    take = lambda c, value: F.when(F.col("_open"), value).otherwise(F.col(c)).alias(c)
    new_values = {"number": F.col("_number"), "name": F.col("_name"), "identity": F.lit("jersey-ocr"), "side": F.coalesce("_side", "side")}
    return rows.select(*[take(c, new_values[c]) if c in new_values else F.col(c) for c in players.columns], "moved")


def unarchived(finished: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Finished runs that the archive does not have yet, to append."""
    return finished.dropDuplicates(keys).join(archive.select(*keys), keys, "left_anti")


def carried_over(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows with the old row's values where it has them, as names given by hand are."""
    kept = old.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return new.join(kept, keys, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in new.columns])


def lifecycle(events: DataFrame) -> DataFrame:
    """Final state of each run from its log (run, seq, state, done, total): a terminal state stays, position within 0 and 1."""
    ended = F.col("state").isin("done", "failed")
    first_end = F.min(F.when(ended, F.struct("seq", "state")))
    n = events.groupBy("run").agg(first_end.alias("_e"), F.max(F.struct("seq", "state")).alias("_l"), F.max("done").alias("done"), F.max("total").alias("total"))
    position = F.when(F.col("total") > 0, F.least(F.greatest(F.col("done") / F.col("total"), F.lit(0.0)), F.lit(1.0)))
    return n.select("run", F.coalesce("_e.state", "_l.state").alias("state"), "done", "total", position.alias("position"))
