"""Corrections to identities and small lookups: updates by people, status changes, conflicts, registration edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrected_points(tracks: DataFrame, updates: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks with the number of their update (keys, number, and club or null); the name is that of the club's roster.

    The club is the update's, else the track's own. ``corrected`` marks changed tracks; an update whose number isn't in
    the roster changes nothing and is marked ``missing``.
    """
    new = updates.select(*keys, F.col("number").alias("_number"), F.col("club").alias("_club"), F.lit(True).alias("_update"))
    held = tracks.join(new, keys, "left").withColumn("_club", F.coalesce("_club", "club"))
    names = roster.select(F.col("club").alias("_club"), F.col("number").alias("_number"), F.col("name").alias("_name"))
    found = held.join(names, ["_club", "_number"], "left")
    ok = F.col("_update") & F.col("_name").isNotNull()
    pick = lambda a, b: F.when(ok, F.col(a)).otherwise(F.col(b)).alias(b)
    rest = [c for c in tracks.columns if c not in ("number", "name", "club")]
    missing = F.coalesce(F.col("_update") & F.col("_name").isNull(), F.lit(False))
    return found.select(*rest, pick("_number", "number"), pick("_name", "name"), pick("_club", "club"), F.coalesce(ok, F.lit(False)).alias("corrected"), missing.alias("missing"))


def review_status(action: Column, read_number: Column, tid: Column) -> tuple[Column, Column]:
    """Status and label of a track after its last review action; without one, or after ``unassign``, its read number or T and its id."""
    state = F.when(action == "assign", "human").when(action == "ignore", "ignored").otherwise(F.when(read_number.isNotNull(), "number-only").otherwise("anonymous"))
    return state, F.coalesce(read_number.cast("string"), F.concat(F.lit("T"), tid.cast("string")))


def kept_identities(rows: DataFrame, state: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the pipeline may overwrite, and those that a person has settled (human or ignored)."""
    settled = F.coalesce(F.col(state).isin("human", "ignored"), F.lit(False))
    return rows.where(~settled), rows.where(settled)


def unfinished(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.where(~F.coalesce(F.col(state).isin("done", "failed"), F.lit(False)))


def would_conflict(tracks: DataFrame, proposal: DataFrame, keys: list[str], tid: str, name: str, start: str, end: str) -> DataFrame:
    """Proposals (keys, tid, name) whose name another track of the keys has at the same time."""
    life = tracks.select(*keys, F.col(tid).alias("_tid"), F.col(name).alias(name), F.col(start).alias("_start"), F.col(end).alias("_end"))
    own = proposal.join(tracks.select(*keys, tid, F.col(start).alias("_a"), F.col(end).alias("_b")), [*keys, tid])
    hit = [own[k] == life[k] for k in [*keys, name]] + [F.col("_tid") != own[tid], F.col("_start") <= F.col("_b"), F.col("_end") >= F.col("_a")]
    return own.join(life, hit, "left_semi").drop("_a", "_b")


def with_totals(jobs: DataFrame, hints: DataFrame, job: str) -> DataFrame:
    """Jobs whose missing total comes from the hints (job, total)."""
    return jobs.join(hints.select(job, F.col("total").alias("_hint")), job, "left").withColumn("total", F.coalesce("total", "_hint")).drop("_hint")


def looked_up(live: DataFrame, history: DataFrame, *, job: str | None = None, run: str | None = None, limit: int = 400) -> DataFrame:
    """One run: by run id if given, else the first of a job, live ones before the newest ``limit`` archived (job, run, started)."""
    newest = history.orderBy(F.desc("started"), F.desc("run")).limit(limit)
    both = live.withColumn("_old", F.lit(0)).unionByName(newest.withColumn("_old", F.lit(1)))
    wanted = F.col("run") == run if run is not None else F.col("job") == job
    return both.where(wanted).orderBy("_old", F.desc("started"), F.desc("run")).limit(1).drop("_old")


def remapped(boxes: DataFrame, label: str, classes: list) -> DataFrame:
    """``index`` of each label among ``classes``; -1 for others."""
    return boxes.withColumn("index", F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1)


def by_basename(left: DataFrame, path: str, right: DataFrame, other: str) -> DataFrame:
    """Each left row with the first (by path) right row whose path has the same last part."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    first = right.groupBy(base(other).alias("_base")).agg(F.min(other).alias("match"))
    return left.withColumn("_base", base(path)).join(first, "_base", "left").drop("_base")


def registration_edges(pairs: DataFrame, a: str = "a", b: str = "b", *, inliers: int = 25, overlap: float = 0.30) -> DataFrame:
    """Both directions of the pairs that register well."""
    good = pairs.where((F.col("inliers") >= inliers) & (F.col("overlap") >= overlap)).select(a, b)
    return good.union(good.select(b, a)).distinct()


def link_kind(inliers: Column, overlap: Column, chained: Column) -> Column:
    """How a frame is registered: directly, through the frame before, or not at all."""
    return F.when((inliers >= 25) & (overlap >= 0.30), "direct").when(chained >= 25, "chained").otherwise("failed")


def reaches_all(reach: Column, wanted: Column) -> Column:
    """Whether a coverage set has all of another."""
    return F.size(F.array_except(wanted, reach)) == 0


def artefact_pair(stem: Column) -> Column:
    """Names of the report and the film of a run."""
    return F.struct(F.concat(stem, F.lit("_report.json")).alias("report"), F.concat(stem, F.lit("_final.mp4")).alias("film"))


def usable_cache(meta: DataFrame, equal: dict[str, object], at_most: dict[str, float] | None = None) -> DataFrame:
    """Cache files whose metadata equals what is asked for (video, frames, every, version) and whose thresholds do not exceed theirs."""
    ok = F.lit(True)
    for c, v in equal.items():
        ok &= F.col(c).eqNullSafe(F.lit(v))
    for c, v in (at_most or {}).items():
        ok &= F.coalesce(F.col(c) <= v + 1e-9, F.lit(False))
    return meta.where(ok)


def newest_runs(runs: DataFrame, limit: int = 400) -> DataFrame:
    """The history's newest runs by file name, then start."""
    return runs.orderBy(F.desc("file"), F.desc("started")).limit(limit)
