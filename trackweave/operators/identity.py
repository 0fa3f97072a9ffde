"""Identity of tracks from reads, kit votes and a roster: the ordered chain of votes, merges, gates and assignment.

The order of the steps matters, as each gate sees what the earlier ones left; every step
is one of the operators of this package. Only the tracklet merge and the assignment run
group kernels, on groups as small as a club's roster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import assign, fusion, spans, votes


def overlaps(tracks: DataFrame, fps: float = 59.94, least: float = 0.75) -> DataFrame:
    """clip, first_name, second_name, start, end, kind of tracks that sit on one another for a second or more."""
    gap, length = max(1, round(0.5 * fps)), max(1, round(fps))
    pairs = fusion.overlapping_in_frame(tracks, ["clip", "frame"], "tid", least)
    found = spans.islands(pairs, ["clip", "first_name", "second_name"], "frame", gap, length)
    life = spans.lifetimes(tracks, ["clip", "tid"], "frame").withColumn("life", F.col("last_at") - F.col("first_at") + 1)
    a = life.select("clip", F.col("tid").alias("first_name"), F.col("life").alias("_a"))
    b = life.select("clip", F.col("tid").alias("second_name"), F.col("life").alias("_b"))
    joined = found.join(a, ["clip", "first_name"]).join(b, ["clip", "second_name"]).withColumn("shorter", F.least("_a", "_b"))
    return spans.overlap_kind(joined).select("clip", "first_name", "second_name", "start", "end", "kind")


def collapse_spans(found: DataFrame) -> DataFrame:
    """clip, tid, start, end: coalesced collapse spans of both tracks of a pair."""
    c = found.where("kind = 'collapse'")
    both = c.select("clip", F.col("first_name").alias("tid"), "start", "end").unionByName(c.select("clip", F.col("second_name").alias("tid"), "start", "end"))
    return spans.coalesced(both, ["clip", "tid"]).drop("n_spans")


def cut(step: DataFrame) -> DataFrame:
    """A step of the chain kept in the checkpoint folder, as several later ones read it; without a folder it is kept by the executors."""
    return step.checkpoint() if step.sparkSession.sparkContext.getCheckpointDir() else step.persist()


def canonical(rows: DataFrame, alias: DataFrame, tid: str = "tid") -> DataFrame:
    """``rows`` under the track that theirs was merged into."""
    to = alias.select("clip", F.col("tid").alias(tid), F.col("canonical").alias("_canonical"))
    return rows.join(to, ["clip", tid], "left").withColumn(tid, F.coalesce("_canonical", tid)).drop("_canonical")


def merged_pairs(found: DataFrame, alias: DataFrame, total: DataFrame) -> DataFrame:
    """clip, first_name, second_name, first_votes, second_votes of the duplicate pairs after the merge, the smaller id first."""
    pairs = canonical(canonical(found.where("kind = 'duplicate'").select("clip", "first_name", "second_name"), alias, "first_name"), alias, "second_name")
    pairs = pairs.select("clip", F.least("first_name", "second_name").alias("first_name"), F.greatest("first_name", "second_name").alias("second_name")).where("first_name <> second_name").distinct()
    strength = lambda side: total.select("clip", F.col("tid").alias(f"{side}_name"), F.col("votes").alias(f"{side}_votes"))
    return pairs.join(strength("first"), ["clip", "first_name"], "left").join(strength("second"), ["clip", "second_name"], "left").na.fill(0, ["first_votes", "second_votes"])


def resolved(tracks: DataFrame, reads: DataFrame, kit_crops: DataFrame, roster: DataFrame, *, fps: float = 59.94, least: int = 3, merge_least: int = 5, merge_overlap: int = 15, most_collapsed: float = 0.5) -> dict[str, DataFrame]:
    """identities, overlaps, collapse, retired, unvouched, mixed and clubs (clip, cluster, club) of every clip.

    ``reads``: clip, frame, tid, value; ``kit_crops``: clip, frame, tid, cluster, where each
    clip numbers its clusters by itself; ``roster``: club, number, name, of two clubs. A clip
    whose clusters can't be told apart by their numbers has no clubs and names no track.
    """
    key = ["clip", "tid"]
    found = cut(overlaps(tracks, fps))
    collapse = collapse_spans(found)
    clean = spans.outside(reads.where(F.trim("value").rlike("^[0-9]+$")), collapse, key, "frame")
    number = cut(votes.tally(clean, key, "value"))
    kit = cut(votes.tally(kit_crops, key, "cluster"))
    life = cut(spans.lifetimes(tracks, key, "frame").select(*key, "first_at", "last_at"))

    # Merge: votes, lives, collapse spans and duplicate pairs follow their track.
    top = votes.leaders(number, key, "value")
    colour = votes.leaders(kit, key, "cluster").select(*key, F.when(F.col("decisive"), F.col("top_value")).cast("double").alias("kit"))
    strong = top.join(life, key).join(colour, key, "left")
    columns = {"tid": "tid", "votes": "top_votes", "total": "total_votes", "start": "first_at", "end": "last_at"}
    strong = strong.select("clip", F.col("top_value").alias("number"), *[F.col(c).cast("long").alias(n) for n, c in columns.items()], "kit")
    alias = cut(assign.tracklet_merges(strong, "clip", merge_overlap, merge_least))
    number = cut(canonical(number, alias).groupBy(*key, "value").agg(F.sum("votes").alias("votes")))
    kit = cut(canonical(kit, alias).groupBy(*key, "cluster").agg(F.sum("votes").alias("votes")))
    life = canonical(life, alias).groupBy(*key).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    held = canonical(collapse, alias)
    total = number.groupBy(*key).agg(F.sum("votes").alias("votes"))

    # Gates: the weaker of duplicate tracks, tracks that are mostly collapsed, tracks in two kits.
    retired = cut(assign.retired_in_order(merged_pairs(found, alias, total), "clip"))
    unvouched = cut(spans.covered_share(held, life, key).where(F.col("share") > most_collapsed).select(*key, "share").join(retired, key, "left_anti"))
    gone = retired.select(*key).unionByName(unvouched.select(*key))
    standing = number.join(gone, key, "left_anti")
    colours = votes.leaders(kit, key, "cluster")
    mixed = cut(votes.mixed(kit, key, "cluster").join(gone, key, "left_anti").select(*key))
    live = cut(standing.join(mixed, key, "left_anti"))

    # Clubs, clip by clip: by kit cluster, and by number where the kit is open and one club alone has it.
    sides = colours.select(*key, F.col("top_value").alias("cluster"), F.col("decisive").alias("colour_decisive"))
    confirmed = votes.leaders(standing, key, "value").where("confirmed").join(sides, key)
    clubs = cut(votes.club_of_cluster(confirmed.select("clip", "cluster", F.col("top_value").alias("number")), roster, keys=["clip"]))
    tracks_of = live.select(*key).distinct().join(sides, key, "left").join(clubs, ["clip", "cluster"], "left")
    numbers = votes.leaders(live, key, "value").select(*key, F.col("top_value").alias("number"), F.col("decisive").alias("number_decisive"))
    mapped = numbers.join(clubs, "clip", "left_semi")  # where clusters have no club, no track is moved to one
    placed = votes.club_by_number(tracks_of.select(*key, "club", "colour_decisive"), mapped, roster, key)

    named = live.withColumnRenamed("value", "number").join(placed, key).join(roster, ["club", "number"])
    pairs = cut(assign.assigned(named.select("clip", "club", "tid", "number", F.col("votes").cast("double").alias("votes")), ["clip", "club"], "tid", "number", "votes", least))
    own = pairs.join(roster, ["club", "number"], "left").withColumn("tid", F.col("tid").cast("long"))

    # Gates on names: the strongest of those who share one, and nobody who reads as two players.
    own = votes.strongest_per_name(own.join(total.select(*key, F.col("votes").alias("_total")), key, "left"), ["clip", "club", "number"], "_total", "tid")
    split = votes.split_identities(live.withColumnRenamed("value", "number"), key, "number", roster).select(*key, F.lit(True).alias("_split"))
    own = own.join(split, key, "left")
    nameless = F.col("demoted") | F.coalesce("_split", F.lit(False))
    ignored = F.when(~F.col("demoted") & F.col("_split"), "split-identity").when(~F.col("confirmed"), "tentative")
    own = own.select("clip", "tid", "number", "club", F.when(~nameless, F.col("name")).alias("name"), ignored.alias("ignored"), F.lit(None).cast("long").alias("merged_into"), "duplicate_of", "votes")
    copies = alias.join(own.withColumnRenamed("tid", "canonical"), ["clip", "canonical"])
    copies = copies.select("clip", "tid", "number", "club", "name", "ignored", F.col("canonical").alias("merged_into"), "duplicate_of", "votes")
    return {"identities": own.unionByName(copies), "overlaps": found, "collapse": held, "retired": retired, "unvouched": unvouched, "mixed": mixed, "clubs": clubs}
