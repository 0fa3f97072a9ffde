"""Votes: tallies, margins, majorities and the gates built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import names


def tally(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Votes of each key and value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))


def leaders(votes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's leading value (ties: the smaller value), its votes, the runner-up's and the total.

    ``decisive``: the lead is at least 2 and a fifth of all votes. ``confirmed``: at least
    two votes and more than the runner-up.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), value)
    ranked = votes.withColumn("_rank", F.row_number().over(order))
    at = lambda r, c: F.max(F.when(F.col("_rank") == r, F.col(c)))
    out = ranked.groupBy(*keys).agg(at(1, value).alias("top_value"), at(1, "votes").alias("top_votes"), F.coalesce(at(2, "votes"), F.lit(0)).alias("second_votes"), F.sum("votes").alias("total_votes"))
    lead = F.col("top_votes") - F.col("second_votes")
    return out.withColumn("decisive", lead >= F.greatest(F.lit(2.0), 0.2 * F.col("total_votes"))).withColumn("confirmed", (F.col("top_votes") >= 2) & (lead > 0))


def agreement(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with their key's leading value and whether they agree with it."""
    top = leaders(tally(rows, keys, value), keys, value).select(*keys, "top_value")
    return rows.join(top, keys, "left").withColumn("agrees", F.coalesce(F.col(value) == F.col("top_value"), F.lit(False)))


def strongest_per_name(rows: DataFrame, name: list[str], strength: str, tie: str) -> DataFrame:
    """``demoted``: rows that share a name with a stronger one (ties: the smaller ``tie`` stays); ``duplicate_of`` names it."""
    w = Window.partitionBy(*name).orderBy(F.desc(strength), tie)
    rank = F.row_number().over(w)
    first = F.first(tie).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("demoted", rank > 1).withColumn("duplicate_of", F.when(rank > 1, first))


def mixed(votes: DataFrame, keys: list[str], value: str, least: int = 15) -> DataFrame:
    """Keys with many votes and no decisive leader."""
    found = leaders(votes, keys, value)
    return found.where((F.col("total_votes") >= least) & ~F.col("decisive")).select(*keys, "total_votes")


def club_of_cluster(confirmed: DataFrame, roster: DataFrame, margin: int = 2, keys: list[str] | None = None) -> DataFrame:
    """keys, cluster -> club for two clusters (0, 1) and the two clubs of a roster, from confirmed numbers.

    ``confirmed``: keys, cluster, number; ``roster``: club, number. Clusters are numbered anew for every
    key, a clip say, so each is mapped by itself. Each way round counts the numbers that it puts into
    their club; with a lead under ``margin`` there is no mapping.
    """
    keys = keys or []
    clubs = roster.select(F.min("club").alias("low"), F.max("club").alias("high"))
    hits = confirmed.join(roster.select("club", "number").distinct(), "number").crossJoin(F.broadcast(clubs))  # one row
    straight = F.sum(((F.col("cluster") == 0) == (F.col("club") == F.col("low"))).cast("int"))
    crossed = F.sum(((F.col("cluster") == 0) == (F.col("club") == F.col("high"))).cast("int"))
    way = hits.groupBy(*keys, "low", "high").agg(straight.alias("straight"), crossed.alias("crossed")).where(F.abs(F.col("straight") - F.col("crossed")) >= margin)
    keep = F.col("straight") >= F.col("crossed")
    pairs = F.array(F.struct(F.lit(0).alias("cluster"), F.when(keep, F.col("low")).otherwise(F.col("high")).alias("club")), F.struct(F.lit(1).alias("cluster"), F.when(keep, F.col("high")).otherwise(F.col("low")).alias("club")))
    return way.select(*keys, F.inline(pairs))


def club_by_number(tracks: DataFrame, numbers: DataFrame, roster: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``club`` of tracks whose colour vote is open but whose decisive number one club alone has.

    ``tracks``: keys (tid), club, colour_decisive; ``numbers``: keys, number, number_decisive.
    """
    keys = keys or ["tid"]
    owner = roster.groupBy("number").agg(F.count_distinct("club").alias("n"), F.min("club").alias("owner")).where("n = 1").drop("n")
    joined = tracks.join(numbers, keys, "left").join(owner, "number", "left")
    move = ~F.coalesce("colour_decisive", F.lit(False)) & F.coalesce("number_decisive", F.lit(False)) & F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("club"))
    return joined.select(*keys, F.when(move, F.col("owner")).otherwise(F.col("club")).alias("club"), move.alias("moved"))


def side_convention(players: DataFrame) -> DataFrame:
    """club and side (home, away) that keep most players' sides; only where there are exactly two clubs. A tie keeps the clubs' order.

    ``players``: club, side; rows without a club don't vote.
    """
    clubs = players.where("club is not null").groupBy("club", "side").count()
    ends = clubs.agg(F.min("club").alias("a"), F.max("club").alias("b"), F.count_distinct("club").alias("n")).where("n = 2")
    way = clubs.join(F.broadcast(ends))  # one row
    fits = (F.col("club") == F.col("a")) == (F.col("side") == "home")
    votes = way.groupBy("a", "b").agg((F.coalesce(F.sum(F.when(fits, F.col("count")).otherwise(-F.col("count"))), F.lit(0)) >= 0).alias("straight"))
    pair = lambda c, home: F.struct(F.col(c).alias("club"), F.when(home, "home").otherwise("away").alias("side"))
    return votes.select(F.inline(F.array(pair("a", F.col("straight")), pair("b", ~F.col("straight")))))


def split_identities(counts: DataFrame, keys: list[str], number: str, roster: DataFrame) -> DataFrame:
    """Keys whose two leading numbers are about as frequent though no roster has both and neither is a clipped reading of the other.

    Gives keys, first_number, second_number. ``counts``: keys, number, votes.
    """
    lead = leaders(counts, keys, number).where("not decisive").select(*keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), number))
    at = lambda r: F.max(F.when(F.col("_rank") == r, F.col(number)))
    two = counts.withColumn("_rank", rank).where("_rank <= 2").groupBy(*keys).agg(at(1).alias("first_number"), at(2).alias("second_number")).where("second_number is not null").join(lead, keys, "left_semi")
    has = roster.select("club", F.col("number")).distinct()
    both = has.toDF("club", "first_number").join(has.toDF("club", "second_number"), "club").select("first_number", "second_number").where("first_number <> second_number").distinct()
    clipped = names.clipped_reading(F.col("first_number"), F.col("second_number"))
    return two.join(both, ["first_number", "second_number"], "left_anti").where(~clipped).select(*keys, "first_number", "second_number")
