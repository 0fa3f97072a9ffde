"""Where documents that share keys meet, so that all links between them are found.

A key (a rare shingle, a band of a signature) brings documents together. Documents that
share keys, directly or by others, are one family; each key gives edges to its smallest
document only, so a key of m documents gives m edges, not m * m.

The documents of a family of up to ``block`` meet in one place. Those of a larger one meet
the smallest document of each of their keys first, which makes one component of most near
copies in linear work. What is left are pairs across components. Documents meet again for
these, by family or by key, whichever sends fewer texts; only a group's documents outside
its largest component are dealt to the blocks of all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import BROADCAST_ROWS, HASHED, HashCache, dropped, groups, joined_hot, window_hashes, word_hashes, written
from trackweave.llm.components import connected_components

#: Finds the links of a place: sets, sides (0 meets 0, 1 meets 2), known components -> pairs of places in the list.
Links = Callable[[list[np.ndarray], np.ndarray, list], list[tuple[int, int]]]


def shingles(text: str | None, k: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of all words together if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    units = word_hashes(words, cache)
    return np.unique(window_hashes(units, min(k, len(units))))


def needed(n: int, num: int, den: int) -> int:
    """Least overlap that a set of ``n`` has with any set it links with."""
    return -(-num * n // den)


class Forest:
    """Union-find over the documents of one block."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = self.root[a], self.root[b]
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.root[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


def open_groups(members: DataFrame, block: int, *also: str) -> DataFrame:
    """Groups of members(g, doc_id, comp) with documents of several components: g, n, main (its largest component), others (documents outside that), cost (texts sent)."""
    each = members.groupBy("g", "comp", *also).agg(F.count("*").alias("n"))
    found = each.groupBy("g", *also).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    found = found.select("g", *also, "n", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.n")).alias("others"))
    mains, rest = F.ceil(F.col("n") / block - F.col("others") / block), F.ceil(F.col("others") / block)
    return found.withColumn("cost", F.when(F.col("n") <= block, F.col("n")).otherwise((F.col("n") - F.col("others")) * rest + F.col("others") * (mains + rest)))


def meeting_places(members: DataFrame, block: int) -> DataFrame:
    """place, doc_id, side, comp for members joined to their open group."""
    mains, rest = F.ceil((F.col("n") - F.col("others")) / block), F.ceil(F.col("others") / block)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda kind, i, j, side: F.struct(F.xxhash64("g", F.lit(kind), i, j).alias("place"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("comp") == F.col("main"), mains).otherwise(rest))
    members = members.withColumn("mine", mine)
    across = F.transform(upto(mains), lambda j: spot("main", j, F.col("mine"), 2))
    among = F.transform(upto(rest), lambda i: spot("rest", F.least("mine", i), F.greatest("mine", i), F.when(i == F.col("mine"), 0).when(F.col("mine") < i, 1).otherwise(2)))
    one = F.array(spot("all", F.lit(0).cast("long"), F.lit(0).cast("long"), 0))
    spots = F.when(F.col("n") <= block, one).when(F.col("comp") == F.col("main"), F.transform(upto(rest), lambda i: spot("main", F.col("mine"), i, 1))).otherwise(F.concat(across, among))
    return members.select("doc_id", "comp", F.explode(spots).alias("s")).select("s.place", "doc_id", "s.side", "comp")


def components_by_meeting(docs: DataFrame, entries: DataFrame, found: Links, *, k: int, block: int) -> DataFrame:
    """node, root of every document with a link; root is the smallest of its component.

    ``docs``: doc_id, text; ``entries``: doc_id, class, key, one row for each key of a
    document, where a document is another node in each class; ``found`` looks for the links
    among the ``k``-word shingle sets of a place.
    """
    # One shuffle of all entries serves both the keys' smallest documents and the join with them; keys of one document end here.
    dealt = entries.repartition("key")
    hubs = dealt.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub <> far").drop("far")
    shared = written(dealt.join(hubs.hint(HASHED), "key").select("key", "doc_id", "class", "hub"))
    near = written(shared.where("doc_id <> hub").select(F.struct("doc_id", "class").alias("a"), F.struct(F.col("hub").alias("doc_id"), "class").alias("b")).distinct())
    families = connected_components(near)
    counted = written(families.groupBy("root").agg(F.count("*").alias("n")))
    placed = written(joined_hot(families, counted, "root"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for _, held in groups(batches, "place"):
            table = pa.Table.from_batches(held)
            ids, sides = table["doc_id"].to_pylist(), table["side"].to_numpy()
            sets = [shingles(t.as_py(), k, cache) for t in table["text"]]
            links = found(sets, sides, table["comp"].to_pylist())
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in side], table.schema.field("doc_id").type) for side in zip(*links)], names=["a", "b"])

    def links_at(met: DataFrame) -> DataFrame:
        few = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met  # beyond that the texts are shuffled to it
        spots = docs.where("doc_id is not null").join(few, "doc_id").select("place", "doc_id", "side", "comp", "text")
        return spots.repartition("place").sortWithinPartitions("place", "doc_id").mapInArrow(search, f"a {kind}, b {kind}")

    met = placed.where(F.col("n") <= block).select(F.xxhash64("root").alias("place"), "node.doc_id", F.lit(0).alias("side"))
    large = placed.where(F.col("n") > block).select("node", "root")
    any_large = not large.isEmpty()
    if any_large:
        stars = written(near.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
        rays = written(stars.groupBy("b").agg(F.count("*").alias("n")))
        parts = F.ceil(F.col("n") / block)
        ends = joined_hot(stars, rays, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), parts)).alias("place"), "a.doc_id", F.lit(2).alias("side"))
        hearts = rays.select("b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).select(F.xxhash64("b", "part").alias("place"), "b.doc_id", F.lit(1).alias("side"))
        met = met.unionByName(ends).unionByName(hearts)
    met = written(met.withColumn("comp", F.lit(None).cast(kind)))
    roots = connected_components(links_at(met))
    if any_large:
        inside = large.select("node.doc_id", "node.class", "root")
        held = shared.join(inside, ["doc_id", "class"]).join(roots.toDF("doc_id", "comp"), "doc_id", "left")
        held = written(held.select(F.col("key").alias("g"), "doc_id", F.coalesce("comp", "doc_id").alias("comp"), F.xxhash64("root").alias("family")))
        whole = written(held.select(F.col("family").alias("g"), "doc_id", "comp").distinct())
        by_family, by_key = written(open_groups(whole, block)), written(open_groups(held, block, "family"))
        costs = by_key.groupBy(F.col("family").alias("g")).agg(F.sum("cost").alias("by_key"))
        dearer = written(by_family.join(costs, "g", "left").where(F.coalesce("by_key", F.lit(0)) < F.col("cost")).select("g"))
        again = meeting_places(joined_hot(whole, by_family.join(dearer, "g", "left_anti"), "g"), block)
        at_keys = joined_hot(held.drop("family"), by_key.join(dearer.toDF("family"), "family", "left_semi").drop("family"), "g")
        met_again = written(again.unionByName(meeting_places(at_keys, block)))
        earlier = roots
        roots = connected_components(links_at(met_again).unionByName(earlier.toDF("a", "b")))
        dropped(stars, rays, held, whole, by_family, by_key, dearer, met_again, earlier)
    dropped(shared, near, families, counted, placed, met)
    return roots


def named_components(sized: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``sized``(doc_id, n_shingles, digest).

    ``classes``(digest, doc_id, n): the smallest document of each set and its rows; rows without a set or an id are their own component.
    """
    class_root = classes.join(roots.toDF("doc_id", "root"), "doc_id", "left").select("digest", "n", F.coalesce("root", "doc_id").alias("component_id"))
    class_root = written(class_root)
    named = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    rows = sized.select("doc_id", "n_shingles", "digest")
    out = joined_hot(rows.where(named), class_root, "digest").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where(~named).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
