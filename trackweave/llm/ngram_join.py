"""Exact n-gram Jaccard self-join by T-occurrence search.

A document is the set of hashes of its distinct word shingles. Documents whose sets are
equal are one class; what follows works on one document a class.

1. A fixed-size sketch of shingle counts over the whole table orders all shingles, rare
   ones first. By the prefix principle two linked sets share a shingle of both prefixes.
2. Linked sets differ in size by the threshold's factor at most, so each document stands
   in the size class it falls into and in the next. Documents of a class that share prefix
   shingles, directly or by others, are one family (connected components; each shingle's
   list gives edges to its smallest document only, so a list of m documents gives m edges,
   not m * m).
3. A family is searched where its documents meet: inverted lists over the shingles there,
   and for each query the DivideSkip split of its lists: the short ones are merged on a
   heap, and what survives is looked up in the long ones by binary search until it reaches
   the needed overlap or cannot. A candidate that is already in the query's component is
   not looked at again.
4. The documents of a family of more than ``block`` meet the smallest document of each
   of their prefix shingles first, which makes one component of most near copies in linear
   work. What is left are pairs across components. Documents meet again for these, by family
   or by prefix shingle, whichever sends fewer texts; only a group's documents outside its
   largest component are dealt to the blocks of all others.
5. The links found make the classes' components.

Two words differ when their bytes do after A-Z are lower-cased; sets compare 64-bit
shingle hashes. Null, empty and blank texts have the empty set and link with nothing; a
null ``doc_id`` row is returned with its size and a null component. Rows with the same
``doc_id`` are one document for the components. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import HASHED, HashCache, cells_batch, dropped, summed_cells, written
from trackweave.llm.meeting import Forest, components_by_meeting, named_components, needed, shingles


def count_ranks(docs: DataFrame, k: int, bits: int) -> bytes:
    """One byte for each of ``2**bits`` cells: how frequent the shingles that fall into it are, on a log scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cache, mask = np.zeros(1 << bits, dtype=np.uint32), HashCache(), np.uint64((1 << bits) - 1)
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), k, cache)
                np.add.at(cells, (s & mask).astype(np.int64), 1)
        yield cells_batch(cells)

    total = summed_cells(docs.mapInArrow(count, "part int, counts binary"), 1 << bits)
    return np.minimum(255, np.log2(total + 1) * 8).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, ranks: bytes, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), prefix: the rarest shingles that any linked set must meet."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cache = np.frombuffer(shared.value, dtype=np.uint8), HashCache()
        mask = np.uint64(len(rank) - 1)
        for batch in batches:
            sizes, digests, heads = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k, cache)
                n = len(s)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                take = n - needed(n, num, den) + 1 if n else 0
                order = np.lexsort((s, rank[(s & mask).astype(np.int64)]))[:take]
                heads.append(s[order].view(np.int64))
            flat = pa.array(np.concatenate(heads) if heads else [], pa.int64())
            offsets = pa.array(np.r_[0, np.cumsum([len(h) for h in heads])], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n_shingles", "digest", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, prefix array<bigint>")


def t_occurrence_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links that join all linked sets of a block, a spanning forest of them.

    ``sides``: 0 meets 0, 1 meets 2; so a pair of blocks compares across only. ``known``:
    the component each set is in already, if any; sets of one component are not compared.
    """
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    lengths = np.diff(np.r_[starts, len(values)])
    list_of = np.repeat(np.arange(len(starts)), lengths)
    shared = np.repeat(lengths > 1, lengths)  # a list of one finds nothing
    by_owner = np.argsort(owners[shared], kind="stable")
    mine = np.split(list_of[shared][by_owner], np.cumsum(np.bincount(owners[shared], minlength=len(sets)))[:-1])
    forest, links = Forest(len(sets)), []
    first: dict = {}
    for x, component in enumerate(known or []):
        if component is not None:
            forest.join(first.setdefault(component, x), x)
    for x, lists in enumerate(mine):
        nx = sizes[x]
        # The least overlap for the smallest partner; a larger one needs more.
        least = needed(nx + needed(nx, num, den), num, num + den)
        if len(lists) < least:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        longest = int(lengths[lists[-1]])
        n_long = min(least - 1, int(least / (0.0085 * log2(longest) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        heads = []
        for i in short:
            c = owners[starts[i] : starts[i] + lengths[i]]
            c = c[(c > x) & (forest.root[c] != forest.root[x]) & (sides[c] == (0, 2, 1)[sides[x]])]
            if len(c):
                heads.append(c.tolist())
        if not heads:
            continue
        probes = None
        merged = heapq.merge(*heads)
        y, count = next(merged), 1
        while y is not None:
            z = next(merged, None)
            if z == y:
                count += 1
                continue
            ny = sizes[y]
            enough = needed(nx + ny, num, num + den)
            if min(nx, ny) >= enough and count + n_long >= enough and forest.root[y] != forest.root[x]:
                if probes is None:
                    probes = [owners[starts[i] : starts[i] + lengths[i]].tolist() for i in long]
                left = n_long
                for p in probes:
                    if count >= enough or count + left < enough:
                        break
                    at = bisect_left(p, y)
                    count += at < len(p) and p[at] == y
                    left -= 1
                if count >= enough:
                    forest.join(x, y)
                    links.append((x, y))
            y, count = z, 1
    return links


def jaccard_components(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100, block: int = 1024, sketch_bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link when ``den * intersection >= num * union``.

    ``block``: documents of a family that meet in one place; ``sketch_bits``: log2 of the
    count cells (default by table size, 16 to 24, so what is broadcast stays under 16 MB).
    """
    docs = docs.select("doc_id", "text")
    bits = sketch_bits or min(24, max(16, ceil(log2(docs.select("doc_id").count() + 1)) + 5))
    sized = written(prefixes(docs, count_ranks(docs.select("text"), k, bits), k, num, den))
    classes = written(sized.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    # Classes a little wider than the threshold's factor, so rounding cannot part a link.
    size_class = F.floor(F.log("n_shingles") / F.lit(max(log(den / num), 1e-3) * (1 + 1e-6))).cast("int")
    # The smaller of a linked pair overlaps by 2t/(1+t) of its size, so in the next class a shorter prefix is enough.
    shorter = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(2 * num / (num + den)) - 1e-6) + 1).cast("int")
    roles = F.array(F.struct(size_class.alias("class"), F.col("prefix")), F.struct((size_class + 1).alias("class"), F.slice("prefix", 1, F.greatest(shorter, F.lit(1))).alias("prefix")))
    entries = sized.join(classes.hint(HASHED), ["digest", "doc_id"], "left_semi").select("doc_id", F.inline(roles))
    entries = entries.select("doc_id", F.col("class").cast("short"), F.explode("prefix").alias("shingle")).select("doc_id", "class", F.xxhash64("shingle", "class").alias("key"))
    roots = components_by_meeting(docs, entries, lambda sets, sides, known: t_occurrence_links(sets, sides, num, den, known), k=k, block=block)
    out = named_components(sized, classes, roots)
    dropped(roots, classes)
    return out
