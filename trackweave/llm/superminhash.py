"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document is the set of hashes of its distinct word shingles; documents whose sets are equal
are one class, and what follows works on one document a class.

1. Every shingle draws a permutation of the ``bands * rows`` places of the signature, and a
   fraction for each place. It puts place j of its permutation at j plus the fraction; the
   signature keeps the least value of each place. As a shingle's ranks differ, the places of
   a signature are negatively correlated and estimate the Jaccard similarity with a lower
   variance than independent minima. A document's permutations are read only as far as a
   place of its signature could still become smaller: a long text is done after one step.
2. The hash of each band of ``rows`` places is a key. Documents that share keys meet
   (``meeting``), each copy group as one.
3. Where documents meet, pairs of two components whose signatures agree too seldom for the
   threshold are passed over; all others are compared by their whole sets. Links join their
   documents in a union-find forest, so a pair already connected isn't looked at again.

Two texts at the threshold share no band with a chance of (1 - t**rows)**bands: with
the standing 28 bands of 6 it is 2e-4 at 0.8, 2e-6 at 0.85, 6e-10 at 0.9. The filter of step 3 stands
``sigmas`` = 6 standard deviations below the threshold. No link below the threshold is ever made.

Two words differ when their bytes do after A-Z are lower-cased; sets compare 64-bit
shingle hashes. Null, empty and blank texts have the empty set and link with nothing; a row
with a null ``doc_id`` is returned with its size, a null component and is kept. Rows with the
same ``doc_id`` are one document for the components. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import HASHED, HashCache, dropped, mixed, portions, written
from trackweave.llm.meeting import Forest, components_by_meeting, named_components, shingles

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _drawn(hashes: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle at a step of its permutation: the fraction, and which of the places from ``step`` on it takes."""
    x = mixed(hashes + np.uint64((step + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(32)).astype(np.float64) / 2**32, step + (((x & _LOW) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """One SuperMinHash signature a set; infinite everywhere for an empty one."""
    out = np.full((len(sets), places), np.inf)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return out
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat = out.ravel()
    fraction, place = _drawn(hashes, 0, places)
    np.minimum.at(flat, owner * places + place, fraction)
    left = ~(out < 1).all(axis=1)[owner]
    hashes, owner, place = hashes[left], owner[left], place[left]
    order = np.tile(np.arange(places, dtype=np.uint16), (len(hashes), 1))
    at = np.arange(len(hashes))
    order[at, place], order[:, 0] = 0, place
    for step in range(1, places):
        if not len(hashes):
            break
        fraction, other = _drawn(hashes, step, places)
        place = order[at, other].astype(np.int64)
        order[at, other] = order[:, step]
        np.minimum.at(flat, owner * places + place, step + fraction)
        left = ~(out[owner] < step + 1).all(axis=1) if len(hashes) < 256 else ~(out < step + 1).all(axis=1)[owner]
        if not left.all():
            hashes, owner, order = hashes[left], owner[left], order[left]
            at = np.arange(len(hashes))
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    values = signature.view(np.uint64).reshape(len(signature), bands, -1)
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)[None].repeat(len(signature), axis=0)
    for r in range(values.shape[2]):
        key = mixed(key ^ values[:, :, r])
    return key


def banded(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), keys of its bands (none if empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            at = 0
            for texts in portions(batch.column(1), 1 << 20):
                sets = [shingles(t, k, cache) for t in texts]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = band_keys(signatures(sets, bands * rows), bands)[sizes > 0].ravel().view(np.int64)
                offsets = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, keys array<bigint>")


def verified_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, places: int, sigmas: float, known: list | None = None) -> list[tuple[int, int]]:
    """Links that join all linked sets of a place, a spanning forest of them; ``sides`` and ``known`` as where documents meet."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    seen = signatures(sets, places)
    t = num / den
    least = places * t - sigmas * sqrt(places * t * (1 - t))
    forest, links = Forest(len(sets)), []
    first: dict = {}
    for x, component in enumerate(known or []):
        if component is not None:
            forest.join(first.setdefault(component, x), x)
    for x in range(len(sets)):
        ys = np.arange(x + 1, len(sets))
        near = (forest.root[ys] != forest.root[x]) & (sides[ys] == (0, 2, 1)[sides[x]])
        near &= (den * np.minimum(sizes[ys], sizes[x]) >= num * np.maximum(sizes[ys], sizes[x])) & (sizes[ys] > 0)
        ys = ys[near]
        agreed = (seen[ys] == seen[x]).sum(axis=1)
        for y in ys[agreed >= least][np.argsort(-agreed[agreed >= least], kind="stable")]:
            if forest.root[x] == forest.root[y]:
                continue
            shared = sizes[x] + sizes[y] - len(np.union1d(sets[x], sets[y]))
            if den * shared >= num * (sizes[x] + sizes[y] - shared):
                forest.join(x, int(y))
                links.append((x, int(y)))
    return links


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, bands: int = 28, rows: int = 6, sigmas: float = 6.0, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; sets link when ``den * intersection >= num * union``."""
    docs = docs.select("doc_id", "text")
    sized = written(banded(docs, k, bands, rows))
    classes = written(sized.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    entries = sized.join(classes.hint(HASHED), ["digest", "doc_id"], "left_semi").select("doc_id", F.lit(0).cast("short").alias("class"), F.explode("keys").alias("key"))
    roots = components_by_meeting(docs, entries, lambda sets, sides, known: verified_links(sets, sides, num, den, bands * rows, sigmas, known), k=k, block=block)
    out = named_components(sized, classes, roots)
    dropped(roots, classes)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
