"""Substring de-duplication on words by compaction of a de Bruijn graph.

Every run of ``width`` words is an edge from its first ``width - 1`` words to its last.
Only edges whose anchor another document has too are looked at; of these, the ones found
in two documents or more stay. Where a node has one edge in and one out, and both come
from neighbouring places of the same source document (the smallest that has them), they
are one path; joins and a running maximum compact all such edges to paths with source
coordinates. What a document has of a path from a smaller source, at one distance and
without a gap, is one repeated span. Its words are compared with those at its source
coordinates, and the words of all spans that agree go. A span that doesn't agree has edges
whose hash stands for different words; all windows with such a hash are compared by their words instead.

Exact copies of a document with a smaller id are found first by their digests: all their
words go, if they have ``width`` of them, and they need no edges.

A word is a run of bytes other than ASCII white space, compared unchanged. Windows do not cross documents; repeats inside one document stay. Null and
empty texts have no words. A null ``doc_id`` row is returned with nothing removed and is
no source; rows with the same id are judged each by itself against smaller ids, equal ones
alike: inside, a row is named by its id and a ``version``, the digest of its text. Extra
columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.anchors import distinct_rows, exact_copies, repeated_anchors, repeated_ids, window_anchors, with_version, without
from trackweave.llm.common import HASHED, binary_texts, dropped, longer, mixed, raw_hashes, window_hashes, word_units, written

ANCHOR_WORDS = 5
#: End of a span that takes all of its document.
WHOLE = 2**31 - 1


def anchors_of(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    k = min(ANCHOR_WORDS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(window_anchors(window_hashes(units, k), width - k + 1)) for units in word_units(batch.column(2))]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), *[batch.column(c).take(pa.array(owner)) for c in (0, 1)]], names=["anchor", "doc_id", "version"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, f"anchor bigint, doc_id {kind}, version binary")


def occurrences(docs: DataFrame, repeated: DataFrame, width: int, hash_bits: int = 64) -> DataFrame:
    """edge, source, target, doc_id, version, at: windows whose anchor is repeated, and the hashes of their first and last words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    k = min(ANCHOR_WORDS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, froms, tos, places, owner = [], [], [], [], []
            for i, (units, anchors) in enumerate(zip(word_units(batch.column(2)), batch.column(3))):
                wanted = np.unique(anchors.values.to_numpy(zero_copy_only=False).view(np.uint64))
                of_window = window_anchors(window_hashes(units, k), width - k + 1)
                at = np.flatnonzero(np.isin(of_window, wanted))
                if len(at):
                    raw = raw_hashes(units, width - 1)
                    froms.append(mixed(raw[at]))
                    tos.append(mixed(raw[at + 1]))
                    edges.append(mixed(longer(raw, units, width - 1)[at]) >> np.uint64(64 - hash_bits))
                    places.append(at)
                    owner.append(np.full(len(at), i))
            if edges:
                cols = [pa.array(np.concatenate(c).view(np.int64)) for c in (edges, froms, tos)]
                rows = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([*cols, batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(places), pa.int32())], names=["edge", "source", "target", "doc_id", "version", "at"])

    rows = docs.join(repeated.hint(HASHED), ["doc_id", "version"]).select("doc_id", "version", "text", "anchors")
    return rows.mapInArrow(run, f"edge bigint, source bigint, target bigint, doc_id {kind}, version binary, at int")


def compacted(edges: DataFrame) -> DataFrame:
    """edge, first_doc, first_version, first_at, path_at: every repeated edge with its source coordinates and where its path begins there.

    ``edges``: edge, source, target, first_doc, first_version, first_at.
    """
    # With a count of one the least of each column is that edge's; versions are compared by hash, which leaves the sums to hash tables.
    ends = edges.select("edge", "source", "target", "first_doc", F.xxhash64("first_version").alias("v"), "first_at")
    alone = lambda node, name: ends.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), *[F.min(c).alias(f"{name}_{c}") for c in ("edge", "first_doc", "v", "first_at")]).where("n = 1").drop("n")
    through = alone("source", "out").join(alone("target", "into").hint(HASHED), "node")
    joined = through.where("into_first_doc = out_first_doc and into_v = out_v and into_first_at + 1 = out_first_at").select(F.col("out_edge").alias("edge"), F.lit(True).alias("joined"))
    placed = edges.select("edge", "first_doc", "first_version", "first_at").join(joined.hint(HASHED), "edge", "left")
    along = Window.partitionBy("first_doc", "first_version").orderBy("first_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("path_at", F.max(F.when(F.col("joined").isNull(), F.col("first_at"))).over(along)).drop("joined")


def span_digests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, version, at, words, digest: once the 128-bit digest of each wanted stretch of words; ``wanted``: doc_id, version, at, words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, counts, found = [], [], [], []
            for i, (text, stretches) in enumerate(zip(binary_texts(batch.column(2)), batch.column(3))):
                words = text.as_py().split()
                for s in stretches.as_py():
                    rows.append(i)
                    places.append(s["at"])
                    counts.append(s["words"])
                    found.append(xxhash.xxh3_128_digest(b" ".join(words[s["at"] : s["at"] + s["words"]])))
            owner = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(owner) for c in (0, 1)], pa.array(places, pa.int32()), pa.array(counts, pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "version", "at", "words", "digest"])

    listed = wanted.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "words")).alias("stretches"))
    rows = docs.join(listed.hint(HASHED), ["doc_id", "version"]).select("doc_id", "version", "text", "stretches")
    return rows.mapInArrow(run, f"doc_id {kind}, version binary, at int, words int, digest binary")


def checked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` and ``same``: whether their words are those at their source coordinates; a written table."""
    words = F.col("end") - F.col("start")
    here = spans.select("doc_id", "version", F.col("start").alias("at"), words.alias("words"))
    there = spans.select(F.col("first_doc").alias("doc_id"), F.col("first_version").alias("version"), F.col("first_at").alias("at"), words.alias("words"))
    digests = written(span_digests(docs, here.union(there)))
    own = digests.select("doc_id", "version", F.col("at").alias("start"), (F.col("at") + F.col("words")).alias("end"), F.col("digest").alias("own"))
    source = digests.select(F.col("doc_id").alias("first_doc"), F.col("version").alias("first_version"), F.col("at").alias("first_at"), "words", "digest")
    both = spans.withColumn("words", words).join(own.hint(HASHED), ["doc_id", "version", "start", "end"]).join(source.hint(HASHED), ["first_doc", "first_version", "first_at", "words"])
    return written(both.select(*spans.columns, (F.col("own") == F.col("digest")).alias("same")))


def told_by_words(docs: DataFrame, shared: DataFrame, failed: DataFrame, width: int) -> DataFrame:
    """doc_id, version, start, end of the repeated windows among all that share an edge hash with a window of the ``failed`` spans.

    Their hashes belong to different words, so the words themselves are compared, by 128-bit digests.
    """
    ranges = failed.select("doc_id", "version", "start", "end")
    mixed_up = shared.join(ranges, ["doc_id", "version"]).where((F.col("at") >= F.col("start")) & (F.col("at") + width <= F.col("end"))).select("edge").distinct()
    places = shared.join(mixed_up, "edge", "left_semi").select("doc_id", "version", "at", F.lit(width).alias("words"))
    found = written(span_digests(docs, places))
    low = found.groupBy("digest").agg(F.min("doc_id").alias("low"))
    return found.join(low, "digest").where("doc_id > low").select("doc_id", "version", F.col("at").alias("start"), (F.col("at") + width).alias("end"))


def repeated_spans(docs: DataFrame, *, width: int = 13, hash_bits: int = 64) -> DataFrame:
    """doc_id, version, start, end (words, end excluded), first_doc, first_at, path_at: every repeated span and its source.

    Exact copies have one span, to ``WHOLE``, without coordinates, and so have windows that were told by their words.
    ``hash_bits``: bits of an edge's hash; fewer of them make collisions, never another result.
    """
    several = repeated_ids(docs)
    docs = distinct_rows(docs, several)
    copies = exact_copies(docs)
    docs = without(docs, copies)
    repeated = repeated_anchors(anchors_of(docs, width).withColumn("places", F.lit(1).cast("bigint")), within=False)
    found = written(occurrences(docs, repeated, width, hash_bits))
    lows = written(found.groupBy("edge").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc <> last").drop("last"))
    source = F.col("doc_id") == F.col("first_doc")
    node = lambda c: F.when(source, F.col(c)).alias(c)
    shared = written(found.join(lows.hint(HASHED), "edge").select("edge", node("source"), node("target"), "doc_id", "version", "at", "first_doc"))
    dropped(found, repeated, lows)
    # In its source document an edge counts at its first place, so that source coordinates run on.
    places = shared.where("doc_id = first_doc").groupBy("edge", "first_doc", F.col("version").alias("first_version")).agg(F.min("at").alias("first_at"), F.min("source").alias("source"), F.min("target").alias("target"))
    if not several.isEmpty():  # of several rows of one id the first version counts
        rest = [c for c in places.columns if c != "edge"]
        places = places.groupBy("edge").agg(F.min(F.struct("first_version", *[c for c in rest if c != "first_version"])).alias("p")).select("edge", *[F.col(f"p.{c}").alias(c) for c in rest])
    edges = written(places)
    paths = compacted(edges)
    hits = shared.where("doc_id > first_doc").select("edge", "doc_id", "version", "at").join(paths.hint(HASHED), "edge")
    hits = hits.withColumn("shift", F.col("at") - F.col("first_at")).withColumn("path", F.xxhash64("first_doc", "first_version", "path_at"))
    run = Window.partitionBy("doc_id", "version", "path", "shift").orderBy("at")
    hits = hits.withColumn("gap", F.col("at") - F.row_number().over(run))
    spans = hits.groupBy("doc_id", "version", "path", "shift", "gap", "first_doc", "first_version", "path_at").agg(F.min("at").alias("start"), (F.max("at") + width).alias("end"), F.min("first_at").alias("first_at"))
    raw = written(spans.select("doc_id", "version", "start", "end", "first_doc", "first_version", "first_at", "path_at"))
    dropped(edges)
    spans = checked(docs, raw)
    failed = spans.where("not same")
    out = spans.where("same").select("doc_id", "version", "start", "end", "first_doc", "first_at", "path_at")
    bare = [F.lit(None).alias(c) for c in ("first_doc", "first_at", "path_at")]
    out = out.unionByName(copies.select("doc_id", "version", F.lit(0).alias("start"), F.lit(WHOLE).alias("end"), *bare))
    if not failed.isEmpty():
        out = out.unionByName(told_by_words(docs, shared, failed, width).select("doc_id", "version", "start", "end", *bare))
    out = written(out)
    dropped(shared, raw, copies, several)
    return out


def without_spans(docs: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, one space between) of every row; texts under ``width`` words stay whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, shas, kept = [], [], [], []
            for text, parts in zip(binary_texts(batch.column(1)), batch.column(2)):
                words = text.as_py().split()
                stay, at = [], 0
                for start, end in sorted((p["start"], p["end"]) for p in (parts.as_py() or ()) if len(words) >= width):
                    stay += words[at:start]
                    at = max(at, end)
                stay += words[at:]
                left = b" ".join(stay)
                sizes.append(len(words))
                gone.append(len(words) - len(stay))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    several = repeated_ids(docs)
    listed = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = with_version(docs.select("doc_id", "text"), several).join(listed.hint(HASHED), ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, *, width: int = 13, hash_bits: int = 64) -> DataFrame:
    return without_spans(docs, repeated_spans(docs, width=width, hash_bits=hash_bits), width)
