"""Content-chosen anchors: which long windows of a text may also be elsewhere.

Of every ``w`` consecutive hashes the smallest is an anchor. Equal windows have equal
anchors, so a window whose anchor is nowhere else is nowhere else itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import BROADCAST_ROWS, HASHED, dropped, written


def sliding(values: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``w`` consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """The anchor of each run of ``w`` hashes."""
    return sliding(hashes, w, np.minimum) if len(hashes) >= w else np.empty(0, dtype=hashes.dtype)


def anchor_counts(hashes: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a text and at how many places of it each is."""
    distinct = np.unique(anchors)
    if not len(distinct):
        return distinct, np.empty(0, dtype=np.int64)
    at = np.searchsorted(distinct, hashes)
    at[at == len(distinct)] = 0
    return distinct, np.bincount(at[distinct[at] == hashes], minlength=len(distinct))


def repeated_anchors(anchors: DataFrame, *, within: bool, hot: int | None = None) -> DataFrame:
    """doc_id, version and the list of its anchors that other documents have too (``within``: or that it has twice); a written table.

    With ``hot``, those at more than so many places of the table are in a list ``hot`` of their own.
    ``anchors``: anchor, doc_id, version, places; one row for each distinct anchor of a document.
    Anchors are counted map-side first and joined back, so Spark can split one that very many documents have.
    """
    rows = written(anchors)
    seen = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("places").alias("all"))
    seen = written(seen.where("all > 1" if within else "low < high").select("anchor", "all"))
    cold = F.lit(True) if hot is None else F.col("all") <= hot
    lists = [F.collect_list(F.when(cold, F.col("anchor"))).alias("anchors")]
    if hot is not None:
        lists.append(F.collect_list(F.when(~cold, F.col("anchor"))).alias("hot"))
    out = written(rows.join(seen.hint(HASHED), "anchor").groupBy("doc_id", "version").agg(*lists))
    dropped(rows, seen)
    return out


def repeated_ids(docs: DataFrame) -> DataFrame:
    """doc_id of ids that several rows have; a written table."""
    return written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))


def with_version(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` and ``version``: the digest of the text where the id is among ``ids``, else empty. Rows with the same id and version are equal."""
    none, n = F.lit(bytearray()), ids.count()
    if not n:
        return docs.withColumn("version", none)
    several = ids.withColumn("_several", F.lit(True))
    rows = docs.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "doc_id", "left")
    return rows.withColumn("version", F.coalesce(F.when(F.col("_several"), F.unhex(F.md5("text"))), none)).drop("_several")


def distinct_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, version, text of the rows with an id, equal ones once; only rows with an id in ``ids`` are shuffled."""
    rows = with_version(docs.where("doc_id is not null").select("doc_id", "text"), ids).select("doc_id", "version", "text")
    if ids.isEmpty():
        return rows
    several = F.octet_length("version") > 0
    return rows.where(~several).unionByName(rows.where(several).dropDuplicates(["doc_id", "version"]))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, version of rows whose text a smaller id has too; a written table."""
    keyed = docs.where("doc_id is not null").select("doc_id", "version", F.unhex(F.md5("text")).alias("key"))
    low = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    return written(keyed.join(low.hint(HASHED), "key").where("doc_id > low").select("doc_id", "version").distinct())


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose doc_id and version are not among ``rows``; these are broadcast while they are few."""
    few = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return docs.join(few, ["doc_id", "version"], "left_anti")
