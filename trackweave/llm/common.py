"""Shared helpers: table reads, durable intermediates, word hashing, grouped streams."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most narrow rows (ids and a few numbers, under 100 MB) that are broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Hint for a side whose join key is unique: a partition of it goes into a hash table, so the other side, often with texts, isn't sorted.
HASHED = "shuffle_hash"

#: Spark's setting by which a query's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Entries a task keeps in a word cache before it starts afresh (about 50 MB).
CACHE_ENTRIES = 300_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``, or one of this machine where it is unset and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/trackweave-scratch"


def written(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage with files that every executor sees, so a lost executor costs a
    re-read and nothing more. The shuffles that made it are freed at once, and the folder
    goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/trackweave/{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        out.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` made for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key with fewer rows is never hot; at most ``MOST_HOT`` keys are.
HOT_ROWS, MOST_HOT = 256, 100_000


def joined_hot(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of ``many`` to ``one``, which has each key of ``many`` once with ``n``, its number of rows there.

    Keys with a large part of all rows are broadcast, and no more than ``MOST_HOT`` can be
    that large; so no task gets all rows of a hot key. Both frames are read twice.
    """
    least = max(HOT_ROWS, many.count() // MOST_HOT + 1)
    hot = one.where(F.col("n") >= least)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col("n") < least), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


_KEPT: dict[str, object] = {}


def per_worker(kind: str, data: bytes | str, make: Callable[[], object]) -> object:
    """What ``make`` builds from ``data``, built once a Python worker and shared by its tasks."""
    key = f"{kind}:{xxhash.xxh3_128_hexdigest(data)}"
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


class HashCache(dict):
    """word -> 64-bit hash; starts afresh at ``CACHE_ENTRIES`` so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


#: Which bytes are ASCII white space.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

#: Words up to so many bytes are hashed together, eight bytes at a time; longer ones each by itself.
LONG_WORD = 256


def binary_texts(texts: pa.Array) -> pa.Array:
    """The texts' UTF-8 bytes, those of a null empty."""
    return texts.fill_null("").cast(pa.large_binary())


def word_units(texts: pa.Array, size: int = 1 << 22) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words (runs of bytes other than ASCII white space), without a Python object a word.

    Texts are taken together in stretches of about ``size`` bytes of the column, a longer text by itself. Words of up to
    eight bytes never share a hash with others of their length.
    """
    column = binary_texts(texts)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        bounds = offsets[at : last + 1] - offsets[at]
        starts, hashes = _hashed_words(data[offsets[at] : offsets[last]], bounds)
        cuts = np.searchsorted(starts, bounds)
        yield from (hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        at = last


def _hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words of ``data``; none crosses one of the ``bounds``."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    eight = np.ndarray(n + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    hashes = sizes.astype(np.uint64) * _ODD[0]
    rows = np.flatnonzero(sizes <= LONG_WORD)
    done = 0
    while len(rows):
        left = np.minimum(sizes[rows] - done, 8).astype(np.uint64)
        part = eight[starts[rows] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        hashes[rows] = mixed(hashes[rows] ^ part)
        done += 8
        rows = rows[sizes[rows] > done]
    for i in np.flatnonzero(sizes > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return starts, hashes


def portions(texts: pa.Array, chars: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of about ``chars`` characters, so long texts are not all taken apart at once."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[3]
    return h ^ (h >> np.uint64(32))


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive units; empty if there are fewer."""
    h = raw_hashes(units, k)
    return mixed(h ^ np.uint64(k))


def raw_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Polynomial of each run of ``k`` consecutive units; ``longer`` makes it one of ``k + 1``, ``mixed(h ^ k)`` a hash."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = units[:n].copy()
    for i in range(1, k):
        h *= _ODD[0]
        h += units[i : i + n]
    return h


def longer(h: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of ``k + 1`` units from those of ``k``."""
    return h[:-1] * _ODD[0] + units[k:]


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal ``key`` in a stream of batches sorted by it; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    held_key: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
            k = keys[a]
            if held and k != held_key:
                yield held_key, held
                held = []
            held_key = k
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, held


CELLS_A_PART = 1 << 16


def cells_batch(counts: np.ndarray) -> pa.RecordBatch:
    """A task's fixed-size counts as compressed parts, those without a count left out."""
    found = [(i, counts[at : at + CELLS_A_PART]) for i, at in enumerate(range(0, len(counts), CELLS_A_PART))]
    rows = [(i, zlib.compress(c.astype("<i8").tobytes(), 1)) for i, c in found if c.any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])


#: Tasks' counts that are added up in one place.
FAN_IN = 64


def summed_cells(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of all tasks' ``cells_batch`` counts, in levels of ``FAN_IN`` however many tasks there are.

    ``size`` is fixed by the caller, so what reaches the driver is bounded.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in pdf["counts"]:
            total = total + np.frombuffer(zlib.decompress(x), dtype="<i8")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    level = written(parts.withColumn("task", F.spark_partition_id()))
    tasks = (level.agg(F.max("task")).first()[0] or 0) + 1
    summed = level
    while tasks > 1:
        summed = summed.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("part", "task").applyInPandas(add, "part int, task int, counts binary")
        tasks = -(-tasks // FAN_IN)
    out = np.zeros(size, dtype=np.int64)
    for row in summed.collect():
        at = row["part"] * CELLS_A_PART
        part = np.frombuffer(zlib.decompress(row["counts"]), dtype="<i8")
        out[at : at + len(part)] = part
    dropped(level)
    return out
