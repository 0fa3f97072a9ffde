"""Live jobs: throttled beats, timers for jobs that go quiet, and an upserted table of the latest state.

A job's update is written if the last one written is ``every`` seconds past, and always if it ends the job. A job that
says nothing for ``quiet`` seconds is quiet, after ``stale`` seconds stale; the timers run on event time, so they fire
without a row of the job once the others' rows have moved the watermark. Nothing follows an end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.tasks import spread

ENDS = ("done", "failed")
US = 1_000_000
_FIELDS = ["us", "kind", "done", "total"]


@dataclass
class Pulse:
    """What is known of a job: its last update and the last that was written (microseconds), its counts, and how far it is gone."""

    every: int
    quiet: int
    stale: int
    last: int | None = None
    wrote: int | None = None
    done: int | None = None
    total: int | None = None
    stage: str = "live"

    def until(self, now: int) -> list[tuple]:
        """The timers that fire by ``now``."""
        out = []
        for before, stage, wait in (("live", "quiet", self.quiet), ("quiet", "stale", self.stale)):
            if self.stage == before and self.last is not None and now >= self.last + wait:
                self.stage = stage
                out.append((self.last + wait, stage, self.done, self.total))
        return out

    def next_timer(self) -> int | None:
        wait = {"live": self.quiet, "quiet": self.stale}.get(self.stage)
        return None if wait is None or self.last is None else self.last + wait

    def step(self, at: int, state: str | None, done: int | None, total: int | None) -> list[tuple]:
        if self.stage in ENDS:
            return []
        out = self.until(at)
        self.last, self.stage = at, "live"
        self.done, self.total = (done if done is not None else self.done), (total if total is not None else self.total)
        if state in ENDS:
            self.stage = state
        if state in ENDS or self.wrote is None or at - self.wrote >= self.every:
            self.wrote = at
            out.append((at, state if state in ENDS else "beat", self.done, self.total))
        return out

    def rows(self, pdf: pd.DataFrame) -> list[tuple]:
        whole = lambda v: None if pd.isna(v) else int(v)
        return [e for at, state, done, total in pdf.sort_values(["us", "state"])[["us", "state", "done", "total"]].itertuples(index=False) for e in self.step(int(at), state, whole(done), whole(total))]


def _shape(updates: DataFrame) -> str:
    return f"job {updates.schema['job'].dataType.simpleString()}, us bigint, kind string, done bigint, total bigint"


def _table(job: object, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=_FIELDS).astype({"done": "Int64", "total": "Int64"})
    return out.assign(job=job)[["job", *_FIELDS]]


def _timed(updates: DataFrame) -> DataFrame:
    return updates.where("at is not null").withColumn("us", F.unix_micros(F.col("at").cast("timestamp_ltz")))


def pulses(updates: DataFrame, *, every: float = 1.0, quiet: float = 90.0, stale: float = 1800.0) -> DataFrame:
    """job, us, kind (beat, quiet, stale, done, failed), done, total; timers run up to the last row of the table.

    ``updates``: job, at, state (done and failed end a job), done, total.
    """
    waits = [round(x * US) for x in (every, quiet, stale)]
    rows = _timed(updates)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("us").alias("end"))))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pulse = Pulse(*waits)
        return _table(pdf["job"].iloc[0], pulse.rows(pdf) + pulse.until(int(pdf["end"].iloc[0])))

    return spread(rows, "job").groupBy("job").applyInPandas(run, _shape(updates))


def pulses_stream(updates: DataFrame, *, every: float = 1.0, quiet: float = 90.0, stale: float = 1800.0, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream whose batches bring the updates of a job in order."""
    waits = [round(x * US) for x in (every, quiet, stale)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pulse = Pulse(*waits, *(state.get if state.exists else ()))
        now = state.getCurrentWatermarkMs()
        found = pulse.until(now * 1000) if state.hasTimedOut else pulse.rows(pd.concat(list(batches)))
        state.update((pulse.last, pulse.wrote, pulse.done, pulse.total, pulse.stage))
        timer = pulse.next_timer()
        if timer is not None:
            state.setTimeoutTimestamp(max(-(-timer // 1000), now + 1))
        yield _table(key[0], found)

    timed = _timed(updates).withWatermark("at", delay)
    return timed.groupBy("job").applyInPandasWithState(run, _shape(updates), "last bigint, wrote bigint, done bigint, total bigint, stage string", "append", GroupStateTimeout.EventTimeTimeout)


# The upserted table: a folder a batch, and now and then one that holds all before it.


def _folders(spark: SparkSession, path: str, kind: str) -> list[tuple[int, str]]:
    """Complete folders of a kind by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}-*/_SUCCESS")) or []
    names = [f.getPath().getParent() for f in found]
    return sorted((int(n.getName().split("-")[1]), n.toString()) for n in names)


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The latest row of each key by ``order``; None before the first complete batch. Batches that were not finished don't count."""
    bases = _folders(spark, path, "base")
    after = bases[-1][0] if bases else -1
    parts = [p for _, p in bases[-1:]] + [p for n, p in _folders(spark, path, "batch") if n > after]
    return _latest(spark.read.parquet(*parts), keys, order) if parts else None


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    first = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*first)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserts(path: str, keys: list[str], order: list[str], *, compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: the latest row of each key of a batch, in a folder named by the batch.

    A batch that is written again, as after a crash, replaces its own folder with the same rows; a folder counts when it is
    complete. Every ``compact_every`` batches the whole table is written as one folder, which batches up to it need no
    more; those before the one-but-last are removed, so a reader that has just listed them keeps its files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")
        if (number + 1) % compact_every:
            return
        if all(n < number for n, _ in _folders(spark, path, "base")):  # else it was finished before the crash
            current(spark, path, keys, order).write.mode("overwrite").parquet(f"{path}/base-{number:012d}")
        bases = _folders(spark, path, "base")
        if len(bases) > 1:
            jvm = spark.sparkContext._jvm
            fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for n, old in [*_folders(spark, path, "batch"), *bases]:
                if n <= bases[-2][0] and old != bases[-2][1]:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)

    return write
