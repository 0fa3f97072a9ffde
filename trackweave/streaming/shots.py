"""Shots from flags of single frames: starts, makes and misses, each reported once.

A jump-shot or layup flag starts a shot if none is open, the last start is ``apart`` seconds past and the last make
``cooldown`` seconds. A ball in the basket makes the open shot. A shot that isn't made within ``reset`` seconds is missed
at that moment, whether rows come then or not. Flags of an open shot, and baskets without a shot, say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

US = 1_000_000


@dataclass
class Shots:
    """The open shot and the times of the last start and make, in microseconds."""

    reset: int = 1_700_000
    apart: int = 500_000
    cooldown: int = 500_000
    opened: int | None = None
    kind: str | None = None
    started: int | None = None
    made: int | None = None

    def until(self, now: int) -> list[tuple[int, str, str]]:
        """The miss that is due by ``now``, if one is."""
        if self.opened is None or now < self.opened + self.reset:
            return []
        out = [(self.opened + self.reset, "missed", self.kind)]
        self.opened = self.kind = None
        return out

    def step(self, at: int, jump: bool, layup: bool, basket: bool) -> list[tuple[int, str, str]]:
        out = self.until(at)
        if basket and self.opened is not None:
            out.append((at, "made", self.kind))
            self.opened, self.kind, self.made = None, None, at
        elif (jump or layup) and self.opened is None and (self.started is None or at - self.started >= self.apart) and (self.made is None or at - self.made >= self.cooldown):
            self.opened = self.started = at
            self.kind = "jump" if jump else "layup"
            out.append((at, "start", self.kind))
        return out

    def rows(self, pdf: pd.DataFrame) -> list[tuple[int, str, str]]:
        return [e for at, *f in zip(pdf["us"], pdf["jump"], pdf["layup"], pdf["basket"]) for e in self.step(int(at), *f)]


def _shape(flags: DataFrame) -> str:
    return f"clip {flags.schema['clip'].dataType.simpleString()}, us bigint, event string, kind string"


def _table(clip: object, found: list[tuple[int, str, str]]) -> pd.DataFrame:
    return pd.DataFrame({"clip": [clip] * len(found), "us": [f[0] for f in found], "event": [f[1] for f in found], "kind": [f[2] for f in found]})


def _timed(flags: DataFrame) -> DataFrame:
    given = {c: F.coalesce(c, F.lit(False)) for c in ("jump", "layup", "basket")}
    return flags.where("at is not null").withColumns(given).withColumn("us", F.unix_micros(F.col("at").cast("timestamp_ltz")))


def shots(flags: DataFrame, *, reset: float = 1.7, apart: float = 0.5, cooldown: float = 0.5) -> DataFrame:
    """clip, us (microseconds), event (start, made, missed), kind (jump, layup). ``flags``: clip, at, jump, layup, basket; null is no flag.

    A shot that is open when the last row of the whole table comes less than ``reset`` later stays open.
    """
    times = [round(x * US) for x in (reset, apart, cooldown)]
    rows = _timed(flags)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("us").alias("end"))))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = Shots(*times)
        return _table(pdf["clip"].iloc[0], state.rows(pdf.sort_values("us")) + state.until(int(pdf["end"].iloc[0])))

    return rows.groupBy("clip").applyInPandas(run, _shape(flags))


def shots_stream(flags: DataFrame, *, reset: float = 1.7, apart: float = 0.5, cooldown: float = 0.5, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream; a miss comes out by a timer when the watermark passes it, without a row of its clip."""
    times = [round(x * US) for x in (reset, apart, cooldown)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shot = Shots(*times, *(state.get if state.exists else (None,) * 4))
        if state.hasTimedOut:
            found = shot.until(state.getCurrentWatermarkMs() * 1000)
        else:
            found = shot.rows(pd.concat(list(batches)).sort_values("us"))
        state.update((shot.opened, shot.kind, shot.started, shot.made))
        if shot.opened is not None:
            state.setTimeoutTimestamp(max(-(-(shot.opened + shot.reset) // 1000), state.getCurrentWatermarkMs() + 1))
        yield _table(key[0], found)

    timed = _timed(flags).withWatermark("at", delay)
    return timed.groupBy("clip").applyInPandasWithState(run, _shape(flags), "opened bigint, kind string, started bigint, made bigint", "append", GroupStateTimeout.EventTimeTimeout)
