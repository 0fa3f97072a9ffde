"""Operators that carry state from frame to frame: a batch form by group and a streaming form on the same steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.tasks import spread


@dataclass
class CourtTracker:
    """Tracks of points in court metres: predict, match greedily by distance inside a gate, smooth the velocity."""

    gate: float = 3.5
    patience: int = 30
    nxt: int = 1
    live: dict[int, list[float]] = field(default_factory=dict)  # tid -> x, y, vx, vy, frames missed

    def step(self, points: np.ndarray) -> list[int]:
        """Track ids of one frame's points."""
        ids = [0] * len(points)
        tids = np.array(sorted(self.live), dtype=np.int64)
        ahead = np.array([[s[0] + s[2], s[1] + s[3]] for s in map(self.live.get, tids.tolist())]).reshape(-1, 2)
        far = np.hypot(ahead[None, :, 0] - points[:, None, 0], ahead[None, :, 1] - points[:, None, 1])
        at, of = np.nonzero(far <= self.gate)  # by point, then track: pairs beyond the gate never count
        order = np.argsort(far[at, of], kind="stable")
        taken: set[int] = set()
        for i, t in zip(at[order].tolist(), tids[of[order]].tolist()):
            if ids[i] or t in taken:
                continue
            ids[i] = t
            taken.add(t)
            s, (x, y) = self.live[t], points[i]
            self.live[t] = [x, y, 0.6 * s[2] + 0.4 * (x - s[0]), 0.6 * s[3] + 0.4 * (y - s[1]), 0]
        for t in list(self.live):
            if t not in taken:
                self.live[t][4] += 1
                if self.live[t][4] > self.patience:
                    del self.live[t]
        for i, p in enumerate(points):
            if not ids[i]:
                ids[i], self.nxt = self.nxt, self.nxt + 1
                self.live[ids[i]] = [float(p[0]), float(p[1]), 0.0, 0.0, 0]
        return ids

    def frames(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["frame"]).sort_values(["frame", "point"])
        frame, points = pdf["frame"].to_numpy(), pdf[["x", "y"]].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]][: len(frame)]).tolist()
        tids = [t for a, b in zip(starts, [*starts[1:], len(frame)]) for t in self.step(points[a:b])]
        return pdf.assign(tid=np.array(tids, dtype="int64"))


TRACKED = "clip {kind}, frame bigint, point bigint, x double, y double, tid bigint"
_COLUMNS = ["clip", "frame", "point", "x", "y", "tid"]


def tracked(points: DataFrame) -> DataFrame:
    """clip, frame, point, x, y with ``tid``, each clip by itself in frame order."""
    schema = TRACKED.format(kind=points.schema["clip"].dataType.simpleString())
    return spread(points, "clip").groupBy("clip").applyInPandas(lambda pdf: CourtTracker().frames(pdf)[_COLUMNS], schema)


def tracked_stream(points: DataFrame) -> DataFrame:
    """The same over a stream whose batches bring the frames of a clip in order; expiry counts missed frames, not time."""
    schema = TRACKED.format(kind=points.schema["clip"].dataType.simpleString())

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = CourtTracker()
        if state.exists:
            nxt, tids, values = state.get
            tracker.nxt = nxt
            tracker.live = {t: list(values[5 * i : 5 * i + 5]) for i, t in enumerate(tids)}
        yield tracker.frames(pd.concat(list(batches)))[_COLUMNS]
        state.update((tracker.nxt, list(tracker.live), [float(v) for s in tracker.live.values() for v in s]))

    return points.groupBy("clip").applyInPandasWithState(run, schema, "nxt bigint, tids array<bigint>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def confirmed_cuts(similar: np.ndarray, to_anchor, limit: float = 0.55, hold: int = 5) -> list[int]:
    """Frames where a picture changes for good.

    ``similar[i]``: likeness of frame i to the one before; ``to_anchor(a, i)``: of frame i
    to frame a. A drop is a candidate; it was a flash if the picture returns to what was
    before it within ``hold`` frames; a candidate at the end counts.
    """
    cuts, pending = [], None
    for i in range(1, len(similar)):
        if pending is not None:
            if to_anchor(pending - 1, i) >= limit:
                pending = None
            elif i - pending >= hold:
                cuts.append(pending)
                pending = None
        elif similar[i] < limit:
            pending = i
    return cuts + ([pending] if pending is not None else [])


def debounced(flags: np.ndarray, times: np.ndarray, apart: float = 0.5, cooldown: float = 0.5) -> list[int]:
    """Places where a flagged event starts, none within ``apart`` of the last start or ``cooldown`` of the last flag."""
    out, start, last = [], -np.inf, -np.inf
    for i in np.flatnonzero(flags):
        if times[i] - start >= apart and times[i] - last >= cooldown:
            out.append(int(i))
            start = times[i]
        last = times[i]
    return out


def chained_contacts(rows: pd.DataFrame, reach: float = 150.0, silence: int = 1, least: int = 1) -> pd.DataFrame:
    """Contacts (frame, cx, cy) linked to the nearest live event within reach; events of ``least`` frames or more."""
    live: list[dict] = []
    done: list[dict] = []
    for frame, f in rows.sort_values(["frame", "cx", "cy"]).groupby("frame", sort=True):
        done += [e for e in live if frame - e["end"] > silence]
        live = [e for e in live if frame - e["end"] <= silence]
        fresh = list(f[["cx", "cy"]].itertuples(index=False, name=None))
        for e in live:
            near = min(range(len(fresh)), key=lambda i: np.hypot(fresh[i][0] - e["cx"], fresh[i][1] - e["cy"]), default=None)
            if near is not None and np.hypot(fresh[near][0] - e["cx"], fresh[near][1] - e["cy"]) < reach:
                e["cx"], e["cy"] = fresh.pop(near)
                e["end"] = frame
        live += [{"start": frame, "end": frame, "cx": x, "cy": y} for x, y in fresh]
    found = [(e["start"], e["end"]) for e in done + live if e["end"] - e["start"] + 1 >= least]
    return pd.DataFrame(sorted(found), columns=["start", "end"])


def contacts(rows: DataFrame, clip: str, reach: float, silence: int, least: int) -> DataFrame:
    """clip, start, end of the chained contacts of every clip."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = chained_contacts(pdf, reach, silence, least)
        return out.assign(**{clip: pdf[clip].iloc[0]})[[clip, "start", "end"]]

    return spread(rows, clip).groupBy(clip).applyInPandas(run, f"`{clip}` {rows.schema[clip].dataType.simpleString()}, start bigint, end bigint")
