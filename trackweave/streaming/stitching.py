"""Tracks that are seeded anew every few seconds: fresh boxes take over the ids of the tracks they continue.

Two assignments decide: first overlap, the greatest in all; what it leaves open, boxes and tracks that
don't overlap enough, is paired by the smallest distances of centres. Both are one-to-one, so of two tracks
on one player one is left for the player it lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.assign import BOX, SMALL, best_assignment, iou_matrix
from trackweave.operators.tasks import spread


def stitched(tracks: np.ndarray, boxes: np.ndarray, overlap: float = 0.2, reach: float = 250.0) -> list[int | None]:
    """For each box the place of the track it continues, None for a new one."""
    out: list[int | None] = [None] * len(boxes)
    if not len(tracks) or not len(boxes):
        return out
    met = _overlaps(tracks, boxes)
    alone = len({i for i, _ in met}) == len(met) == len({j for _, j in met})  # nothing overlaps two others: there is but one choice
    if not alone or overlap <= 0:
        over = iou_matrix(tracks, boxes)
        met = {(i, j): over[i, j] for i, j in best_assignment(over)}
    for (i, j), o in met.items():
        if o >= overlap:
            out[j] = i
    took = set(out)
    left = [i for i in range(len(tracks)) if i not in took]
    free = [j for j in range(len(boxes)) if out[j] is None]
    if left and free:
        middle = lambda b: (b[:, :2] + b[:, 2:]) / 2
        gap = middle(tracks[left])[:, None] - middle(boxes[free])[None]
        far = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2)
        for i, j in best_assignment(-far):
            if far[i, j] <= reach:
                out[free[j]] = left[i]
    return out


def _overlaps(tracks: np.ndarray, boxes: np.ndarray) -> dict[tuple[int, int], float]:
    """The pairs of ``iou_matrix`` that are not 0, with their value; by plain numbers for the few boxes of a frame."""
    if len(tracks) * len(boxes) > SMALL:
        over = iou_matrix(tracks, boxes)
        return {(i, j): over[i, j] for i, j in np.argwhere(over).tolist()}
    out, sized = {}, [(j, *b, max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)) for j, b in enumerate(boxes.tolist())]
    for i, (p, q, r, s) in enumerate(tracks.tolist()):
        mine = max(r - p, 0.0) * max(s - q, 0.0)
        for j, x1, y1, x2, y2, size in sized:
            if x1 < r and p < x2 and y1 < s and q < y2:
                inter = (min(r, x2) - max(p, x1)) * (min(s, y2) - max(q, y1))
                union = mine + size - inter
                if inter > 0 and union > 0:
                    out[i, j] = inter / union
    return out


@dataclass
class Seeds:
    """The boxes of the last frame by track, and the next new id."""

    overlap: float = 0.2
    reach: float = 250.0
    nxt: int = 1
    last: dict[int, list[float]] = field(default_factory=dict)

    def step(self, boxes: np.ndarray, held: list[int | None]) -> tuple[list[tuple[int, int, str]], list[tuple[int, list[float]]]]:
        """(place, tid, event) of a frame's rows, and the tracks that its fresh boxes leave without one, with their last box."""
        fresh = [i for i, t in enumerate(held) if t is None]
        if not fresh:
            self.last = {t: boxes[i].tolist() for i, t in enumerate(held)}
            self.nxt = max(self.nxt, *[t + 1 for t in held])
            return [(i, t, "held") for i, t in enumerate(held)], []
        names = sorted(self.last)
        took = stitched(np.array([self.last[t] for t in names]).reshape(-1, 4), boxes[fresh], self.overlap, self.reach)
        out = []
        for i, k in zip(fresh, took):
            out.append((i, self.nxt, "born") if k is None else (i, names[k], "kept"))
            self.nxt += k is None
        left = [(t, self.last[t]) for t in sorted(set(names) - {t for _, t, _ in out})]
        self.last = {t: boxes[i].tolist() for i, t, _ in out}
        return out, left

    def frames(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "box"])
        frame, boxes, number = pdf["frame"].to_numpy(), pdf[BOX].to_numpy(float), pdf["box"].tolist()
        held = [None if pd.isna(t) else int(t) for t in pdf["held"]]
        rows, starts = [], np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(frame)]):
            seen, lost = self.step(boxes[a:b], held[a:b])
            rows += [(frame[a], number[a + i], *boxes[a + i], t, event) for i, t, event in seen]
            rows += [(frame[a], None, *corners, t, "lost") for t, corners in lost]
        out = pd.DataFrame(rows, columns=_COLUMNS[1:]).astype({"box": "Int64"})
        return out.assign(clip=pdf["clip"].iloc[0])[_COLUMNS]


_COLUMNS = ["clip", "frame", "box", *BOX, "tid", "event"]
SHAPE = "clip {kind}, frame bigint, box bigint, x1 double, y1 double, x2 double, y2 double, tid bigint, event string"


def reseeded(boxes: DataFrame, *, overlap: float = 0.2, reach: float = 250.0) -> DataFrame:
    """clip, frame, box, corners, tid, event: every clip by itself in frame order.

    ``boxes``: clip, frame, box (order in the frame), corners, held (the track that a tracker carried the box for;
    null for a fresh detection). A frame of held boxes only says where the tracks are; fresh boxes take over the
    ids of the frame before or get new ones. ``event``: held, kept, born, or lost (a row of the track's last box,
    without ``box``, in the frame that left it).
    """
    shape = SHAPE.format(kind=boxes.schema["clip"].dataType.simpleString())
    return spread(boxes, "clip").groupBy("clip").applyInPandas(lambda pdf: Seeds(overlap, reach).frames(pdf[["clip", "frame", "box", *BOX, "held"]]), shape)


def reseeded_stream(boxes: DataFrame, *, overlap: float = 0.2, reach: float = 250.0) -> DataFrame:
    """The same over a stream whose batches bring the frames of a clip in order, a frame in one batch."""
    shape = SHAPE.format(kind=boxes.schema["clip"].dataType.simpleString())

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seeds = Seeds(overlap, reach)
        if state.exists:
            seeds.nxt, tids, corners = state.get
            seeds.last = {t: list(corners[4 * i : 4 * i + 4]) for i, t in enumerate(tids)}
        yield seeds.frames(pd.concat(list(batches))[["clip", "frame", "box", *BOX, "held"]])
        state.update((seeds.nxt, list(seeds.last), [float(v) for b in seeds.last.values() for v in b]))

    return boxes.groupBy("clip").applyInPandasWithState(run, shape, "nxt bigint, tids array<bigint>, corners array<double>", "append", GroupStateTimeout.NoTimeout)
