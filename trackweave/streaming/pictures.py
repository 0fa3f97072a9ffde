"""Scene cuts from picture vectors: a change counts once the picture hasn't come back within a few frames.

A frame unlike the one before it is a candidate. It was a flash if one of the next ``hold`` frames is like the frame before
the candidate; it is a cut if none is, or if the clip ends first. While a candidate is open no other is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def likeness(a: Column, b: Column, cells: int) -> Column:
    """Mean correlation of the ``cells`` equal parts of two vectors; parts without variance count as alike."""

    def part(i: Column) -> Column:
        size = F.floor(F.size(a) / cells).cast("int")
        p, q = (F.transform(F.slice(v, i * size + 1, size), lambda x: x.cast("double")) for v in (a, b))
        add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        times = lambda v, w: F.zip_with(v, w, lambda x, y: x * y)
        n = size.cast("double")
        both = add(times(p, q)) - add(p) * add(q) / n
        spread = (add(times(p, p)) - add(p) * add(p) / n) * (add(times(q, q)) - add(q) * add(q) / n)
        return F.when(spread > 1e-12, both / F.sqrt(spread)).otherwise(1.0)

    parts = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), part)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / cells


def picture_changes(frames: DataFrame, *, cells: int, limit: float = 0.55, hold: int = 5) -> DataFrame:
    """clip, frame, kind (cut, flash). ``frames``: clip, frame, vector; a null vector is no picture.

    Likeness to the frame before is a window over the clip; only candidates, which are few, look further: each is joined with
    its next ``hold`` frames. Which of them were open at all is a fold over a clip's candidates.
    """
    w = Window.partitionBy("clip").orderBy("frame")
    rows = frames.where("vector is not null").select("clip", "frame", "vector", F.row_number().over(w).alias("at"), F.lag("vector").over(w).alias("before"))
    drops = rows.where(F.col("before").isNotNull() & (likeness(F.col("before"), F.col("vector"), cells) < limit)).select("clip", "frame", "at", "before")
    ahead = drops.select("clip", "at", "before", F.explode(F.sequence(F.col("at") + 1, F.col("at") + hold)).alias("then"))
    met = ahead.join(rows.select("clip", F.col("at").alias("then"), "vector"), ["clip", "then"])
    back = met.where(likeness(F.col("before"), F.col("vector"), cells) >= limit).groupBy("clip", "at").agg(F.min("then").alias("back"))
    found = drops.drop("before").join(back, ["clip", "at"], "left")
    ends = F.coalesce("back", F.col("at") + hold)
    listed = found.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("at", "frame", ends.alias("until"), F.col("back").isNotNull().alias("flash")))).alias("all"))
    kind = frames.schema["frame"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("until"), F.expr(f"cast(array() as array<struct<frame:{kind},flash:boolean>>)").alias("taken"))
    take = lambda s, c: F.when(c["at"] > s["until"], F.struct(c["until"].alias("until"), F.concat(s["taken"], F.array(F.struct(c["frame"].alias("frame"), c["flash"].alias("flash")))).alias("taken"))).otherwise(s)
    taken = listed.select("clip", F.explode(F.aggregate("all", start, take)["taken"]).alias("c"))
    return taken.select("clip", "c.frame", F.when(F.col("c.flash"), "flash").otherwise("cut").alias("kind"))


def _alike(a: np.ndarray, b: np.ndarray, cells: int) -> float:
    size = len(a) // cells
    p, q = (np.asarray(v, dtype=float)[: size * cells].reshape(cells, size) for v in (a, b))
    p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
    spread = (p * p).sum(axis=1) * (q * q).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where(spread > 1e-12, (p * q).sum(axis=1) / np.sqrt(spread), 1.0).mean())


def picture_changes_stream(frames: DataFrame, *, cells: int, limit: float = 0.55, hold: int = 5) -> DataFrame:
    """The same over a stream whose batches bring the frames of a clip in order; a change comes out when it is decided.

    A row without a vector ends its clip: what is open then is a cut. The state is the last picture, and the
    candidate's frame, its age and the picture before it.
    """
    shape = f"clip {frames.schema['clip'].dataType.simpleString()}, frame bigint, kind string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, frame, age, anchor = state.get if state.exists else (None, None, 0, None)
        found = []
        for at, vector in pd.concat(list(batches)).sort_values("frame")[["frame", "vector"]].itertuples(index=False):
            if vector is None:
                if frame is not None:
                    found.append((frame, "cut"))
                last, frame, anchor = None, None, None
                continue
            if frame is not None:
                age += 1
                if _alike(anchor, vector, cells) >= limit:
                    found.append((frame, "flash"))
                    frame = None
                elif age >= hold:
                    found.append((frame, "cut"))
                    frame = None
            elif last is not None and _alike(last, vector, cells) < limit:
                frame, age, anchor = int(at), 0, last
            last = [float(v) for v in vector]
        state.update((last, frame, age, anchor if frame is not None else None))
        yield pd.DataFrame({"clip": [key[0]] * len(found), "frame": [f[0] for f in found], "kind": [f[1] for f in found]})

    return frames.groupBy("clip").applyInPandasWithState(run, shape, "last array<double>, frame bigint, age int, anchor array<double>", "append", GroupStateTimeout.NoTimeout)
