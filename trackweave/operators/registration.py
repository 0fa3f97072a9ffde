"""Registrations between frames: chains that start anew after a failure, and clicks of many frames fused on a hub."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from trackweave.functions.boxes import inverse, mapped, product
from trackweave.functions.courts import Point
from trackweave.operators.calibration import projected
from trackweave.operators.court import homography, hull_area
from trackweave.operators.identity import cut
from trackweave.operators.tasks import spread


#: What a frame does to the matrix before it: gives its own, takes a product with it, or ends the chain.
CONST, STEP, NONE = range(3)


def chained(links: DataFrame, *, width: int = 4096, clip: str = "clip", frame: str = "frame", least_inliers: int = 25, least_overlap: float = 0.3, keep: list[str] | None = None, count: int = 0) -> DataFrame:
    """``links`` (its columns ``keep``, all by default) with ``method`` (direct, chained, failed) and ``h`` (row-major, reference to frame; null where failed).

    ``links``: clip, frame (whole numbers), direct (matrix of the reference to the frame), direct_inliers, overlap, step (matrix
    of the frame before to this one), step_inliers; a clip has each frame once. A frame is direct when that match is good enough, else
    chained to the frame before if that one has a matrix; a failure ends the chain until the next direct frame.

    Each frame is a function of the matrix before it: a constant (direct), a product (step) or nothing. Such
    functions compose: blocks of ``width`` frame numbers are folded to one function each, the few functions of a clip one after
    another, and what enters a block is then applied inside it. Both folds of blocks read one shuffle, as sorted rows that
    stream by, so a task holds neither a block nor a clip. ``count``: about how many links there are (``tasks.spread``).
    """
    ok = lambda h, n: F.col(h).isNotNull() & (F.coalesce(F.col(n), F.lit(0)) >= least_inliers)
    direct = ok("direct", "direct_inliers") & (F.coalesce(F.col("overlap"), F.lit(0.0)) >= least_overlap)
    kind = F.when(direct, CONST).when(ok("step", "step_inliers"), STEP).otherwise(NONE)
    mine = F.when(direct, F.col("direct")).when(ok("step", "step_inliers"), F.col("step"))
    keep = [c for c in (links.columns if keep is None else keep) if c not in (clip, frame)]
    known = links.select(clip, F.expr(f"`{frame}` div {width}").alias("_block"), frame, kind.cast("int").alias("_kind"), mine.cast("array<double>").alias("_m"), *keep)
    rows = spread(known, clip, "_block", count=count)
    order = [clip, "_block", frame]
    field = {f.name: f for f in rows.schema}
    blocks = StructType([field[clip], field["_block"], field["_kind"], field["_m"]])
    plain = rows.select(*order, "_kind", "_m").sortWithinPartitions(*order)
    found = plain.mapInArrow(partial(_functions, shape=to_arrow_schema(blocks)), blocks)
    after = spread(found, clip).sortWithinPartitions(clip, "_block").mapInArrow(partial(_after, shape=to_arrow_schema(blocks)), blocks)
    entered = after.select(clip, "_block", F.lag("_m").over(Window.partitionBy(clip).orderBy("_block")).alias("_in"))
    whole = rows.join(entered.hint("shuffle_hash"), [clip, "_block"], "left").select(*order, "_kind", "_m", "_in", *keep).sortWithinPartitions(*order)
    schema = StructType([field[clip], field[frame], *(field[c] for c in keep)]).add("method", StringType()).add("h", ArrayType(DoubleType()))
    return whole.mapInArrow(partial(_inside, shape=to_arrow_schema(schema)), schema).select(*[c for c in links.columns if c in (clip, frame, *keep)], "method", "h")


def _matrices(column: pa.Array) -> np.ndarray:
    """n x 3 x 3, zero where null."""
    out, there = np.zeros((len(column), 3, 3)), column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
    return out


def _listed(m: np.ndarray, there: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(there) * 9].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m[there].ravel()), mask=pa.array(~there))


def _scan(kind: np.ndarray, m: np.ndarray, first: np.ndarray, in_kind: np.ndarray, in_m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the functions up to each row, group by group; ``in_kind`` and ``in_m``: what enters the rows that are ``first``.

    The n-th products after every start are taken together, each from the left as a plain loop would.
    """
    base = first | (kind != STEP)
    at = np.arange(len(kind))
    start = np.maximum.accumulate(np.where(base, at, 0))
    head, out = kind.copy(), m.copy()
    begun = first & (kind == STEP)
    head[begun] = in_kind
    out[begun] = m[begun] @ in_m
    state, far = head[start], at - start
    rows = np.flatnonzero((far > 0) & (state != NONE))
    rows = rows[np.argsort(far[rows], kind="stable")]
    for r in np.split(rows, np.flatnonzero(np.diff(far[rows])) + 1):
        out[r] = m[r] @ out[r - 1]
    return state, out


def _streamed(batches: Iterator[pa.RecordBatch], keys: int, kind: int, entry: int, enters: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches sorted by their first ``keys`` columns, with whether a row is the first of its group, and the composition up to it.

    ``kind``: the column of kinds, with the matrices after it; a group is entered with an identity of kind ``entry``, or
    with the constant in column ``enters``, with nothing where that is null.
    """
    held: tuple | None = None
    for b in (b for b in batches if b.num_rows):
        kinds, m = b.column(kind).to_numpy().astype(int), _matrices(b.column(kind + 1))
        codes = [b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy() for i in range(keys)]
        first = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]
        now = tuple(b.column(i)[0].as_py() for i in range(keys))
        goes_on = held is not None and held[0] == now
        begun = np.flatnonzero(first & (kinds == STEP))
        in_kind, in_m = np.full(len(begun), entry), np.tile(np.eye(3), (len(begun), 1, 1))
        if enters is not None:
            given = b.column(enters).take(pa.array(begun))
            in_m, in_kind = _matrices(given), np.where(given.is_valid().to_numpy(zero_copy_only=False), CONST, NONE)
        if goes_on and kinds[0] == STEP:
            in_kind[0], in_m[0] = held[1:]
        state, out = _scan(kinds, m, first, in_kind, in_m)
        held = (tuple(b.column(i)[-1].as_py() for i in range(keys)), state[-1], out[-1])
        first[0] = not goes_on
        yield b, first, state, out


def _functions(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """clip, block, kind and matrix of each block's function; batches: clip, block, frame, kind, matrix."""

    def made(b: pa.RecordBatch, rows: np.ndarray, state: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(state[rows].astype(np.int32)), _listed(out[rows], state[rows] != NONE)], schema=shape)

    last: pa.RecordBatch | None = None
    for b, first, state, out in _streamed(batches, 2, 3, STEP):
        if last is not None and first[0]:
            yield last
        yield made(b, np.flatnonzero(first[1:]), state, out)
        last = made(b, np.array([len(first) - 1]), state, out)
    if last is not None:
        yield last


def _after(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The matrix after each block of a clip; batches: clip, block, kind, matrix."""
    for b, _, state, out in _streamed(batches, 1, 2, NONE):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(state.astype(np.int32)), _listed(out, state == CONST)], schema=shape)


def _inside(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """clip, frame, the columns kept, method and matrix; batches: clip, block, frame, kind, matrix, what enters the block, the columns kept."""
    for b, _, state, out in _streamed(batches, 2, 3, NONE, 5):
        there = state == CONST
        method = np.where(~there, "failed", np.where(b.column(3).to_numpy() == CONST, "direct", "chained"))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([b.column(0), b.column(2), *b.columns[6:], pa.array(method), _listed(out, there)], shape)], schema=shape)


def hubs(clicks: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, hub: the frame with most clicks, the smallest on a tie."""
    counted = clicks.groupBy(clip, frame).agg(F.count("*").alias("_n"))
    return counted.groupBy(clip).agg(F.min_by(F.col(frame), F.struct(-F.col("_n"), F.col(frame))).alias("hub"))


def paths_to_hub(links: DataFrame, hub: DataFrame, *, least_inliers: int = 25, clip: str = "clip") -> DataFrame:
    """clip, frame, hops, h: the matrix that takes a frame to the hub of its clip, along the fewest links.

    ``links``: clip, a, b, h (row-major, a to b), inliers; a link goes both ways. Every round reaches the frames one link
    further; of several links to the same frame the one with most inliers counts, then the one from the smallest frame.
    """
    able = links.where(F.col("h").isNotNull() & (F.col("inliers") >= least_inliers))
    there = able.select(clip, F.col("a").alias("frame"), F.col("b").alias("via"), F.col("h").alias("step"), "inliers")
    back = able.select(clip, F.col("b").alias("frame"), F.col("a").alias("via"), inverse(F.col("h")).alias("step"), "inliers").where("step is not null")
    edges = cut(there.unionByName(back))
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    edge = cut(hub.select(clip, F.col("hub").alias("frame"), F.lit(0).alias("hops"), identity.alias("h")))
    reached = edge
    while not edge.isEmpty():
        met = edges.join(edge.select(clip, F.col("frame").alias("via"), F.col("h").alias("_to"), "hops"), [clip, "via"])
        fresh = met.join(reached.select(clip, "frame"), [clip, "frame"], "left_anti")
        best = fresh.groupBy(clip, "frame").agg(F.min_by(F.struct("step", "_to", "hops"), F.struct(-F.col("inliers"), F.col("via"))).alias("_b"))
        edge = cut(best.select(clip, "frame", (F.col("_b.hops") + 1).alias("hops"), product(F.col("_b._to"), F.col("_b.step")).alias("h")))
        reached = cut(reached.unionByName(edge))
    return reached


def on_hub(clicks: DataFrame, paths: DataFrame, clip: str = "clip") -> DataFrame:
    """Clicks (clip, frame, kind, name, x1, y1, x2, y2; a line's are two points on it) on their hub, one for each name of a clip: the latest frame's.

    Frames without a path to the hub drop out. ``hops``: links that the click came along.
    """
    moved = clicks.join(paths, [clip, "frame"])
    a, b = mapped(F.col("h"), F.col("x1"), F.col("y1")), mapped(F.col("h"), F.col("x2"), F.col("y2"))
    moved = moved.select(clip, "frame", "kind", "name", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"), "hops")
    seen = moved.where("x1 is not null and (kind = 'point' or x2 is not null)")
    rest = ["frame", "x1", "y1", "x2", "y2", "hops"]
    return seen.groupBy(clip, "kind", "name").agg(F.max(F.struct(*rest)).alias("_c")).select(clip, "kind", "name", *[F.col(f"_c.{c}").alias(c) for c in rest])


def _through(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.cross([*p, 1.0], [*q, 1.0])


def fused_solve(merged: DataFrame, points: dict[str, Point], lines: dict[str, tuple[Point, Point]], *, rms: float = 8.0, area: float = 40.0, clip: str = "clip") -> DataFrame:
    """clip, kind, name, frame, hops, residual, again, h, rms_px, coverage, verdict: one solve for all points and lines of a clip.

    ``residual``: pixels between a point and where the matrix puts it, or the mean distance of a line's two clicks
    from where it puts the line; ``again``: over ``rms``, to be clicked again. ``verdict``: usable, failed (rms), thin
    (hull of the court points under ``area``) or undetermined. Names that the court has not are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[n in (points if k == "point" else lines) for k, n in zip(pdf["kind"], pdf["name"])]].sort_values(["kind", "name"])
        p, s = pdf[pdf["kind"] == "point"], pdf[pdf["kind"] == "line"]
        court = np.array([points[n] for n in p["name"]], dtype=float).reshape(-1, 2)
        image = p[["x1", "y1"]].to_numpy(float)
        segments = np.array([lines[n] for n in s["name"]], dtype=float).reshape(-1, 2, 2)
        clicked = s[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 2, 2)
        h = homography(court, image, np.array([_through(*q) for q in segments]).reshape(-1, 3), np.array([_through(*q) for q in clicked]).reshape(-1, 3))
        spread = hull_area(np.r_[court, segments.reshape(-1, 2)])
        residual = pd.Series(np.nan, index=pdf.index)
        error, verdict = float("nan"), "undetermined"
        if h is not None:
            residual[p.index] = np.hypot(*(projected(h, court) - image).T)
            turned = np.linalg.inv(h).T
            for i, seg, seen in zip(s.index, segments, clicked):
                line = turned @ _through(*seg)
                norm = np.hypot(*line[:2])
                residual[i] = np.abs(np.c_[seen, np.ones(2)] @ line).mean() / norm if norm >= 1e-12 else np.inf
            error = float(np.sqrt((residual**2).mean()))
            verdict = "failed" if error > rms else "thin" if spread < area else "usable"
        return pdf[[clip, "kind", "name", "frame", "hops"]].assign(residual=residual, again=residual > rms, h=[None if h is None else h.ravel().tolist()] * len(pdf), rms_px=error, coverage=spread, verdict=verdict)

    kinds = {f.name: f.dataType.simpleString() for f in merged.schema}
    return spread(merged, clip).groupBy(clip).applyInPandas(run, f"`{clip}` {kinds[clip]}, kind string, name string, frame {kinds['frame']}, hops int, residual double, again boolean, h array<double>, rms_px double, coverage double, verdict string")


def fused_calibration(clicks: DataFrame, links: DataFrame, points: dict[str, Point], lines: dict[str, tuple[Point, Point]], *, hub: DataFrame | None = None, least_inliers: int = 25) -> DataFrame:
    """All clicks of a clip brought to its hub along the registrations, solved together (``fused_solve``); ``hub``: clip, hub where it is chosen."""
    at = hub if hub is not None else hubs(clicks)
    return fused_solve(on_hub(clicks, paths_to_hub(links, at, least_inliers=least_inliers)), points, lines)
