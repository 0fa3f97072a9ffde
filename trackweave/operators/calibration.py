"""Calibration of frames: consensus of landmarks, and gaps bridged by the court's corners."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

from trackweave.functions.courts import on_landmarks
from trackweave.operators.court import homographies, homography, hull_area
from trackweave.operators.tasks import spread

#: Seeded subsets of four that are tried first; if there are no more of them, all are.
DRAWS = 512
#: Frames with at most so many subsets have all of them tried where the draws may have missed the best set (43 landmarks; a court has fewer).
ALL_SUBSETS = 131_072
#: Chance of a miss below which the draws are enough.
MISS = 1e-9
#: Errors that are held at once, for each frame, subset and landmark.
CELLS = 131_072


def projected(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through one matrix or through a stack of them; infinite where they have no image."""
    q = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = q[..., :2] / q[..., 2:]
    return np.where(np.isfinite(out), out, np.inf)


def _centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The middle and half the width of each frame's points, and the points brought to the middle of a unit square (k x n x 2)."""
    low, high = points.min(axis=1), points.max(axis=1)
    middle, size = (low + high) / 2, np.maximum((high - low).max(axis=1) / 2, 1e-12)
    return middle, size, (points - middle[:, None]) / size[:, None, None]


def _similar(middle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Matrices that scale by ``size`` and then move to ``middle``."""
    m = np.zeros((len(size), 3, 3))
    m[:, 0, 0] = m[:, 1, 1] = size
    m[:, :2, 2], m[:, 2, 2] = middle, 1
    return m


def four_point_matrices(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact matrices (k x 9 x s, row-major) of four points (x, y) and their images (u, v), each k x 4 x s; all NaN where three points or three images are on a line."""
    j, k = [1, 2, 0], [2, 0, 1]

    def basis(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the inverse of the first three points' matrix (k x 3 columns x 3 x s) and the fourth point's shares of them, both times twice the triangle's area."""
        xj, xk, yj, yk = x[:, j], x[:, k], y[:, j], y[:, k]
        rows = np.stack([yj - yk, xk - xj, xj * yk - xk * yj], axis=1)
        return rows, rows[:, 0] * x[:, 3:] + rows[:, 1] * y[:, 3:] + rows[:, 2]

    (rows, a), (_, b) = basis(x, y), basis(u, v)
    # A share is the signed area of the triangle with the fourth point in one corner's place; all three make up the triangle itself.
    good = np.ones((len(x), x.shape[2]), dtype=bool)
    for area in (a, b):
        good &= (np.abs(area).min(axis=1) > 1e-9) & (np.abs(area.sum(axis=1)) > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = b / a
    np.copyto(weight, np.nan, where=~good[:, None])
    ends = np.stack([weight * u[:, :3], weight * v[:, :3], weight], axis=1)
    h = ends[:, :, None, 0] * rows[:, None, :, 0]
    for i in (1, 2):
        h += ends[:, :, None, i] * rows[:, None, :, i]
    return h.reshape(len(h), 9, -1)


def subsets_of_four(n: int, seed: int = 0) -> np.ndarray:
    """All subsets of four of ``n``, or ``DRAWS`` seeded ones where there are more."""
    if comb(n, 4) <= DRAWS:
        return all_subsets(n)
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((DRAWS, n)), axis=1)[:, :4]


def all_subsets(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4)), dtype=int).reshape(-1, 4)


def _best_of(picks: np.ndarray, p: np.ndarray, q: np.ndarray, tolerance: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the matrices that ``picks`` propose for each frame (points p, images q, both centred) the one that most pairs agree with, how many do and the sum of their errors; NaN and 0 without any.

    ``room``: three arrays to work in, as fresh ones cost more than what is reckoned in them.
    """
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    h = four_point_matrices(*(c.take(picks.T, axis=1) for c in (x, y, u, v)))
    one, zero = np.ones_like(x), np.zeros_like(x)
    size = (len(p), x.shape[1], len(picks))
    depth, off, low = (r[: np.prod(size)].reshape(size) for r in room)
    with np.errstate(all="ignore"):
        np.matmul(np.stack([x, y, one], axis=-1), h[:, 6:], out=depth)
        np.matmul(np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1), h, out=off)
        np.matmul(np.stack([x, y, one, -v * x, -v * y, -v], axis=-1), h[:, 3:], out=low)
        for c in (depth, off, low):
            c *= c
        off += low
        off /= depth
        agree = off <= (tolerance**2)[:, None, None]
        np.sqrt(off, out=off)
    np.copyto(off, 0.0, where=~agree)
    count = agree.sum(axis=1, dtype=np.int32)
    most = count.max(axis=1)
    error = np.where(count == most[:, None], off.sum(axis=1), np.inf)
    first, frame = error.argmin(axis=1), np.arange(len(p))
    return np.where(most[:, None] > 0, h[frame, :, first], np.nan).reshape(-1, 3, 3), most, error[frame, first]


def _proposed(points: np.ndarray, images: np.ndarray, tolerance: float) -> np.ndarray:
    """For each frame (k x n x 2 each) the matrix of four pairs that most pairs agree with, the smaller sum of their errors first; NaN without any."""
    k, n = points.shape[:2]
    with np.errstate(invalid="ignore"):
        (middle, width, p), (place, size, q) = _centred(points), _centred(images)
    near = tolerance / size
    best, most, error = np.full((k, 3, 3), np.nan), np.zeros(k, dtype=int), np.full(k, np.inf)

    room = np.empty((3, max(CELLS, n)))
    many = max(1, CELLS // n)

    def search(frames: np.ndarray, picks: np.ndarray) -> None:
        for i in range(0, len(picks), many):
            part = picks[i : i + many]
            deal = max(1, CELLS // (n * len(part)))
            for at in (frames[j : j + deal] for j in range(0, len(frames), deal)):
                h, count, off = _best_of(part, p[at], q[at], near[at], room)
                better = (count > most[at]) | (count == most[at]) & (count > 0) & (off < error[at])
                best[at[better]], most[at[better]], error[at[better]] = h[better], count[better], off[better]

    search(np.arange(k), subsets_of_four(n))
    if DRAWS < comb(n, 4) <= ALL_SUBSETS:
        missed = np.array([(1 - comb(m + 1, 4) / comb(n, 4)) ** DRAWS > MISS if m < n else False for m in range(n + 1)])
        unsure = np.flatnonzero(missed[most])
        if len(unsure):
            search(unsure, all_subsets(n))
    with np.errstate(invalid="ignore"):
        return _similar(place, size) @ best @ _similar(-middle / width[:, None], 1 / width)


def consensuses(points: np.ndarray, images: np.ndarray, tolerance: float = 8.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Of many frames (k x n x 2 each): the matrix from points to images that most pairs agree on to ``tolerance`` pixels (NaN without any), and which these are.

    Subsets of four propose their exact matrices; the one that most pairs agree with wins (the smaller sum of their errors
    on a tie). It is fitted again to all that agree until these stay the same. The first subsets are seeded, so equal frames
    give equal matrices; where a larger set could have been missed by them, all subsets are tried.
    """
    k, n = points.shape[:2]
    inside = np.zeros((k, n), dtype=bool)
    if n < 4 or not k:
        return np.full((k, 3, 3), np.nan), inside

    def near(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.hypot(*np.moveaxis(projected(h, points[at]) - images[at], -1, 0)) <= tolerance

    h = _proposed(points, images, tolerance)
    active = np.flatnonzero(~np.isnan(h[:, 0, 0]))
    inside[active] = near(h[active], active)
    for _ in range(rounds):
        active = active[inside[active].sum(axis=1) >= 4]
        if not len(active):
            break
        fitted = homographies(points[active], images[active], inside[active])
        now = near(fitted, active)
        kept = ~np.isnan(fitted[:, 0, 0]) & (now.sum(axis=1) >= inside[active].sum(axis=1))
        same = (now == inside[active]).all(axis=1)
        h[active[kept]], inside[active[kept]] = fitted[kept], now[kept]
        active = active[kept & ~same]
    return h, inside


def consensus(points: np.ndarray, images: np.ndarray, tolerance: float = 8.0, rounds: int = 10) -> tuple[np.ndarray | None, np.ndarray]:
    """``consensuses`` of one frame; no matrix is None."""
    h, inside = consensuses(points[None], images[None], tolerance, rounds)
    return None if np.isnan(h[0, 0, 0]) else h[0], inside[0]


def _too_small(points: np.ndarray, used: np.ndarray, area: float) -> np.ndarray:
    """Which frames' used points have a hull under ``area``. A polygon of outermost points, inside the hull, settles most."""
    outer = []
    for turn in np.arange(8) * np.pi / 4:
        reach = np.where(used, points @ np.array([np.cos(turn), np.sin(turn)]), -np.inf)
        outer.append(points[np.arange(len(points)), reach.argmax(axis=1)])
    x, y = np.moveaxis(np.stack(outer, axis=1), -1, 0)
    inner = np.abs((x * np.roll(y, -1, axis=1) - y * np.roll(x, -1, axis=1)).sum(axis=1)) / 2
    small = ~(inner >= area)
    for i in np.flatnonzero(small):
        small[i] = hull_area(points[i, used[i]]) < area
    return small


def robust_frames(points: np.ndarray, images: np.ndarray, *, least: int = 5, area: float = 40.0, rms: float = 12.0, tolerance: float = 8.0, judge: str = "inliers") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h (NaN where refused), inliers, rms_px, reason of frames with equally many landmarks (k x n x 2 each).

    Refused: fewer landmarks than ``least`` (of those that agree too), a hull of the court points
    used under ``area`` square metres, a root mean square over ``rms`` pixels. ``judge``: whose error
    that is, the ``inliers``' or that of ``all`` landmarks, as the strict rule has it.
    """
    k, n = points.shape[:2]
    h, inliers, error = np.full((k, 3, 3), np.nan), np.zeros(k, dtype=int), np.full(k, np.nan)
    if n < least or not n:
        return h, inliers, error, np.full(k, "too few landmarks" if n < least else "undetermined", dtype=object)
    reason = np.where(_too_small(points, np.ones((k, n), dtype=bool), area), "small coverage", None).astype(object)
    at = np.flatnonzero(reason == None)  # noqa: E711
    found, inside = consensuses(points[at], images[at], tolerance)
    lost = np.isnan(found[:, 0, 0])
    reason[at[lost]] = "undetermined"
    at, found, inside = at[~lost], found[~lost], inside[~lost]
    inliers[at] = inside.sum(axis=1)
    few = inliers[at] < least
    reason[at[few]] = "too few landmarks agree"
    at, found, inside = at[~few], found[~few], inside[~few]
    small = _too_small(points[at], inside, area)
    reason[at[small]] = "small coverage"
    at, found, inside = at[~small], found[~small], inside[~small]
    used = inside if judge == "inliers" else np.ones_like(inside)
    with np.errstate(invalid="ignore", over="ignore"):
        off = ((projected(found, points[at]) - images[at]) ** 2).sum(axis=2)
        error[at] = np.sqrt(np.where(used, off, 0.0).sum(axis=1) / used.sum(axis=1))
    fits = error[at] <= rms
    h[at[fits]] = found[fits]
    reason[at[~fits]] = "large residual"
    return h, inliers, error, reason


def robust_frame(points: np.ndarray, images: np.ndarray, **guards: object) -> dict:
    """h, inliers, rms_px, reason of one frame's landmarks by ``robust_frames``; h is None if refused."""
    h, inliers, error, reason = (out[0] for out in robust_frames(points[None], images[None], **guards))
    return {"h": None if np.isnan(h[0, 0]) else h, "inliers": int(inliers), "rms_px": float(error), "reason": reason}


def robust_calibrated(landmarks: DataFrame, keys: list[str] | None = None, *, count: int = 0, **guards: object) -> DataFrame:
    """keys, solved, reason, landmarks, inliers, rms_px, h (row-major, court to image) of every frame.

    ``landmarks``: keys (clip, frame), court_x, court_y, x, y; ``count``: their number, if known. A frame's landmarks are at
    most those of the court, so they are listed by Spark, and frames with equally many are solved as one stack.
    """
    keys = keys or ["clip", "frame"]
    cells = ["court_x", "court_y", "x", "y"]
    known = landmarks.where(" and ".join(f"{c} is not null" for c in cells)).select(*keys, *[F.col(c).cast("double").alias(c) for c in cells])
    listed = spread(known, *keys, count=count).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("_m"))
    flat = listed.select(*keys, F.size("_m").alias("_n"), *[F.col(f"_m.{c}").alias(f"_{i}") for i, c in enumerate(cells)])
    schema = StructType([landmarks.schema[c] for c in keys]).add("solved", BooleanType()).add("reason", StringType())
    schema = schema.add("landmarks", LongType()).add("inliers", LongType()).add("rms_px", DoubleType()).add("h", ArrayType(DoubleType()))
    shape, k = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(k).to_numpy()
            starts = np.cumsum(sizes) - sizes
            marks = np.stack([b.column(k + 1 + i).flatten().to_numpy() for i in range(4)], axis=1)
            h, inliers, error = np.full((len(sizes), 9), np.nan), np.zeros(len(sizes), dtype=int), np.full(len(sizes), np.nan)
            reason = np.full(len(sizes), None, dtype=object)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                rows = marks[starts[at][:, None] + np.arange(n)]
                m, inliers[at], error[at], reason[at] = robust_frames(rows[..., :2], rows[..., 2:], **guards)
                h[at] = m.reshape(-1, 9)
            solved = ~np.isnan(h[:, 0])
            mats = pa.array([m if ok else None for m, ok in zip(h.tolist(), solved.tolist())], pa.list_(pa.float64()))
            cols = [*(b.column(i) for i in range(k)), pa.array(solved), pa.array(reason.tolist(), pa.string()), pa.array(sizes), pa.array(inliers), pa.array(error), mats]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, shape)], schema=shape)

    return flat.mapInArrow(run, schema)


def reference_gate(keypoints: DataFrame, landmarks: DataFrame, *, least_confidence: float = 0.5, least: int = 6, rms: float = 25.0, keys: list[str] | None = None) -> DataFrame:
    """The frames that a reference model solves: confident keypoints on landmarks, ``least`` of them, and all within ``rms``; h is null elsewhere."""
    return robust_calibrated(on_landmarks(keypoints, landmarks, least_confidence), keys, least=least, area=0.0, rms=rms, judge="all")


# Gaps between solved frames, bridged by the court's corners.


def quad_matrix(corners: Column, length: float, width: float) -> Column:
    """Row-major matrix that takes the court's corners (0, 0), (length, 0), (length, width), (0, width) to four points (x, y), in closed form; null if they have none."""
    x, y = ([F.get(corners, F.lit(i))[c] for i in range(4)] for c in ("x", "y"))
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    det = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    cells = [(x[1] - x[0] + g * x[1]) / length, (x[3] - x[0] + h * x[3]) / width, x[0], (y[1] - y[0] + g * y[1]) / length, (y[3] - y[0] + h * y[3]) / width, y[0], g / length, h / width, F.lit(1.0)]
    return F.when(F.abs(det) > 1e-9, F.array(*cells))


def corners_seen(h: Column, length: float, width: float) -> Column:
    """Where a row-major matrix puts the court's corners; null if one of them goes to infinity."""
    m = [F.get(h, F.lit(i)) for i in range(9)]

    def seen(x: float, y: float) -> Column:
        z = m[6] * x + m[7] * y + m[8]
        return F.when(z != 0, F.struct(((m[0] * x + m[1] * y + m[2]) / z).alias("x"), ((m[3] * x + m[4] * y + m[5]) / z).alias("y")))

    four = F.array(seen(0.0, 0.0), seen(length, 0.0), seen(length, width), seen(0.0, width))
    return F.when(~F.exists(four, lambda p: p.isNull()), four)


def bridged(samples: DataFrame, every: int, *, most: int = 3, clip: str = "clip", frame: str = "frame", length: float = 28.0, width: float = 15.0) -> DataFrame:
    """``samples`` (clip, frame, h; null where unsolved) with runs of up to ``most`` unsolved samples filled, and ``interpolated``, ``bridge`` (samples of that gap).

    Between the solved frames on either side the four projected corners move in a straight line, and the
    matrix is solved again from them. Frames that are no multiple of ``every`` from the earlier one stay as they are.
    """
    before = Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(clip).orderBy(frame).rowsBetween(1, Window.unboundedFollowing)
    anchor = F.when(F.col("h").isNotNull(), F.struct(F.col(frame).alias("at"), corners_seen(F.col("h"), length, width).alias("four")))
    rows = samples.withColumn("_a", F.last(anchor, ignorenulls=True).over(before)).withColumn("_b", F.first(anchor, ignorenulls=True).over(after))
    gap = F.floor((F.col("_b.at") - F.col("_a.at")) / every) - 1
    step = (F.col(frame) - F.col("_a.at")) / every
    fits = F.col("h").isNull() & gap.between(1, most) & ((F.col(frame) - F.col("_a.at")) % every == 0) & (step <= gap)
    t = step / (gap + 1)
    between = F.zip_with(F.col("_a.four"), F.col("_b.four"), lambda p, q: F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")))
    rows = rows.withColumn("_four", F.when(fits, between)).withColumn("_h", quad_matrix(F.col("_four"), length, width)).withColumn("_gap", gap)
    made = F.col("_h").isNotNull()
    out = rows.withColumn("interpolated", made).withColumn("bridge", F.when(made, F.col("_gap"))).withColumn("h", F.coalesce("h", "_h"))
    return out.drop("_a", "_b", "_four", "_h", "_gap")
