"""Lines, polygons and court points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """(a, b, c) with a * x + b * y + c = 0 and a unit normal; null for equal points."""
    a, b = y1 - y2, x2 - x1
    n = F.hypot(a, b)
    return F.when(n > 0, F.struct((a / n).alias("a"), (b / n).alias("b"), ((x1 * y2 - x2 * y1) / n).alias("c")))


def line_distance(line: Column, x: Column, y: Column) -> Column:
    """Perpendicular distance of a point: the residual of a line landmark."""
    return F.abs(line["a"] * x + line["b"] * y + line["c"])


def clipped(polygons: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of each convex polygon (n x m x 2) where a * x + b * y + c >= 0, as n x (m + 1) x 2.

    Places that a polygon doesn't need repeat its first corner, which changes no area; one with nothing left is a point.
    """
    n, m, _ = polygons.shape
    after = np.roll(polygons, -1, axis=1)
    here, there = (p[..., 0] * a + p[..., 1] * b + c for p in (polygons, after))
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = polygons + (here / (here - there))[..., None] * (after - polygons)
    corners = np.stack([polygons, cut], axis=2).reshape(n, 2 * m, 2)
    keep = np.stack([here >= 0, (here >= 0) != (there >= 0)], axis=2).reshape(n, 2 * m)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : m + 1]
    out, kept = np.take_along_axis(corners, order[..., None], axis=1), np.take_along_axis(keep, order, axis=1)
    return np.where(kept[..., None], out, np.where(kept[:, :1, None], out[:, :1], 0.0))


def areas(polygons: np.ndarray) -> np.ndarray:
    """Signed area of each polygon; negative when its corners turn the other way (a mirrored projection)."""
    after = np.roll(polygons, -1, axis=1)
    return (polygons[..., 0] * after[..., 1] - polygons[..., 1] * after[..., 0]).sum(axis=1) / 2


def rectangle_overlap(frames: DataFrame, polygon: str, width: float, height: float) -> DataFrame:
    """``overlap``: the share of a width x height frame that a convex polygon (array of x, y) covers; 0 for a mirrored one, for fewer
    than three corners and for none. A polygon that isn't convex may come out open.

    All polygons of a batch with as many corners are clipped at once, one half plane after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(polygon))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            corners = column.flatten()
            values = np.stack([corners.field(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in map(corners.type.get_field_index, ("x", "y"))], axis=1) if len(corners) else np.empty((0, 2))
            starts, share = np.cumsum(sizes) - sizes, np.zeros(batch.num_rows)
            for size in np.unique(sizes[sizes > 2]):
                rows = np.flatnonzero(sizes == size)
                whole = values[starts[rows][:, None] + np.arange(size)]
                left = whole
                for plane in ((1.0, 0.0, 0.0), (-1.0, 0.0, width), (0.0, 1.0, 0.0), (0.0, -1.0, height)):
                    left = clipped(left, *plane)
                found = np.abs(areas(left)) / (width * height)
                share[rows] = np.where((areas(whole) > 0) & np.isfinite(found), found, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share)], names=[*batch.schema.names, "overlap"])

    return frames.mapInArrow(run, T.StructType([*frames.schema.fields, T.StructField("overlap", T.DoubleType())]))


def corner_disagreement(a: Column, b: Column) -> Column:
    """Mean distance of the corners of two quadrilaterals; null when one is missing or not finite."""
    gaps = F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(F.isnan(mean) | (mean == float("inf")), F.lit(None)).otherwise(mean)


def nearest_to_click(players: DataFrame, clicks: DataFrame, keys: list[str], click: str, player: str, limit: float = 90.0) -> DataFrame:
    """Each click (keys, click, cx, cy) with the nearest player (keys, player, x, y) of its frame under ``limit`` pixels; the smaller id on a tie."""
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    near = clicks.join(players, keys).withColumn("distance", d).where(F.col("distance") < limit)
    best = near.groupBy(*keys, click).agg(F.min(F.struct("distance", player)).alias("_m"))
    return clicks.join(best, [*keys, click], "left").select(*clicks.columns, F.col("_m")[player].alias(player), F.col("_m.distance").alias("distance"))


def mirror_partners(landmarks: DataFrame, length: float, index: str = "index", x: str = "x", y: str = "y") -> DataFrame:
    """index and mirror: the landmark at (length - x, y); null where there is none."""
    other = landmarks.select(F.round(F.lit(length) - F.col(x), 6).alias("_x"), F.round(y, 6).alias("_y"), F.col(index).alias("mirror"))
    own = landmarks.select(index, F.round(x, 6).alias("_x"), F.round(y, 6).alias("_y"))
    return own.join(other, ["_x", "_y"], "left").select(index, "mirror")


def court_point(name: Column, points: list[tuple[float, float]]) -> Column:
    """The landmark that an index in text names; null for anything else."""
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    return F.get(table, F.when(name.rlike("^[0-9]{1,4}$"), name.cast("int")).otherwise(-1))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees from the x axis, 0 to 360."""
    return (F.degrees(F.atan2(dy, dx)) + 360) % 360
