"""Court models: measures, named landmarks and lines in metres, and the join of keypoints with them.

x runs along the length from the west end, y across the width from the south side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Point = tuple[float, float]

# The measures of the two courts, and the points of the eighteen-keypoint model in its own order.
FIBA = {"length": 28.0, "width": 15.0, "key_width": 4.9, "key_depth": 5.8, "circle": 1.8, "arc": 6.75, "inset": 0.9, "basket": 1.575}
MIXED = {"length": 28.0, "width": 15.0, "key_south": 5.18, "key_north": 10.0, "key_depth": 5.79, "inset_south": 0.91, "inset_north": 14.1, "circle": 1.8, "key_middle": 7.59}
EIGHTEEN = [
    (0.0, 0.0), (0.0, 0.91), (0.0, 5.18), (0.0, 10.0), (0.0, 14.1), (0.0, 15.0), (14.0, 15.0), (14.0, 0.0), (5.79, 5.18),
    (5.79, 10.0), (28.0, 15.0), (28.0, 14.1), (28.0, 10.0), (28.0, 5.18), (28.0, 0.91), (28.0, 0.0), (22.21, 5.18), (22.21, 10.0),
]


@dataclass(frozen=True)
class Court:
    """A rectangular key court by its measures."""

    length: float = FIBA["length"]
    width: float = FIBA["width"]
    key_width: float = FIBA["key_width"]
    key_depth: float = FIBA["key_depth"]
    circle: float = FIBA["circle"]
    arc: float = FIBA["arc"]
    inset: float = FIBA["inset"]
    basket: float = FIBA["basket"]

    @property
    def sides(self) -> dict[str, float]:
        """y of the south and north edge of the key."""
        return {"s": self.width / 2 - self.key_width / 2, "n": self.width / 2 + self.key_width / 2}

    def landmarks(self) -> dict[str, Point]:
        """Corners and crossings of lines by name, in the order that label exports index."""
        ends, rims = {"w": 0.0, "e": self.length}, {"s": 0.0, "n": self.width}
        out = {f"corner_{e}{r}": (x, y) for e, x in ends.items() for r, y in rims.items()}
        out |= {f"half_{r}": (self.length / 2, y) for r, y in rims.items()}
        out |= {f"circle_{r}": (self.length / 2, self.width / 2 + d) for r, d in (("s", -self.circle), ("n", self.circle))}
        for e, x in ends.items():
            line = abs(x - self.key_depth)
            out |= {f"{e}key_base_{r}": (x, y) for r, y in self.sides.items()} | {f"{e}key_ft_{r}": (line, y) for r, y in self.sides.items()}
        return out | {f"{e}3pt_{r}": (x, abs(y - self.inset)) for e, x in ends.items() for r, y in rims.items()}

    def lines(self) -> dict[str, tuple[Point, Point]]:
        """Straight lines by name, each as the stretch that is painted."""
        across = lambda x, low, high: ((x, low), (x, high))
        along = lambda y, to: ((0.0, y), (to, y))
        s, n = self.sides["s"], self.sides["n"]
        out = {"baseline_w": across(0.0, 0.0, self.width), "baseline_e": across(self.length, 0.0, self.width)}
        out |= {"sideline_s": along(0.0, self.length), "sideline_n": along(self.width, self.length), "halfway": across(self.length / 2, 0.0, self.width)}
        out |= {"ft_w": across(self.key_depth, s, n), "ft_e": across(self.length - self.key_depth, s, n)}
        return out | {"key_side_s": along(s, self.key_depth), "key_side_n": along(n, self.key_depth)}


def candidates() -> dict[str, Point]:
    """Every place a numbered keypoint of the mixed model could be, by name."""
    m = MIXED
    rims = {"corner_s": 0.0, "3pt_s": m["inset_south"], "key_s": m["key_south"], "key_n": m["key_north"], "3pt_n": m["inset_north"], "corner_n": m["width"]}
    out = {f"{e}_{name}": (x, y) for e, x in (("w", 0.0), ("e", m["length"])) for name, y in rims.items()}
    line = {"s": m["key_south"], "n": m["key_north"], "mid": m["key_middle"]}
    out |= {f"{e}_ft_{name}": (x, y) for e, x in (("w", m["key_depth"]), ("e", m["length"] - m["key_depth"])) for name, y in line.items()}
    middle, half = m["length"] / 2, m["width"] / 2
    return out | {"half_s": (middle, 0.0), "half_n": (middle, m["width"]), "centre": (middle, half), "circle_s": (middle, half - m["circle"]), "circle_n": (middle, half + m["circle"])}


def landmark_table(spark: SparkSession, points: dict[str, Point] | list[Point]) -> DataFrame:
    """ix, name, court_x, court_y; a list is named by its indices, as models name their keypoints."""
    named = points if isinstance(points, dict) else {str(i): p for i, p in enumerate(points)}
    return spark.createDataFrame([(i, name, float(x), float(y)) for i, (name, (x, y)) in enumerate(named.items())], "ix int, name string, court_x double, court_y double")


def on_landmarks(keypoints: DataFrame, landmarks: DataFrame, least: float | None = None, confidence: str = "confidence") -> DataFrame:
    """Keypoints whose ``name`` is a landmark, with court_x and court_y; with ``least``, only confident ones. The table of landmarks is fixed."""
    rows = keypoints if least is None else keypoints.where(F.col(confidence) >= least)
    return rows.join(F.broadcast(landmarks.select("name", "court_x", "court_y")), "name")
