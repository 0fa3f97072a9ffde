"""Labels of a frame stacked in rows, so that none is drawn over another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(boxes: DataFrame, keys: list[str], name: str, height: float = 34.0) -> DataFrame:
    """``boxes`` (keys, name, x1, x2, y2) with ``row``, the rows a label moves down, and ``label_y``.

    From the top of the frame on (by y2, then name) each label takes the first row in which no earlier label
    that overlaps it sideways is less than ``height`` away. A frame's boxes are few, so the fold is one expression.
    """
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    cells = F.struct(F.col("y2").cast("double").alias("y"), F.col(name).alias("name"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"))
    listed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(cells)).alias("_all"))
    start = F.expr(f"cast(array() as array<struct<name:{kinds[name]},row:int,y:double,x1:double,x2:double>>)")

    def place(taken, b):
        blocked = lambda row: F.exists(taken, lambda t: (F.abs(b["y"] + row * height - t["y"]) < height) & ~((b["x2"] < t["x1"]) | (b["x1"] > t["x2"])))
        # A label nearer than a row's height blocks two rows at most, so one of twice as many rows and one is free.
        row = F.get(F.filter(F.sequence(F.lit(0), 2 * F.size(taken)), lambda r: ~blocked(r)), F.lit(0))
        return F.concat(taken, F.array(F.struct(b["name"].alias("name"), row.alias("row"), (b["y"] + row * height).alias("y"), b["x1"].alias("x1"), b["x2"].alias("x2"))))

    placed = listed.select(*keys, F.explode(F.aggregate("_all", start, place)).alias("_p"))
    return boxes.join(placed.select(*keys, F.col("_p.name").alias(name), F.col("_p.row").alias("row"), F.col("_p.y").alias("label_y")), [*keys, name])
