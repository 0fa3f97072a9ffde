"""How the groups of a Python kernel are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows that a task sorts or holds in tables, where the number of rows is known.
ROWS_A_TASK = 500_000


def spread(rows: DataFrame, *keys: str, count: int = 0) -> DataFrame:
    """``rows`` shuffled by ``keys`` into as many tasks as ``spark.sql.shuffle.partitions`` says, whatever their bytes, and
    more where ``count``, the number of rows, asks for more than ``ROWS_A_TASK`` in one.

    Adaptive execution puts partitions together by bytes; for rows that are few bytes and much work in Python, or that
    take many times their shuffled bytes in memory, that leaves too few tasks. A grouping by the same keys needs no shuffle of its own after this.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-count // ROWS_A_TASK)), *keys)


def listed_groups(rows: DataFrame, keys: list[str], columns: list[str], run: Callable[[list[tuple]], list[tuple]], schema: StructType) -> DataFrame:
    """keys and what ``run`` makes of the rows (tuples of ``columns``, in no order) of each group.

    For small groups: Spark lists them and Python takes a batch of lists at a time. A pandas frame for each group costs
    milliseconds, many times what there is to do in it. ``schema``: keys, then the fields of ``run``'s rows.
    """
    listed = spread(rows.select(*keys, F.struct(*columns).alias("_r")), *keys).groupBy(*keys).agg(F.collect_list("_r").alias("_all"))
    flat = listed.select(*keys, F.size("_all").alias("_n"), *[F.col(f"_all.{c}").alias(f"_{i}") for i, c in enumerate(columns)])
    shape, k = to_arrow_schema(schema), len(keys)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner, at = [], [], 0
            cells = list(zip(*(b.column(k + 1 + i).flatten().to_pylist() for i in range(len(columns)))))
            for i, n in enumerate(b.column(k).to_pylist()):
                mine = run(cells[at : at + n])
                found += mine
                owner += [i] * len(mine)
                at += n
            rows = pa.array(owner, pa.int64())
            made = [pa.array(c, f.type) for c, f in zip(zip(*found), list(shape)[k:])] if found else [pa.array([], f.type) for f in list(shape)[k:]]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows).cast(shape[i].type) for i in range(k)), *made], schema=shape)

    return flat.mapInArrow(batches_of, schema)
