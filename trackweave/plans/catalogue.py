"""Every registered query, loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.plans import box_queries, boxscore_queries, calibration_queries, correction_queries, filter_queries, identity_queries, kernel_queries, measure_queries, plane_queries, report_queries, run_queries, span_queries, stream_queries, time_queries, vote_queries  # noqa: F401
from trackweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and coverage of an identity assignment, by clip."""
    return QUERIES["identity_score"](spark, sf_dir)
