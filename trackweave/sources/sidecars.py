"""Readers of JSON sidecars as long tables, and writers that append or merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = "video string, fps double, every int, tracker string, frames map<string, array<struct<tid: int, box: array<double>>>>"
IDENTITIES = "video string, overlap struct<collapse: map<string, array<array<int>>>, retired: map<string, int>, unvouched: map<string, double>>, identities map<string, struct<number: string, club: string, name: string, ignored: string, merged_into: int, duplicate_of: int>>, labels map<string, string>"
TRUTH = "video string, boxes string, fps double, tracks map<string, struct<player: string, club: string, segments: array<array<string>>>>"
COCO = "images array<struct<id: bigint, file_name: string, width: int, height: int>>, annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>>>"
CALIBRATION = "frames array<struct<frame: int, solved: boolean, suspect: boolean, interpolated: boolean, reason: string, rms_px: double, H_court_to_image: array<array<double>>>>"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with ``clip``: the file's name without its extension."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.withColumn("clip", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))


def corners(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """clip, fps, every, frame, tid, x1, y1, x2, y2."""
    d = documents(spark, path, TRACKS)
    rows = d.select("clip", "fps", "every", F.explode("frames").alias("frame", "rows"))
    rows = rows.select("clip", "fps", "every", F.col("frame").try_cast("int").alias("frame"), F.explode("rows").alias("r"))
    return rows.select("clip", "fps", "every", "frame", F.col("r.tid").alias("tid"), *corners(F.col("r.box")))


def identities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Identity rows by clip and track, and the closed collapse spans."""
    d = documents(spark, path, IDENTITIES)
    rows = d.select("clip", F.explode("identities").alias("tid", "i")).select("clip", F.col("tid").try_cast("int").alias("tid"), "i.*")
    spans = d.select("clip", F.explode("overlap.collapse").alias("tid", "spans")).select("clip", F.col("tid").try_cast("int").alias("tid"), F.explode("spans").alias("s"))
    return rows, spans.select("clip", "tid", F.get("s", F.lit(0)).alias("start"), F.get("s", F.lit(1)).alias("end"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """clip, tid, seg_ix, number, start, end, club (null in three-field segments)."""
    rows = documents(spark, path, TRUTH).select("clip", F.explode("tracks").alias("tid", "t"))
    rows = rows.select("clip", F.col("tid").try_cast("int").alias("tid"), F.posexplode("t.segments").alias("seg_ix", "s"))
    at = lambda i: F.get("s", F.lit(i))
    return rows.select("clip", "tid", "seg_ix", at(0).alias("number"), at(1).cast("int").alias("start"), at(2).cast("int").alias("end"), at(3).alias("club"))


def roster(spark: SparkSession, path: str) -> DataFrame:
    """club, number (as text), name: every key of the document that holds a list is a club."""
    text = spark.read.text(path, wholetext=True)
    clubs = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("club", "rows")).where(F.startswith(F.ltrim("rows"), F.lit("[")))
    rows = clubs.select("club", F.explode(F.from_json("rows", "array<struct<num: string, name: string>>")).alias("r"))
    return rows.select("club", F.col("r.num").alias("number"), F.col("r.name").alias("name"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """clip, frame, h (row-major) of the usable frames: solved and not suspect."""
    rows = documents(spark, path, CALIBRATION).select("clip", F.explode("frames").alias("f")).select("clip", "f.*")
    usable = rows.where("solved and not coalesce(suspect, false)")
    return usable.select("clip", "frame", F.coalesce("interpolated", F.lit(False)).alias("interpolated"), "rms_px", F.flatten("H_court_to_image").alias("h"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image and annotation; images without any stay."""
    d = documents(spark, path, COCO)
    images = d.select("clip", F.explode("images").alias("i")).select("clip", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    marks = d.select("clip", F.explode("annotations").alias("a")).select("clip", F.col("a.image_id").alias("image_id"), F.col("a.id").alias("annotation_id"), F.col("a.category_id").alias("category_id"), "a.bbox")
    return images.join(marks, ["clip", "image_id"], "left")


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of KEY=VALUE lines: blanks, comments and lines without "=" left out, quotes stripped."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    at = F.instr("line", "=")
    value = F.trim(F.substr("line", at + 1))
    return rows.select(F.trim(F.substring("line", F.lit(1), at - 1)).alias("key"), F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2").alias("value"))


def cache_is_valid(document: DataFrame, video: str, **least: float) -> Column:
    """Whether a cached document is of this video and no stricter than asked (``least``: column -> highest value allowed)."""
    ok = F.col("video") == video
    for column, limit in least.items():
        ok &= F.col(column) <= limit + 1e-9
    return ok


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table at ``path`` does not have."""
    old = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*keys)
    rows.dropDuplicates(keys).join(old, keys, "left_anti").write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def backup_once(spark: SparkSession, path: str, backup: str) -> bool:
    """Copy the table at ``path`` to ``backup`` if nothing is there yet; whether it did."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(backup)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return False
    spark.read.parquet(path).write.parquet(backup)
    return True


def with_provenance(source: Column, note: str) -> Column:
    """A source text with ``note`` appended, once."""
    return F.when(F.contains(F.coalesce(source, F.lit("")), F.lit(note)), source).otherwise(F.concat(F.coalesce(source, F.lit("")), F.lit(" \u00b7 "), F.lit(note)))


def sidecar_videos(spark: SparkSession, path: str, suffix: str = "_tracks") -> DataFrame:
    """stem, video of the tracks sidecars under ``path``: which clip a route ran on."""
    d = documents(spark, path, TRACKS)
    return d.select(F.regexp_replace("clip", f"{suffix}$", "").alias("stem"), "video").where("video is not null")


def cached_vectors(spark: SparkSession, path: str, words: list[str] | None = None) -> DataFrame | None:
    """frame, det, vector of a vector cache in Parquet; None if there is none, or if it was made with other ``words``.

    Columns frame, det, vector and, for scores of words, words (array).
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(path)
    if words is not None and not rows.where(~F.col("words").eqNullSafe(F.array(*map(F.lit, words)))).isEmpty():
        return None
    return rows.select("frame", "det", "vector")
