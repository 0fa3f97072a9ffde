"""Column expressions on names, clocks, paths and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_reading(a: Column, b: Column) -> Column:
    """Whether one number is the other with digits missing at one end (equal numbers are)."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.startswith(long, short) | F.endswith(long, short)


def is_digits(reading: Column) -> Column:
    return F.trim(reading).rlike("^[0-9]+$")


def surname(name: Column) -> Column:
    """Last word of a name with the suffixes after it; a single word is itself."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(name), r"(?i)(\S+(?:\s+(?:jr|sr|ii|iii|iv|v)\.?)*)$", 1), F.lit("")), F.trim(name))


def chip(number: Column, name: Column) -> Column:
    """``#number surname``; null without a number."""
    return F.when(number.isNotNull(), F.trim(F.concat(F.lit("#"), number, F.lit(" "), F.coalesce(surname(name), F.lit("")))))


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``m:ss`` or of a plain number."""
    parts = F.split(clock, ":")
    return F.when(F.contains(clock, F.lit(":")), F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")).otherwise(clock.try_cast("double"))


def clock_text(seconds: Column) -> Column:
    """``m:ss`` of whole seconds."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def duration_text(seconds: Column) -> Column:
    """Rough length of time: seconds, minutes or hours."""
    return F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), F.lpad(F.floor((seconds % 3600) / 60).cast("string"), 2, "0"), F.lit("m")))


def padded_clock(seconds: Column, rounded: bool = False) -> Column:
    """``mm:ss``; the seconds of the minute cut off, or rounded (then up to 60)."""
    part = seconds - F.floor(seconds / 60) * 60
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (F.floor(part + 0.5) if rounded else F.floor(part)).cast("int"))


def tenths(x: Column) -> Column:
    """Number of tenths nearest to a double, the even one half-way, judged by its exact value as C's %.1f does.

    Spark's format_string rounds the shortest decimal half up: 3.55, just under it as a double, becomes 3.6. Here
    x * 20 - (2 * low + 1) is added up from parts without a rounding error near 0.
    """
    low = F.floor(x * 10)
    middle = (2 * low + 1).cast("double")
    side = (x * 16 - middle) + x * 4
    return F.when((side > 0) | ((side == 0) & (low % 2 != 0)), low + 1).otherwise(low)


def one_decimal(x: Column) -> Column:
    """A number not below 0 as text with one decimal."""
    text = F.concat(F.floor(tenths(x) / 10).cast("string"), F.lit("."), (tenths(x) % 10).cast("string"))
    return F.when(x < 1e14, text).otherwise(F.format_string("%.1f", x))  # beyond, tenths are no doubles


def tenths_clock(seconds: Column) -> Column:
    """``m:ss.s``, as a player's timeline shows it."""
    part = (seconds - F.floor(seconds / 60) * 60).cast("double")
    return F.concat(F.floor(seconds / 60).cast("int").cast("string"), F.lit(":"), F.lpad(one_decimal(part), 4, "0"))


def eta_text(seconds: Column) -> Column:
    """Seconds under 90, minutes under 5400, else hours with a tenth; a dash for what is unknown or negative."""
    known = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0)
    whole = lambda x: F.rint(x).cast("bigint").cast("string")
    text = F.when(seconds < 90, F.concat(whole(seconds), F.lit("s"))).when(seconds < 5400, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(F.concat(one_decimal(seconds / 3600), F.lit("h")))
    return F.when(known, text).otherwise(F.lit("-"))


def stamp(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def iso(seconds: Column) -> Column:
    """Epoch seconds in ISO 8601 with milliseconds, UTC where the session is."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def top_counts(values: Column, k: int) -> Column:
    """The ``k`` most frequent values of an array with their counts; the one that comes first on a tie."""
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda v, i: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda c: F.struct(c["v"].alias("value"), (-c["n"]).alias("count")))


def inverted(mapping: Column) -> Column:
    """A map the other way round; of keys with one value the largest counts."""
    pairs = F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["v"] != p["v"], F.lit(True)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["v"], p["k"])))


def original_name(file_name: Column) -> Column:
    """An exported image's name without the export's hash and extension."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.rf\.[^.]*", ""), r"(\.jpg|_jpg)+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def assignment(text: Column) -> tuple[Column, Column]:
    """Both sides of ``KEY=VALUE``, cut at the first equals sign and trimmed."""
    at = F.instr(text, "=")
    return F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))), F.when(at > 0, F.trim(F.substr(text, at + 1)))


def embedded_json(text: Column) -> Column:
    """The outermost braces of a text, null unless they hold valid JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def segment_name(start: Column, seconds: Column) -> Column:
    return F.format_string("seg_%02dm%05.2fs_%ds", F.floor(start / 60).cast("int"), start - F.floor(start / 60) * 60, F.round(seconds).cast("int"))


def play_kind(text: Column, scoring: Column) -> Column:
    low = F.lower(text)
    has = lambda a, b: F.contains(low, F.lit(a)) | F.contains(low, F.lit(b))
    return F.when(F.contains(low, F.lit("rebound")), "board").when(has("turnover", "steal"), "loss").when(scoring | has("makes", "misses"), "score").otherwise("other")


ROUTE_SUFFIXES = ("_tracks.json", "_oncourt_tracks.json", "_ident.json", "_report.json")


def route(artifact: Column) -> Column:
    """An artefact's run: its base name without the first suffix of the list that fits; null without any."""
    name = basename(artifact)
    out = F.lit(None).cast("string")
    for suffix in reversed(ROUTE_SUFFIXES):
        out = F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out
