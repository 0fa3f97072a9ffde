"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in DataFrame operations only.

A paragraph is a line, cut every ``unit`` characters; its digest is a 64-bit hash. Each
distinct digest goes into one cell of each third of the table; a cell has the number of
its digests, their XOR and the XOR of their check hashes. A third has a power of two of
cells, at least twice as many as there are digests and at least ``least``; only filled cells
are kept. The fingerprint is that table with its width.

Two versions are compared by their fingerprints: the wider table is folded to the width of
the other, the tables are subtracted cell by cell, and the difference is peeled: a cell with one
digest (its check hash tells) gives up that digest, which leaves its other cells, and so on.
If cells remain, as when one version is very much longer, a larger table of each version,
sized for all digests of both, is built and subtracted, then a still larger one. Should even
these not come apart, the digest sets themselves are compared. What one side alone has
gives the likeness, shared over all paragraphs (1 when both have none); the ``level`` columns tell
which table it came from: 1 the fingerprints, 2 and 3 the larger ones, 0 the sets.

Null texts are empty. Rows with the same id follow each other in the order of their texts;
rows with a null id come first and the last row is followed by the first with an id.
Equal texts have equal fingerprints. A single row is its own next. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 24
#: Ranges of ids in which neighbours meet.
LEAST_RANGES, MOST_RANGES = 256, 1 << 16


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digests(text: Column, unit: int) -> Column:
    """Distinct paragraph digests of a text."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{unit}}}"), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def width_for(count: Column, times: int, least: int) -> Column:
    """Cells of a third: the power of two from ``times`` as many as ``count`` and from ``least`` on."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(count * times, F.lit(least)).cast("double")))).cast("long")


def entry(key: Column, sign: Column, third: int, width: Column) -> Column:
    """What ``key`` adds to its cell in one third of a table; a cell's number is its place in the third times three plus the third."""
    cell = F.lit(third) + 3 * F.pmod(F.xxhash64(key, F.lit(third)), width)
    return F.struct(cell.cast("long").alias("c"), sign.cast("long").alias("n"), key.alias("k"), F.xxhash64(key, F.lit(99)).alias("h"))


def entries(pairs: Column, width: Column) -> Column:
    """Entries of all thirds, for an array of (key, sign)."""
    return F.flatten(F.transform(pairs, lambda x: F.array(*[entry(x["k"], x["n"], third, width) for third in range(3)])))


def folded(cells: Column, width: Column, sign: int = 1) -> Column:
    """The cells of a table (``sign`` -1: taken away) where they stand in one of no greater ``width``; cells that meet are not yet added up."""
    place = lambda c: c % 3 + 3 * (F.floor(c / 3) % width)
    return F.transform(cells, lambda x: F.struct(place(x["c"]).cast("long").alias("c"), (sign * x["n"]).alias("n"), x["k"].alias("k"), x["h"].alias("h")))


def summed(cells: Column) -> Column:
    """Cells added up by number, in order, without the empty ones."""

    def total(run: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
        added = F.aggregate(run, first, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))
        return let(added, lambda a: F.struct(F.get(run, F.lit(0))["c"].alias("c"), a["n"].alias("n"), a["k"].alias("k"), a["h"].alias("h")))

    def runs(e: Column) -> Column:
        first_of_run = F.filter(F.when(F.size(e) > 0, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.when(i == 0, True).otherwise(F.get(e, i)["c"] != F.get(e, i - 1)["c"]))

        def cell(at: Column, end: Column) -> Column:
            """Most cells have one entry, which is their sum."""
            return F.when(end - at == 1, F.get(e, at)).otherwise(total(F.slice(e, at + 1, end - at)))

        return let(first_of_run, lambda s: F.transform(s, lambda at, j: cell(at, F.coalesce(F.get(s, j + 1), F.size(e)))))

    return F.filter(let(F.sort_array(cells), runs), lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))


def signed(keys: str, sign: int) -> Column:
    """(key, sign) of every digest of a column."""
    return F.transform(F.col(keys), lambda k: F.struct(k.alias("k"), F.lit(sign).cast("long").alias("n")))


def table(keys: str, width: Column) -> Column:
    """The lookup table of a column's digest set."""
    return summed(entries(signed(keys, 1), width))


def minus(a: Column, b: Column, width: Column) -> Column:
    """Cells of one table less those of another, both folded to ``width``."""
    return summed(F.concat(folded(a, width), folded(b, width, -1)))


def peeled(cells: Column, width: Column) -> Column:
    """(cells left, signed digests recovered) after peeling a difference."""
    none = F.array().cast("array<struct<k:bigint,n:bigint>>")

    def alone(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["h"] == F.xxhash64(x["k"], F.lit(99)))

    def given(left: Column, sign: int) -> Column:
        """The distinct digests of one side that cells give up."""
        keys = F.array_distinct(F.transform(F.filter(left, lambda x: (x["n"] == sign) & alone(x)), lambda x: x["k"]))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).cast("long").alias("n")))

    def without(left: Column, found: Column) -> Column:
        """A cell that gives up its digest is empty then; the others lose those digests that they have a part of."""
        rest = F.filter(left, lambda x: ~alone(x))
        gone = entries(F.transform(found, lambda x: F.struct(x["k"].alias("k"), (-x["n"]).alias("n"))), width)
        return let(rest, lambda r: F.when(F.size(r) == 0, r).otherwise(let(F.transform(r, lambda x: x["c"]), lambda cs: summed(F.concat(r, F.filter(gone, lambda x: F.array_contains(cs, x["c"])))))))

    def peel(state: Column, _: Column) -> Column:
        pure = F.when(F.size(state["left"]) == 0, none).otherwise(F.concat(given(state["left"], 1), given(state["left"], -1)))
        return let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(F.struct(without(state["left"], p).alias("left"), F.concat(state["found"], p).alias("found"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("left"), none.alias("found")), peel)


def shared_share(own: Column, other: Column, missing: Column) -> Column:
    """Likeness of sets of sizes ``own`` and ``other`` when ``missing`` of the first are not in the second."""
    return F.when(own + other == 0, F.lit(1.0)).otherwise((own - missing) / (other + missing))


def compared(pairs: DataFrame, other: str) -> DataFrame:
    """``pairs`` with near_``other``, the likeness of (keys, table, width) to (``other``_keys, ``other``_table, ``other``_width), and its level.

    One step of the comparison is one projection, so the plan stays shallow; larger tables
    are built only for rows whose smaller ones did not come apart.
    """
    missing, level = f"_missing_{other}", f"{other}_level"
    pairs = pairs.withColumn("_width", F.least("width", f"{other}_width"))
    pairs = pairs.withColumn("_cells", minus(F.col("table"), F.col(f"{other}_table"), F.col("_width")))
    pairs = pairs.withColumn("_state", peeled(F.col("_cells"), F.col("_width"))).withColumn(missing, one_sided(F.col("_state")))
    pairs = pairs.withColumn(level, F.when(F.col(missing).isNotNull(), 1))
    for number, times in ((2, 2), (3, 16)):
        pairs = pairs.withColumn("_width", F.when(F.col(missing).isNull(), width_for(F.size("keys") + F.size(f"{other}_keys"), times, 64 * times)))
        open_ = F.col("_width").isNotNull()
        larger = [F.when(open_, table(k, F.col("_width"))).alias(f"_{k}") for k in ("keys", f"{other}_keys")]
        pairs = pairs.select("*", *larger).withColumn("_cells", F.when(open_, minus(F.col("_keys"), F.col(f"_{other}_keys"), F.col("_width")))).drop("_keys", f"_{other}_keys")
        pairs = pairs.withColumn("_state", F.when(open_, peeled(F.col("_cells"), F.col("_width"))))
        pairs = pairs.withColumn(missing, F.coalesce(missing, one_sided(F.col("_state")))).withColumn(level, F.coalesce(level, F.when(F.col(missing).isNotNull(), number)))
    exact = F.size(F.array_except("keys", f"{other}_keys"))
    share = shared_share(F.size("keys"), F.size(f"{other}_keys"), F.coalesce(missing, exact))
    pairs = pairs.withColumn(f"near_{other}", share).withColumn(level, F.coalesce(level, F.lit(0)))
    return pairs.drop("_cells", "_state", "_width", missing, f"{other}_keys", f"{other}_table", f"{other}_width")


def one_sided(state: Column) -> Column:
    """How many recovered digests the first side alone has; null if cells are left."""
    return F.when(F.size(state["left"]) == 0, F.size(F.filter(state["found"], lambda x: x["n"] > 0)))


def written_table(cells: Column, width: Column) -> Column:
    """A table as text: base 64 of its width and (cell, count, XOR, low half of the check XOR) of its filled cells, 8 hex digits each and 16 for the XOR."""
    eight = lambda v: F.lpad(F.hex(v), 8, "0")
    part = lambda x: F.concat(eight(x["c"]), eight(x["n"]), F.lpad(F.hex(x["k"]), 16, "0"), F.right(F.lpad(F.hex(x["h"]), 16, "0"), F.lit(8)))
    return F.base64(F.unhex(F.concat(eight(width), F.array_join(F.transform(cells, part), ""))))


def bucket_of(doc_id: Column, bounds: list, kind: str) -> Column:
    """Number of ascending bounds at or below an id, by binary search in a constant array."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fixed = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
    at = lambda low, step, b: F.when((low + step <= len(bounds)) & (F.get(b, low + step - 1) <= doc_id), low + step).otherwise(low)
    search = let(fixed, lambda b: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: at(low, step, b)))
    return F.when(doc_id.isNull() | F.lit(not bounds), 0).otherwise(search if bounds else F.lit(0))


def with_next(docs: DataFrame, columns: list[str], rows_a_bucket: int) -> DataFrame:
    """docs(doc_id, text, columns...) with next: a struct of ``columns`` of the next row by id.

    Rows meet in ranges of the id, so the whole table is shuffled once; each range also gets
    the next range's first row. There are ``LEAST_RANGES`` to ``MOST_RANGES`` ranges of about
    ``rows_a_bucket`` rows (bounds by approximate percentiles); these bounds and as many
    first ids are all that the driver sees.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-docs.select("doc_id").count() // rows_a_bucket)))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
    placed = docs.withColumn("_bucket", bucket_of(F.col("doc_id"), sorted(set(cuts or [])), kind))
    firsts = sorted((r["_bucket"], r["low"]) for r in placed.groupBy("_bucket").agg(F.min("doc_id").alias("low")).collect() if r["low"] is not None)
    borders = [(low, before) for (before, _), (_, low) in zip(firsts, firsts[1:])]
    borders += [(firsts[0][1], firsts[-1][0])] if firsts else []
    table = F.broadcast(spark.createDataFrame(borders, f"doc_id {kind}, _before int"))  # at most MOST_RANGES rows
    ghosts = placed.join(table, "doc_id").withColumn("_bucket", F.col("_before")).drop("_before")
    out = placed.withColumn("_ghost", F.lit(0)).unionByName(ghosts.withColumn("_ghost", F.lit(1)))
    ordered = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")
    following = F.lead(F.struct(*columns)).over(ordered)
    return out.withColumn("_next", following).where("_ghost = 0").drop("_ghost", "_bucket")


def fingerprints(docs: DataFrame, *, least: int = 64, unit: int = 96, rows_a_bucket: int = 20_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_level, next_level of every row."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("keys", digests(F.col("text"), unit))
    own = F.struct(F.col("text").alias("text"), F.col("keys").alias("keys"))
    both = with_next(base, ["text", "keys"], rows_a_bucket).withColumn("_next", F.coalesce("_next", own))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("_next.text"), F.lit(1), half))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "keys", F.col("_next.keys").alias("next_keys"), edited.alias("edited"))
    both = both.withColumn("edited_keys", digests(F.col("edited"), unit)).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    names = {"keys": "", "edited_keys": "edited_", "next_keys": "next_"}
    both = both.select("*", *[width_for(F.size(k), 2, least).alias(f"{p}width") for k, p in names.items()])
    both = both.select("*", *[table(k, F.col(f"{p}width")).alias(f"{p}table") for k, p in names.items()])
    written = [written_table(F.col(f"{p}table"), F.col(f"{p}width")).alias(f"{p}fingerprint") for p in ("", "edited_")]
    out = compared(compared(both.select("*", *written), "edited"), "next")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_level", "next_level")
