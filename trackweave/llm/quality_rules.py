"""Quality rules whose cutoffs carry a guarantee, in DataFrame operations only.

Every rule rejects a text when one measured feature exceeds a cutoff. For each stratum (a
language; rows without one together) and each rule the
cutoff comes from a fixed grid: the strictest one at which the labelled good documents
prove, by the exact binomial (Clopper-Pearson) test, that at most ``risk / rules`` of good
documents are rejected. All grid cells of all strata are tested together at level
``alpha`` by Bonferroni's correction, so with probability ``1 - alpha`` no stratum loses
more than ``risk`` of its good documents to all rules together. Where the labels cannot
prove any cutoff the rule rejects nothing.

Null and empty texts have no words, so the base rule rejects them. Labels with a null
quality are ignored; a document with several labels is good if all of them say so. Equal
texts of a stratum get equal verdicts. An empty table gives no rows; extra columns of the
documents are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import BROADCAST_ROWS, written

BLANK = r"[\x20\x09-\x0D]+"
GOOD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

_SHARE = [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5]
#: rule -> (feature over the base columns, cutoffs from the strictest on)
RULES: dict[str, tuple[Callable[[], Column], list[float]]] = {
    "symbols": (lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), _SHARE),
    "duplicate_lines": (lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), _SHARE),
    "repeated_words": (lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), _SHARE),
    "capitals": (lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)), _SHARE),
    "marks": (lambda: F.col("n_marks") / F.greatest("word_chars", F.lit(1)), _SHARE),
    "long_words": (lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)), [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_words": (lambda: -F.col("word_chars") / F.greatest("n_words", F.lit(1)), [-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0]),
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{BLANK}|{BLANK}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that the text has twice or more.

    Hashes tell the many texts without a repeated window; the rest sort their windows
    (compared as strings) with positions and add up what the repeated ones cover.
    """
    last = F.size(words) - width + 1

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("w"), i.alias("at")))
        return let(F.sort_array(windows), twice)

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        at = F.transform(F.filter(s, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1)), lambda x: x["at"])
        return let(F.sort_array(at), covered)

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 2, 0).when(some, let(words, exact)).otherwise(0)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base columns of every document."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*keep, text.alias("_text")).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(GOOD)))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    return found.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_capitals"),
        count("[!-/:-@^-`{-~\\[\\]\\\\]").alias("n_marks"),
    )


def binomial_tail(n: Column, r: Column, p: float) -> Column:
    """P(X <= r) for X ~ Bin(n, p), summed exactly from its terms; 1 where r exceeds n * p and no proof is possible."""
    odds = F.log(F.lit(p / (1 - p)))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(r > 0, F.sequence(F.lit(1).cast("long"), r)).otherwise(F.array().cast("array<bigint>"))
    return F.when(r > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda a: a["s"]))


def proven_cutoffs(good: DataFrame, *, risk: float, alpha: float) -> DataFrame:
    """stratum and one cutoff column a rule (null: none proven), from the features of labelled good documents."""
    cells = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.sum((feature() > c).cast("long")).alias("rejected")) for rule, (feature, cuts) in RULES.items() for c in cuts]
    tested = good.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*cells).alias("cells"))
    tests = tested.agg((F.count("*") * len(cells)).alias("tests"))
    cell = tested.select("stratum", "n", F.inline("cells")).crossJoin(F.broadcast(tests))  # one row: the number of tests
    passed = cell.where(binomial_tail(F.col("n"), F.col("rejected"), risk / len(RULES)) <= alpha / F.col("tests"))
    return passed.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, risk: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """doc_id, the base columns, base_failed and kept of every document."""
    base = written(measured(docs, ["doc_id", "lang"]))
    base = base.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("rest")))
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rated = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality > 0")
    good = base.where("not base_failed").join(rated, "doc_id", "left_semi")
    cutoffs = written(proven_cutoffs(good, risk=risk, alpha=alpha))  # a row for each language with a proven cutoff
    out = base.join(F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_ROWS else cutoffs, "stratum", "left")
    fine = F.lit(True)
    for rule, (feature, _) in RULES.items():
        fine &= F.coalesce(feature() <= F.col(rule), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"))
