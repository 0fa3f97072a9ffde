import math
import re

from pyspark.sql import functions as F

from trackweave.llm.quality_rules import RULES, binomial_tail, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    twice = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), n < 10 or 100 * len(twice) > 20 * n)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_columns_equal_brute_force(spark, awkward, awkward_docs):
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(awkward_docs, labels(spark, [(1, 1, 0), (4, None, 0), (4, 0, 0)])).collect()}
    assert got == {r[0]: brute(r[1]) for r in awkward}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_binomial_tail(spark):
    cases = [(0, 0, 0.1), (50, 0, 0.1), (50, 3, 0.1), (1000, 2, 0.01), (20000, 150, 0.01), (10, 5, 0.1)]
    for n, r, p in cases:
        got = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(r).cast("long").alias("r")).select(binomial_tail(F.col("n"), F.col("r"), p)).first()[0]
        want = 1.0 if r > n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(r + 1))
        assert math.isclose(got, want, rel_tol=1e-8), (n, r, p)


def test_cutoffs_are_proven_in_each_stratum_and_reject_junk(spark):
    clean = [(i, " ".join(f"word{chr(97 + (i * j) % 26)}{j}" for j in range(30)), "en" if i % 2 else "fr") for i in range(4000)]
    junk = [(9000 + i, " ".join(f"#w{i}{j}$ &%" for j in range(20)), "en") for i in range(40)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    out = quality_rules(docs, labels(spark, [(i, 1, 0) for i, _, _ in clean]))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i, _, _ in clean)
    assert not any(kept[i] for i, _, _ in junk)
    few = quality_rules(docs, labels(spark, [(i, 1, 0) for i in range(50)]))
    assert few.where("not kept").count() == 0, "fifty labels prove nothing, so nothing is rejected"
    assert len(RULES) == 7


def test_empty_tables(spark, no_docs):
    assert quality_rules(no_docs, labels(spark, [])).count() == 0
