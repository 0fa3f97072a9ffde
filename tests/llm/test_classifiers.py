import random
import zlib

import numpy as np

from trackweave.llm import language_id, quality_classifier
from trackweave.llm.queries import op2_language_id


def rated(spark, n=240):
    rng = random.Random(4)
    words = [f"{a}{b}on" for a in "bcdfg" for b in "aeiou"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        g = i % 3
        if g == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "foul"])
        if g == 1:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(g != 1), int(g == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_grades_are_learned_and_ordered(spark):
    docs, labels = rated(spark)
    model = quality_classifier.learned(docs.where("doc_id < 180"), labels)
    assert np.all(np.diff(model.thresholds) > 0)
    out = {r.doc_id: r for r in quality_classifier.grade(docs, model).collect()}
    for r in out.values():
        assert 0 <= r.p_above_1 <= r.p_above_0 <= 1 and abs(r.expected_grade - r.p_above_0 - r.p_above_1) < 1e-9
    fresh = [i for i in out if i >= 180]
    assert sum((out[i].kept) == (i % 3 == 2) for i in fresh) >= 0.95 * len(fresh)
    assert sum((out[i].p_above_0 < 0.5) == (i % 3 == 0) for i in fresh) >= 0.95 * len(fresh)


def test_awkward_rows(spark, awkward_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (4, None, 1), (4, 1, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    grades = {r.doc_id: r.grade for r in quality_classifier.ratings(labels).collect()}
    assert grades == {1: 2, 4: 0}
    model = quality_classifier.learned(awkward_docs, labels)
    assert quality_classifier.grade(awkward_docs, model).count() == awkward_docs.count()
    assert quality_classifier.grade(no_docs, quality_classifier.learned(no_docs, labels.limit(0))).count() == 0


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = op2_language_id(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in out} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_uses_no_held_out_row_and_no_label_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'xx' else lang end as lang", "text", "'s' as source")
    a, b = language_id.learned(docs), language_id.learned(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)
    blind = changed.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert sorted(language_id.identify(docs, a).collect()) == sorted(language_id.identify(blind, a).collect())


def test_language_of_awkward_rows(spark, awkward, awkward_docs, no_docs):
    model = language_id.learned(awkward_docs)
    out = {r.doc_id: r for r in language_id.identify(awkward_docs, model).collect()}
    for i, text, *_ in awkward:
        if not any(c.isalpha() for c in text or ""):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
        else:
            assert out[i].lang_pred in model.languages
    assert language_id.identify(no_docs, language_id.learned(no_docs)).count() == 0


def test_texts_of_digits_fractions_and_numerals_have_no_letter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learned(docs)
    texts = ["½ ② Ⅷ", "12 _ ٣", "², ¾", "Ⅷ a", "中", None]
    found = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert [r.lang_pred == "und" for r in found.orderBy("doc_id").collect()] == [True, True, True, False, False, True]


def test_scores_equal_a_plain_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    model = language_id.learned(docs)
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        logits, mass = np.zeros(len(model.languages)), 0.0
        for word in language_id.letter_runs(r.text):
            for c in language_id.gram_cells([word])[0]:
                logits += model.idf[c] * model.weights[c]
                mass += model.idf[c]
        if mass:
            e = np.exp((logits / mass + model.bias) / model.temperature)
            assert abs(max(e / e.sum()) - out[r.doc_id].score) < 1e-6
            assert out[r.doc_id].lang_pred == model.languages[int(np.argmax(e))]


def test_cells_of_a_word_are_those_of_its_grams():
    words = ["a", "été", "中", "zebra"]
    cells, n = language_id.gram_cells(words)
    for word, found in zip(words, np.split(cells, np.cumsum(n)[:-1])):
        w = f"\x02{word}\x03"
        assert len(found) == sum(len(w) - k + 1 for k in (1, 2, 3)) - 1
        assert np.array_equal(found, language_id.gram_cells([word])[0])
    same = {w: set(language_id.gram_cells([w])[0].tolist()) for w in ("ab", "xab")}
    assert len(same["ab"] & same["xab"]) >= 5  # a, b, end; ab, b-end; ab-end


def test_follow_the_leader_step_equals_the_rule_by_coordinate():
    from trackweave.llm.ftrl import Ftrl

    rng, model = np.random.default_rng(3), Ftrl(6, 2, alpha=0.4, l1=0.3, l2=0.1)
    z, n = np.zeros((6, 2)), np.zeros((6, 2))
    for _ in range(50):
        ids = rng.permutation(6)[:3]
        g = rng.normal(size=(3, 2))
        for row, i in enumerate(ids):
            for k in range(2):
                w = 0.0 if abs(z[i, k]) <= 0.3 else -(z[i, k] - np.sign(z[i, k]) * 0.3) / ((1 + n[i, k] ** 0.5) / 0.4 + 0.1)
                z[i, k] += g[row, k] - ((n[i, k] + g[row, k] ** 2) ** 0.5 - n[i, k] ** 0.5) / 0.4 * w
                n[i, k] += g[row, k] ** 2
        model.step(ids, g)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learned(docs)
    a, b = [r.text for r in docs.where("length(text) > 200").dropDuplicates(["lang"]).orderBy("lang").limit(2).collect()]
    twice = language_id.identify(spark.createDataFrame([(5, a), (5, b), (5, a)], "doc_id long, text string"), model).collect()
    alone = {language_id.identify(spark.createDataFrame([(5, t)], "doc_id long, text string"), model).first() for t in (a, b)}
    assert len(twice) == 3 and set(twice) == alone
