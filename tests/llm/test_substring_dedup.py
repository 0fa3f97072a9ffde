import hashlib
import random

import pyarrow as pa
from test_suffix_dedup import repeated_id_rows

from trackweave.llm.common import word_units
from trackweave.llm.substring_dedup import repeated_spans, substring_dedup


def brute(rows, width=13):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for a in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][a : a + width]), i)
    for i, words in split.items():
        gone = set()
        for a in range(len(words) - width + 1):
            if first[tuple(words[a : a + width])] < i:
                gone.update(range(a, a + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_awkward_rows_equal_brute_force(spark, awkward, awkward_docs):
    want = brute([(r[0], r[1]) for r in awkward])
    assert result(substring_dedup(awkward_docs)) == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_colliding_hashes_do_not_change_the_result(spark, awkward, awkward_docs):
    assert result(substring_dedup(awkward_docs, hash_bits=6)) == brute([(r[0], r[1]) for r in awkward])


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(substring_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_passage_is_one_span_with_its_source(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"d{i}w{j}" for j in range(30)] + passage + [f"d{i}z{j}" for j in range(30)])) for i in range(5)]
    spans = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(spans) == [1, 2, 3, 4]
    assert all((r.start, r.end, r.first_doc, r.first_at) == (30, 90, 0, 30) for r in spans.values())


def test_null_id_and_empty_table(spark, no_docs):
    text = " ".join(f"w{i}" for i in range(20))
    got = sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")).collect())
    assert got == [(False, 0), (False, 20), (True, 0)]
    assert substring_dedup(no_docs).count() == 0


def test_rows_with_one_id_are_judged_each_by_itself(spark):
    rows = repeated_id_rows()
    words = [f"w{i}" for i in range(26)]
    rows += [(1, " ".join(words)), *[(9, " ".join([*words[:13], *[f"x{k}" for k in range(37)], *words[13:]]))] * 50]
    before, want = {}, []
    for i, text in rows:
        split = text.encode().split()
        for a in range(len(split) - 12):
            w = tuple(split[a : a + 13])
            before[w] = min(i, before.get(w, i))
    for i, text in rows:
        split = text.encode().split()
        gone = {k for a in range(len(split) - 12) if before[tuple(split[a : a + 13])] < i for k in range(a, a + 13)}
        want.append((i, len(split), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(split) if k not in gone)).hexdigest()))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_words_are_hashed_by_column_as_by_themselves():
    """Slices, nulls, blanks, words around the length of a block and of ``LONG_WORD``, and white space that only Unicode knows."""
    rng = random.Random(5)
    some = [None, "", " ", "a", "é ü\x1c\x1f z q", "\t\n\x0b\x0c\r w", "12345678 123456789", *["x" * n for n in (7, 8, 9, 255, 256, 257, 600)]]
    texts = [" ".join(str(rng.choice(some) or "") for _ in range(rng.randrange(4))) if rng.random() < 0.7 else None for _ in range(400)]
    for size in (1, 50, 1 << 22):
        found = list(word_units(pa.array(["left out", *texts], pa.string())[1:], size))
        assert len(found) == len(texts)
        told = {}
        for text, units in zip(texts, found):
            words = (text or "").encode().split()
            assert len(words) == len(units)
            for word, unit in zip(words, units.tolist()):
                assert told.setdefault(word, unit) == unit
        assert len(set(told.values())) == len(told)
    assert list(word_units(pa.array([], pa.string()))) == []
