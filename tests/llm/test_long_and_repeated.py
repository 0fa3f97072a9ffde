"""A text of five megabytes, and rows of one id with different texts, through the operators and the pipeline's stages."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from test_ngram_join import brute_set
from tokenizers import Tokenizer

from trackweave.llm import language_id, quality_classifier
from trackweave.llm.bpe import encode_decode
from trackweave.llm.fingerprints import fingerprints
from trackweave.llm.ngram_join import jaccard_components
from trackweave.llm.packing import pack
from trackweave.llm.pretokens import PATTERN
from trackweave.llm.quality_rules import quality_rules
from trackweave.llm.queries import vocabulary
from trackweave.llm.substring_dedup import substring_dedup
from trackweave.llm.suffix_dedup import suffix_dedup
from trackweave.llm.superminhash import near_duplicates
from trackweave.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40_000)]
    text = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(64_000))
    assert len(text) > 4_900_000
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    """The long text, the same with another end, and a short one that stands in it."""
    rows = [(1, long_text, "en", "s", None), (2, long_text[:-2_000] + " another end", "en", "s", None), (3, long_text[1_000_000:1_003_000], "en", "s", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts_in_joins_and_near_copies(docs, long_text):
    sets = {4: len(brute_set(long_text, 4)), 5: len(brute_set(long_text, 5))}
    joined, near = by_id(jaccard_components(docs)), by_id(near_duplicates(docs, num=85, den=100))
    assert (joined[1].n_shingles, near[1].n_shingles) == (sets[4], sets[5])
    assert [joined[i].component_id for i in (1, 2, 3)] == [near[i].component_id for i in (1, 2, 3)] == [1, 1, 3]


def test_long_texts_in_tokens_and_packing(docs, long_text):
    tokenizer = Tokenizer.from_file(str(vocabulary("byte_bpe_50k.json")))
    n = len(tokenizer.encode(long_text, add_special_tokens=False).ids)
    counted = by_id(token_counts(docs, vocabulary("byte_bpe_50k.json").read_text()))
    assert (counted[1].n_bytes, counted[1].n_tokens, counted[1].over_limit) == (len(long_text), n, True)
    data = vocabulary("byte_bpe_50k.tiktoken").read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(long_text)
    coded = by_id(encode_decode(docs.where("doc_id <> 2"), data))
    assert (coded[1].n_tokens, coded[1].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert coded[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    pieces = [r for r in pack(docs, vocabulary("word_bpe_49k.json").read_text()).collect() if r.doc_id == 1]
    at = 0
    for start, size in sorted((r.start, r.length) for r in pieces):
        assert start == at
        at += size
    assert at == pieces[0].doc_tokens > 1_000_000


def test_long_texts_lose_their_repeats(docs, long_text):
    by_bytes, by_words = by_id(suffix_dedup(docs, width=100)), by_id(substring_dedup(docs, width=13))
    assert by_bytes[1].n_removed == 0 and by_words[1].n_removed == 0
    assert (by_bytes[3].n_removed, by_bytes[3].n_spans) == (3000, 1)
    assert 0 <= by_bytes[2].n_removed - (len(long_text) - 2_000) <= 8  # the cut may go on as the text did
    assert by_words[3].n_words - by_words[3].n_removed <= 2  # words cut at either end
    assert by_words[2].n_removed >= len(long_text[:-2_000].split()) - 1


def test_long_texts_are_judged_whole(spark, docs, long_text):
    words = long_text.split()
    judged = by_id(quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert (judged[1].n_words, judged[1].word_chars) == (len(words), sum(map(len, words)))
    lines = Counter(long_text.split("\n"))
    assert judged[1].n_dup_lines == sum(n - 1 for n in lines.values())
    model = language_id.learned(docs)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"en"}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    graded = by_id(quality_classifier.grade(docs, quality_classifier.learned(docs, labels)))
    assert len(graded) == 3 and all(0 <= r.expected_grade <= 2 for r in graded.values())
    marked = by_id(fingerprints(docs))
    assert marked[1].n_chars == len(long_text) and marked[1].near_next > 0.99 and marked[3].near_next < 0.01


REPEATED = [(5, "one two three four five six seven eight nine ten eleven"), (5, "eine ganz andere zeile mit vielen wörtern und noch mehr davon hier"), (5, "one two three four five six seven eight nine ten eleven"), (6, None), (6, ""), (7, "seven words are here and no more")]


def test_rows_of_one_id_keep_their_own_values(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    key = lambda r, *c: (r.doc_id, *[r[x] for x in c])
    tokenizer = Tokenizer.from_file(str(vocabulary("byte_bpe_50k.json")))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = Counter(key(r, "n_bytes", "n_tokens") for r in token_counts(df, vocabulary("byte_bpe_50k.json").read_text()).collect())
    assert got == Counter((i, len((t or "").encode()), count(t)) for i, t in REPEATED)
    coded = Counter(key(r, "decoded_sha256") for r in encode_decode(df, vocabulary("byte_bpe_50k.tiktoken").read_bytes()).collect())
    assert coded == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in REPEATED)
    joined = Counter(key(r, "n_shingles", "component_id") for r in jaccard_components(df).collect())
    assert joined == Counter((i, len(brute_set(t, 4)), i) for i, t in REPEATED)
    words = Tokenizer.from_file(str(vocabulary("word_bpe_49k.json")))
    packed = Counter(key(r, "doc_tokens") for r in pack(df, vocabulary("word_bpe_49k.json").read_text()).collect() if r.start == 0)
    assert packed == Counter((i, len(words.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in REPEATED)
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    graded = quality_classifier.grade(df, quality_classifier.learned(df, labels)).collect()
    assert Counter(r.doc_id for r in graded) == Counter(i for i, _ in REPEATED)
    assert len({r.score for r in graded if r.doc_id == 5}) <= 2
    marked = Counter(key(r, "n_chars") for r in fingerprints(df).collect())
    assert marked == Counter((i, len(t or "")) for i, t in REPEATED)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "½ ② 7 8 9 10 11 12 13 14 15"), (None, "no id but words enough to be kept by every rule there is"), (5, "plain words that go on long enough for the base rule to pass"), (5, "plain words that go on long enough for the base rule to pass"), (5, "other words under the same id that pass the base rule as well"), (6, "plain words that go on long enough for the base rule to pass")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "c", "r", "p") for i, t in ODD], SCHEMA + ", component_id string, root string, version string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def stage(name):
    pipeline = pytest.importorskip("corpus_pipeline")
    return dict(pipeline.STAGES)[name]


@pytest.mark.parametrize(
    "name, want",
    [
        ("quality rules", [4, 5, 5, 5, 6]),  # too few words, or no id
        ("language", [5, 5, 5, 6, None]),  # no language is labelled: texts without a letter go
        ("near copies", [1, 2, 3, 4, 5, 5, 5]),
        ("repeated passages", [1, 2, 3, 4, 5, 5, 5, 6, None]),
    ],
)
def test_stages_on_odd_rows(spark, odd, folder, name, want):
    out = stage(name)(spark, odd, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [r.doc_id for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_stage_on_odd_rows(spark, odd, folder):
    out = stage("packing")(spark, odd, folder).collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", ["quality rules", "language", "near copies", "repeated passages", "packing"])
def test_stages_on_an_empty_table(spark, no_docs, folder, name):
    assert stage(name)(spark, no_docs, folder).count() == 0
