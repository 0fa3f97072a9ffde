import random

import numpy as np
import pytest
from test_ngram_join import brute_components

from trackweave.llm.superminhash import band_keys, near_duplicates, signatures, verified_links


def plain_signature(values, places):
    """One shingle after the other, each with its own permutation read to the end."""
    out, mask = [float("inf")] * places, 2**64 - 1

    def mixed(h):
        h = (h ^ h >> 31) * 0xC2B2AE3D27D4EB4F & mask
        h = (h ^ h >> 29) * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    for value in values:
        order = list(range(places))
        for step in range(places):
            x = mixed((value + (step + 1) * 0x9E3779B97F4A7C15) & mask)
            other = step + ((x & 0xFFFFFFFF) * (places - step) >> 32)
            order[step], order[other] = order[other], order[step]
            out[order[step]] = min(out[order[step]], step + (x >> 32) / 2**32)
    return out


@pytest.mark.parametrize("places", [1, 2, 24, 168])
def test_early_stopping_changes_no_signature(places):
    rng = random.Random(places)
    sets = [np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64) for n in (0, 1, 2, 3, 30, 0, 400, 1500)]
    got = signatures(sets, places)
    for s, row in zip(sets, got):
        assert row.tolist() == plain_signature([int(v) for v in s], places)
    assert all(np.array_equal(signatures([s], places)[0], row) for s, row in zip(sets, got))


def test_estimates_have_no_bias_and_a_lower_variance():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(400):
        u = rng.integers(0, 2**63, 120).astype(np.uint64)
        a, b = signatures([u[:100], u[20:]], 168)
        found.append((a == b).mean() - 80 / 120)
    independent = np.sqrt(2 / 3 / 3 / 168)
    assert abs(np.mean(found)) < 4 * independent / 20
    assert np.std(found) < 0.8 * independent


def test_equal_bands_have_equal_keys():
    s = signatures([np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.arange(1, 51, dtype=np.uint64)], 12)
    keys = band_keys(s, 4)
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 4
    assert ((keys[0] == keys[2]) == (s[0] == s[2]).reshape(4, 3).all(axis=1)).all()


@pytest.mark.parametrize("num, den, block", [(85, 100, 1024), (4, 5, 3)])
def test_components_equal_brute_force(awkward, awkward_docs, num, den, block):
    rows = near_duplicates(awkward_docs, k=5, num=num, den=den, block=block).collect()
    want = brute_components([(r[0], r[1]) for r in awkward], 5, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, num=85, den=100).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 85, 100)


@pytest.mark.parametrize("block", [20, 1000])
def test_large_families(spark, block):
    """Near copies of one text, chains of neighbours and texts that share a half, in families far over a block."""
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(5000)}"
    half, base, texts = [word() for _ in range(30)], [word() for _ in range(60)], []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        texts.append(w)
    link = [word() for _ in range(60)]
    for _ in range(60):
        link = link[1:] + [word()]
        texts.append(list(link))
    texts += [half + [word() for _ in range(rng.randrange(5, 30))] for _ in range(100)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, num=85, den=100, block=block).collect()}
    assert got == brute_components(rows, 5, 85, 100)


def test_null_and_repeated_ids_and_empty_table(spark, no_docs):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (None, None), (1, text), (1, text), (2, text.upper()), (3, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (None, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True)], key=repr)
    assert near_duplicates(no_docs).count() == 0


def test_links_across_sides_and_known_components_only():
    s = np.arange(50, dtype=np.uint64)
    far = s + np.uint64(1000)
    link = lambda sides, known: verified_links([s, s, s, far], np.array(sides), 4, 5, 168, 6.0, known)
    assert len(link([0, 0, 0, 0], [None] * 4)) == 2
    assert link([0, 0, 0, 0], [7, 7, 7, None]) == []
    assert sorted(link([1, 1, 2, 2], [None] * 4)) == [(0, 2), (1, 2)]
