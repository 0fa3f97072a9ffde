import random

import numpy as np
import pytest

from trackweave.llm.components import connected_components
from trackweave.llm.ngram_join import jaccard_components, t_occurrence_links

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k):
    words = (text or "").translate(LETTERS).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows, k, num, den):
    sets = {i: brute_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, num, den, block", [(4, 85, 100, 1024), (5, 4, 5, 3)])
def test_components_equal_brute_force(spark, awkward, awkward_docs, k, num, den, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(awkward_docs, k=k, num=num, den=den, block=block).collect()}
    want = brute_components([(r[0], r[1]) for r in awkward], k, num, den)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)


def test_null_id_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {(None, 2, None), (1, 2, 1)}
    assert jaccard_components(no_docs).count() == 0


def test_search_finds_each_link_of_a_block():
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(80)]
    sets = []
    for i in range(60):
        s = set(base)
        for _ in range(rng.randrange(12)):
            s.discard(rng.choice(base))
            s.add(rng.getrandbits(63))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    links = t_occurrence_links(sets, np.zeros(60, dtype=int), 85, 100)
    whole = {(i, j) for i in range(60) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}

    def classes(pairs):
        root = list(range(60))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return [root.index(r) for r in root]

    assert classes(links) == classes(whole)
    assert all((max(p), min(p)) in whole for p in links)


def test_contraction_finds_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200) if i % 23] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {x: find(x) for x in list(root)}


@pytest.mark.parametrize("block", [4, 40, 1000])
def test_large_families_lose_no_link(spark, block):
    """Near copies of one text, chains of neighbours, and unlike texts that share an opening, in families far over a block."""
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(5000)}"
    opening, base = [word() for _ in range(12)], [word() for _ in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        texts.append(w)
    link = opening + [word() for _ in range(48)]
    for _ in range(60):
        link = link[1:] + [word()]
        texts.append(list(link))
    texts += [opening + [word() for _ in range(rng.randrange(2, 20))] for _ in range(120)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, block=block).collect()}
    want = brute_components(rows, 4, 85, 100)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(want) - 100


def test_known_components_are_not_searched_again():
    s = np.arange(50, dtype=np.uint64)
    links = t_occurrence_links([s, s, s, s + np.uint64(1)], np.zeros(4, dtype=int), 85, 100, [5, 5, None, None])
    assert len(links) == 2 and (0, 1) not in links
