import hashlib
import random

import numpy as np
import pytest

from trackweave.llm import suffix_dedup as module
from trackweave.llm.induced_sort import Stats, suffix_array
from trackweave.llm.suffix_dedup import suffix_dedup


def brute(rows, width=100):
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - width + 1):
            w = data[a : a + width]
            if w in first:
                gone[a : a + width] = b"\x01" * width
            first.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def common(t, a, b, cap):
    k = 0
    while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("memory", [1, 8, 64, 5000])
def test_suffix_array_with_common_prefixes(memory):
    rng = random.Random(memory)
    for _ in range(150):
        t = bytes(rng.randrange(rng.choice([1, 2, 3, 6, 250])) for _ in range(rng.randrange(200))) * rng.choice([1, 1, 2, 3])
        order, cap = sorted(range(len(t)), key=lambda i: t[i:]), rng.choice([3, 100])
        got, commons = suffix_array(np.frombuffer(t, dtype=np.uint8), cap, memory)
        assert got.tolist() == order
        assert commons[0 : len(t)].tolist() == [0, *(common(t, a, b, cap) for a, b in zip(order, order[1:]))][: len(t)]


def test_a_shard_far_larger_than_memory_is_sorted_on_disk():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    t = " ".join(rng.choice(words) for _ in range(18_000)).encode()
    t += t[1000:9000] + bytes(3000)
    memory, stats = 1 << 11, Stats()
    order, commons = suffix_array(np.frombuffer(t, dtype=np.uint8), 100, memory, stats)
    assert len(t) > 50 * memory
    assert stats.depth > 2 and stats.spills > 100 and stats.spilled > len(t)
    assert stats.held <= 3 * memory  # the limit and what one batch adds
    order = order.tolist()
    assert sorted(order) == list(range(len(t)))
    found = commons[0 : len(t)].tolist()
    for i in rng.sample(range(1, len(t)), 4000):
        a, b = order[i - 1], order[i]
        assert found[i] == common(t, a, b, 100)
        assert t[a:] < t[b:]


@pytest.mark.parametrize("memory", [64, 1 << 19])
def test_windows_of_a_shard_equal_brute_force(memory):
    rng = random.Random(6)
    text = lambda n: bytes(rng.choice(b"abc\xff") for _ in range(n))
    p = text(150)
    texts = [(1, b"", text(40) + p + text(30)), (2, b"", p + text(20)), (2, b"v", p + p), (3, b"", text(70) + p[:120] + text(5)), (4, b"", text(300))]
    runs = [(d, v, 0, len(x) - 99, x, 7) for d, v, x in texts]
    places = {}
    for d, v, x in texts:
        for i in range(len(x) - 99):
            places.setdefault(x[i : i + 100], []).append((d, v, i))
    want = set()
    for found in places.values():
        for d, v, i in found:
            if d > min(found)[0] or any((d, v) == (e, w) and j < i for e, w, j in found):
                want |= {(d, v, k) for k in range(i, i + 100)}
    got = module.repeated_in_shard(runs, 100, memory)
    assert {(d, v, k) for d, v, a, b in got for k in range(a, b)} == want and want


def test_awkward_rows_equal_brute_force(spark, awkward, awkward_docs):
    want = brute([(r[0], r[1]) for r in awkward])
    assert result(suffix_dedup(awkward_docs)) == want
    assert sum(w[1] for w in want.values()) > 3000


def test_edited_copies_and_long_repeats(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(20):
        t = list(base)
        for _ in range(i):
            t[rng.randrange(len(t))] = rng.choice("xyzé")
        rows.append((i, "".join(t)))
    rows += [(50, "ab" * 3000), (51, "a" * 2500 + "b" + "a" * 2500), (52, base[100:250] + base[90:240])]
    assert result(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(suffix_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_null_id_and_empty_table(spark, no_docs):
    text = "".join(chr(97 + i % 23) + chr(97 + i % 7) for i in range(80))
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup(spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")).collect())
    assert got == [(False, 0), (False, 160), (True, 0)]
    assert suffix_dedup(no_docs).count() == 0


def brute_rows(rows, width=100):
    """(doc_id, n_bytes, n_removed, kept_sha256) of every row, each judged against smaller ids and itself."""
    before, out = {}, []
    windows = lambda data: [data[a : a + width] for a in range(len(data) - width + 1)]
    for i, text in rows:
        for w in windows(text.encode()):
            before[w] = min(i, before.get(w, i))
    for i, text in rows:
        data, own = text.encode(), set()
        gone = bytearray(len(data))
        for a, w in enumerate(windows(data)):
            if before[w] < i or w in own:
                gone[a : a + width] = b"\x01" * width
            own.add(w)
        out.append((i, len(data), sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def repeated_id_rows():
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    a, p = prose(80), prose(40)
    rows = [(1, a), (1, a), (2, prose(50) + " " + p), (2, p + " " + prose(45)), (2, p + " " + p)]
    rows += [(3, prose(7) + " " + p + " " + prose(9)), (4, a), (4, prose(60)), (5, a[100:400] + prose(30)), (5, a[100:400] + prose(30)), (5, prose(20))]
    return rows + [(6, prose(30) + " " + p)] * 40


def test_rows_with_one_id_are_judged_each_by_itself(spark):
    rows = repeated_id_rows()
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == brute_rows(rows)


def test_no_task_holds_a_group_that_grows(spark, awkward, monkeypatch):
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [(i, f"{rng.random()} {rng.random()}" * 3 + passage + f"{rng.random()} {rng.random()}" * 3) for i in range(300)]
    rows += [(1000 + r[0], r[1]) for r in awkward] + [(5000, "ab" * 700)]
    monkeypatch.setattr(module, "HOT_PLACES", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    several = module.repeated_ids(docs)
    distinct = module.distinct_rows(docs, several)
    repeated = module.repeated_anchors(module.anchors_of(distinct, 100), within=True, hot=20)
    runs = module.runs_of(distinct, repeated, 100)
    assert runs.where("not hot and text is not null").groupBy("anchor").count().agg({"count": "max"}).first()[0] <= 20
    assert runs.where("hot").count() > 0
    # Of a window that 300 rows have only the first of each batch is sent on.
    assert runs.where("hot and text is not null").groupBy("text").count().agg({"count": "max"}).first()[0] <= 10
    assert result(suffix_dedup(docs)) == brute(rows)


def test_judged_windows_of_a_hot_anchor_go_as_one_run(spark, monkeypatch):
    rng = random.Random(23)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, f"{rng.random()}" * 3 + line * 4 + f"{rng.random()}" * 3) for i in range(60)]
    monkeypatch.setattr(module, "HOT_PLACES", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    distinct = module.distinct_rows(docs, module.repeated_ids(docs))
    repeated = module.repeated_anchors(module.anchors_of(distinct, 100), within=True, hot=20)
    runs = module.runs_of(distinct, repeated, 100).where("hot")
    # The first row keeps a line's windows singly and has the rest as runs; others have theirs as few runs, not one a window.
    assert runs.where("text is null").groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 12
    assert runs.where("text is null").agg({"windows": "sum"}).first()[0] > 60 * 300
    assert result(suffix_dedup(docs)) == brute(rows)
