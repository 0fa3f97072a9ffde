import base64
import hashlib
import re
from collections import Counter

import pytest
import xxhash

from trackweave.llm import fingerprints as module
from trackweave.llm.fingerprints import fingerprints


def pieces(text, unit):
    return set(re.findall(rf"[^\n]{{1,{unit}}}", text))


def share(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(rows, got, unit=96):
    ordered = sorted((i, t or "") for i, t in rows)
    for k, (i, text) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + follower[:h]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - share(pieces(text, unit), pieces(edited, unit))) < 1e-9, i
        assert abs(r.near_next - share(pieces(text, unit), pieces(follower, unit))) < 1e-9, i


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_awkward_rows_equal_brute_force(spark, awkward, awkward_docs, monkeypatch, ranges):
    monkeypatch.setattr(module, "MOST_RANGES", ranges)
    got = {r.doc_id: r for r in fingerprints(awkward_docs).collect()}
    check([(r[0], r[1]) for r in awkward], got)
    by_text = {}
    for r in awkward:
        by_text.setdefault(r[1] or "", set()).add(got[r[0]].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_one_row_null_id_repeated_id_and_empty_table(spark, no_docs):
    one = fingerprints(spark.createDataFrame([(5, "a\nb")], "doc_id long, text string")).collect()
    assert (one[0].near_next, one[0].near_edited < 1) == (1.0, True)
    some = fingerprints(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")).collect()
    assert len(some) == 4 and all(r.near_next is not None for r in some)
    assert fingerprints(no_docs).count() == 0


def read(fingerprint):
    """Width and cells (number -> count, XOR, half check) of a returned string."""
    raw = base64.b64decode(fingerprint)
    signed32 = lambda b: int.from_bytes(b, "big", signed=True)
    cells = {int.from_bytes(raw[i : i + 4], "big"): (signed32(raw[i + 4 : i + 8]), raw[i + 8 : i + 16], raw[i + 16 : i + 20]) for i in range(4, len(raw), 20)}
    return int.from_bytes(raw[:4], "big"), cells


def hashed(key, salt):
    """The 64-bit hash of a digest and a number, as two rounds of XXH64 from seed 42."""
    first = xxhash.xxh64_intdigest(key[::-1], seed=42)
    return xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), seed=first)


def likeness(a, b):
    """From two returned strings alone: fold, subtract, peel."""
    (wa, ca), (wb, cb) = read(a), read(b)
    width, left, found = min(wa, wb), {}, {}
    xor = lambda p, q: bytes(x ^ y for x, y in zip(p, q))
    nothing = (0, bytes(8), bytes(4))

    def add(at, sign, n, k, h):
        m, x, y = left.get(at, nothing)
        left[at] = (m + sign * n, xor(x, k), xor(y, h))

    for sign, cells in ((1, ca), (-1, cb)):
        for c, v in cells.items():
            add(c % 3 + 3 * (c // 3 % width), sign, *v)
    check_of = lambda k: (hashed(k, 99) & 0xFFFFFFFF).to_bytes(4, "big")
    while alone := next((v for v in left.values() if abs(v[0]) == 1 and v[2] == check_of(v[1])), None):
        n, k, h = alone
        found[k] = n
        for third in range(3):
            slot = hashed(k, third)
            add(third + 3 * ((slot - 2**64 if slot >= 2**63 else slot) % width), -1, n, k, h)
    n, m = (sum(v[0] for v in cells.values()) // 3 for cells in (ca, cb))
    missing = sum(s > 0 for s in found.values())
    return set(left.values()) <= {nothing}, (1.0 if n + m == 0 else (n - missing) / (m + missing))


def test_returned_strings_give_the_likeness_by_themselves(spark):
    got = fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).orderBy("doc_id").collect()
    next_levels, edited_levels = Counter(r.next_level for r in got), Counter(r.edited_level for r in got)
    assert next_levels[1] > 0.95 * len(got) and edited_levels[1] > 0.95 * len(got), (next_levels, edited_levels)
    assert not next_levels[0] and not edited_levels[0]
    for r, follower in zip(got, got[1:] + got[:1]):
        for other, near, level in ((r.edited_fingerprint, r.near_edited, r.edited_level), (follower.fingerprint, r.near_next, r.next_level)):
            done, value = likeness(r.fingerprint, other)
            assert done or level != 1  # the table operators stop after a number of rounds
            assert not done or abs(value - near) < 1e-9


def test_very_unlike_lengths_need_a_larger_table(spark):
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(3 if i % 2 else 900))) for i in range(6)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(rows, got)
    assert {r.next_level for r in got.values()} == {2}
