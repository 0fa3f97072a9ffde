import hashlib
import random
import re

import numpy as np

from trackweave.llm.fill_middle import Choice, Functions, Scan, fill_in_middle, rearranged, resolved, restored

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), sha(out), sha(text)


def result(df):
    return sorted((tuple(r) for r in df.drop("output").collect()), key=repr)


def expected(rows):
    return sorted(((i, *brute(i, t)) for i, t in rows), key=repr)


def noise(rng, n):
    return "".join(rng.choice("azPSMM<<>> é中\U0001f600 9\n") for _ in range(n))


def test_every_chunk_width_gives_the_plain_scan():
    rng = random.Random(3)
    for n in [*range(25), 400]:
        text = noise(rng, n)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        begins = [len(text[: m.start()].encode()) for m in UNIT.finditer(text)]
        held = any(s in text for s in ("<P>", "<S>", "<M>"))
        for width in (1, 2, 5, 64):
            scans = [Scan(data[i : i + width]) for i in range(0, len(data), width)] or [Scan(data)]
            parts = Functions(*[np.concatenate([getattr(s.whole, k) for s in scans]) for k in ("ends", "units", "found")])
            entered, before, units, found = resolved(parts)
            assert (units, found) == (len(begins), held)
            for rank, at in enumerate(begins):
                k = int(np.searchsorted(before, rank, side="right")) - 1
                assert k * width + scans[k].begin_of(rank - before[k], int(entered[k])) == at


def test_awkward_rows_equal_brute_force_in_chunks_or_whole(awkward, awkward_docs):
    want = expected([(r[0], r[1]) for r in awkward])
    assert result(fill_in_middle(awkward_docs)) == want
    assert result(fill_in_middle(awkward_docs, chunk_bytes=37)) == want


def test_repeated_ids_nulls_and_copies(spark):
    rng = random.Random(5)
    long = noise(rng, 3000)
    rows = [(1, "aa bb cc"), (1, "other text"), (None, "no id here"), (None, None), (2, long), (2, long), (2, long[::-1]), (3, long), (None, long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    assert result(fill_in_middle(df, chunk_bytes=100)) == expected(rows)


def test_empty_table(spark, no_docs):
    assert fill_in_middle(no_docs).count() == 0


def test_a_giant_text(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcXYZ", k=rng.randint(1, 9))) for _ in range(700_000)) + " é" * 500_000
    rows = [(i, text) for i in range(2)]
    assert len(text.encode()) > 5_000_000
    assert result(fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_sentinels_that_only_the_cut_makes_come_back():
    for data in (b"<", b"a<S", b"<P<M", b"S>x<", b"<<<>>>", b"P>"):
        for first in range(len(data) + 1):
            for last in range(first, len(data) + 1):
                for form in ("psm", "spm", "plain"):
                    assert restored(rearranged(data, form, first, last), form) == data


def test_shares_of_the_forms():
    found = [Choice().drawn(i, 50, False, False)[0] for i in range(4000)]
    assert abs(found.count("plain") / 4000 - 0.1) < 0.03
    assert abs(found.count("spm") / 4000 - 0.18) < 0.03


def test_output_column_is_the_text_that_is_hashed(spark):
    rows = fill_in_middle(spark.createDataFrame([(i, f"word{i} and more, of it") for i in range(40)], "doc_id long, text string")).collect()
    assert all(hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256 for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
