import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_ngram_join import brute_components  # noqa: E402
from test_suffix_dedup import brute as brute_passages  # noqa: E402

from trackweave.llm.common import written  # noqa: E402
from trackweave.llm.packing import pack  # noqa: E402
from trackweave.llm.quality_rules import quality_rules  # noqa: E402
from trackweave.llm.queries import vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"


def check_packing(rows, texts, length=4096):
    """Each id in one piece, sequences gapless and full or a power of two."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(vocabulary("word_bpe_49k.json")))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids)
    for spans, size in [(by_doc[i], len(ids[i])) for i in ids] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == size if size else at == length or at & (at - 1) == 0 and at < length


def test_packing_of_awkward_rows(spark, awkward, awkward_docs, no_docs):
    definition = vocabulary("word_bpe_49k.json").read_text()
    rows = pack(awkward_docs, definition, group_sequences=2).collect()
    check_packing(rows, {r[0]: r[1] for r in awkward})
    assert pack(no_docs, definition).count() == 0


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules(docs, labels).where("kept").collect()}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = written(stage(spark, docs, SF))
        rows = docs.collect()
        if name == "packing":
            check_packing(rows, before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality rules":
            assert set(after) == kept
        if name == "language":
            assert len(after) >= 0.98 * sum(any(c.isalpha() for c in t) for t in before.values())
        if name == "near copies":
            assert set(after) == {i for i, (_, c) in brute_components(before.items(), 5, 4, 5).items() if c == i}
        if name == "repeated passages":
            want = brute_passages(list(before.items()))
            assert set(after) == {i for i, w in want.items() if w[1] < w[0] or not w[0]}
            assert all(after[i] == before[i] for i in after if not want[i][1])
            assert all(len(after[i].encode()) <= want[i][0] - want[i][1] for i in after)
