import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from trackweave.llm.bpe import encode_decode, merge_ids, read_ranks
from trackweave.llm.packing import WordIds
from trackweave.llm.pretokens import PATTERN, pieces_of
from trackweave.llm.queries import vocabulary
from trackweave.llm.token_counts import load_tokenizer, spliced_count, token_counts

ODD = ["a", "b", " ", "  ", "\n", "'s", "'RE", "é", "é", "中", "1", "½", "_", "<|endoftext|>", "<|endof", "text|>", "a" * 40, "\xa0", "\x1c", "\x85", "Σ", "İ", "𝒳", "ſ", "##"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary("byte_bpe_50k.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_segment_tree_gives_the_library_ids(tik):
    ranks = read_ranks(vocabulary("byte_bpe_50k.tiktoken").read_bytes())
    for text in [*odd_texts(1500, 1), "a" * 5000 + " " * 900, "ab" * 3000]:
        assert "".join(pieces_of(text)) == text
        assert [i for p in pieces_of(text) for i in merge_ids(p.encode(), ranks)] == tik.encode_ordinary(text)


def test_encode_decode_rows(spark, awkward, awkward_docs, no_docs, tik):
    data = vocabulary("byte_bpe_50k.tiktoken").read_bytes()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(awkward_docs, data).collect()}
    for i, text, *_ in awkward:
        ids = tik.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i] == want
    assert encode_decode(no_docs, data).count() == 0


def test_spliced_counts_equal_whole_counts():
    tokenizer = load_tokenizer(vocabulary("byte_bpe_50k.json").read_text())
    rng = random.Random(2)
    for text in odd_texts(400, 3):
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert spliced_count(tokenizer, text, rng.choice([20, 30, 50]), rng.choice([4, 10, 20]), 15) == want


def test_token_count_rows(spark, awkward, awkward_docs, no_docs):
    definition = vocabulary("byte_bpe_50k.json").read_text()
    tokenizer = Tokenizer.from_str(definition)
    for chunk in (32_768, 500):
        got = {r.doc_id: tuple(r)[1:] for r in token_counts(awkward_docs, definition, chunk_chars=chunk, overlap_chars=60).collect()}
        for i, text, *_ in awkward:
            n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
            assert got[i] == (len((text or "").encode()), n, n > 1024)
    assert token_counts(no_docs, definition).count() == 0


def test_word_ids_equal_the_library():
    tokenizer = load_tokenizer(vocabulary("word_bpe_49k.json").read_text())
    words = WordIds(tokenizer)
    for text in odd_texts(1500, 5):
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
