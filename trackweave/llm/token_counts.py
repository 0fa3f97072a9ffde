"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a character where both start a new piece of the
tokenizer's split. The left chunk is right up to there (the place is further from its
artificial end than any lookahead or special string reaches) and the split looks only
ahead, so from there on both chunks are right. When no such place exists in the overlap,
the overlap is widened, at last to the whole rest of the text.

Shorter texts are cut into the tokenizer's pieces and the library encodes each distinct
piece once per task; texts with an added token's string go to the library whole.

Null texts count as empty: 0 bytes, 0 tokens, not over the limit. Rows are independent,
so ties, repeats and empty tables need no rule; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trackweave.llm.pretokens import pieces_of

#: Distinct pieces whose counts a task remembers before it starts afresh.
PIECE_CACHE = 500_000


def load_tokenizer(definition: str):
    """A ``tokenizers`` object from its JSON text; one thread, as Spark gives a task one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def added_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def piece_starts(encoding, shift: int) -> list[tuple[int, int]]:
    """(character where a piece starts, number of tokens before it), in order."""
    out, last = [], object()
    for k, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            out.append((span[0] + shift, k))
        last = word
    return out


def spliced_count(tokenizer, text: str, chunk_chars: int, overlap_chars: int, margin: int) -> int:
    """Tokens of a text by overlapping chunks; ``margin``: characters of the longest added token and a lookahead."""
    total, begin, dropped = 0, 0, 0
    end = min(len(text), chunk_chars)
    left = tokenizer.encode(text[:end], add_special_tokens=False)
    while end < len(text):
        overlap = overlap_chars
        while True:
            # A place found in [next_begin + 1, end - margin] lies in both chunks.
            next_begin = max(begin, end - overlap)
            next_end = min(len(text), next_begin + max(chunk_chars, 2 * overlap))
            right = tokenizer.encode(text[next_begin:next_end], add_special_tokens=False)
            ours = {at: k for at, k in piece_starts(left, begin) if next_begin < at <= end - margin and k >= dropped}
            splice = next(((at, k) for at, k in piece_starts(right, next_begin) if at in ours), None)
            if splice or next_begin == begin:
                break
            overlap *= 2
        if splice is None:  # no boundary at all so far: the wider chunk from the same begin replaces this one
            if next_end <= end:
                next_end = min(len(text), begin + 2 * (end - begin))
                right = tokenizer.encode(text[begin:next_end], add_special_tokens=False)
            left, end = right, next_end
            continue
        total += ours[splice[0]] - dropped
        begin, end, left, dropped = next_begin, next_end, right, splice[1]
    return total + len(left.ids) - dropped


class PieceCounts(dict):
    """piece -> its number of tokens, for pieces met lately."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def learn(self, pieces: list[str]) -> None:
        if len(self) >= PIECE_CACHE:
            self.clear()
        for piece, encoding in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self[piece] = len(encoding.ids)

    def __missing__(self, piece: str) -> int:
        self.learn([piece])
        return self[piece]

    def total(self, text: str) -> int:
        pieces = pieces_of(text)
        if new := [p for p in set(pieces) if p not in self]:
            self.learn(new)
        return sum(map(self.__getitem__, pieces))


def token_counts(docs: DataFrame, tokenizer_json: str, *, limit: int = 1024, chunk_chars: int = 32_768, overlap_chars: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit of every text, for a byte-level BPE file of the tokenizers library.

    The file (under 2 MB, fixed) is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(shared.value)
        added = added_strings(tokenizer)
        margin = 2 + max([0, *map(len, added)])
        counts = PieceCounts(tokenizer)
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                if len(text) > chunk_chars:
                    tokens.append(spliced_count(tokenizer, text, chunk_chars, overlap_chars, margin))
                elif any(s in text for s in added):
                    tokens.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
                else:
                    tokens.append(counts.total(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
