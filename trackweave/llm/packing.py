"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays inside its
document). Whole sequences are cut from documents longer than one; the rest, longest
first, goes to the cheapest sequence that still has room for all of it, and where none
has, the cheapest sequence with any room takes what fits and the remainder queues again.

Each task packs its own documents, some hundred sequences at a time, so nothing is
shuffled and memory is bounded by ``group_sequences``. What does not fill a sequence is
carried to the next group; a task's last tokens fill sequences of lengths that are powers
of two. So no sequence needs padding.

A null text is empty: its document is the closing id alone. Every row is packed, repeated
ids included; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trackweave.llm.common import per_worker
from trackweave.llm.pretokens import is_latin, latin_words
from trackweave.llm.token_counts import added_strings, load_tokenizer

#: Distinct words whose ids a task remembers before it starts afresh.
WORD_CACHE = 500_000

# Fixed value: the word split of the lower-casing vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(WORD_PATTERN.replace(r"[^\s", r"[^\p{White_Space}"))


class WordIds:
    """Ids of whole texts for the word-end BPE file, each distinct word encoded by the library once a task.

    The file's normaliser (NFC, white space, lower case) and split act word by word, so a
    text's ids are its words' ids joined. Texts where that may not hold (an added token's
    string, characters whose lower case depends on the library) go to the library whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.added, self.seen = tokenizer, added_strings(tokenizer), {}

    def learn(self, words: list[str]) -> None:
        if len(self.seen) >= WORD_CACHE:
            self.seen.clear()
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, owner = np.array(encoding.ids, dtype="<u4"), np.array(encoding.word_ids)
        cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        parts = np.split(ids, cuts)
        if len(parts) != len(words):
            parts = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4") for w in words]
        self.seen.update((w, p.tobytes()) for w, p in zip(words, parts))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if len(low) != len(text) or "Σ" in text or any(s in low for s in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = latin_words(low) if is_latin(low) else _WORDS.findall(low)
        seen = self.seen
        if new := [w for w in set(words) if w not in seen]:
            self.learn(new)
            seen = self.seen
            if any(w not in seen for w in set(words)):
                self.learn(list(set(words)))
        return b"".join(map(seen.__getitem__, words))


def balanced(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the lengths and the capacities sum to the same.

    Capacities come with the full-length sequences first. Ties go to the earlier document and sequence.
    """
    room = np.array(capacities, dtype=np.int64)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), dtype=np.int64)
    full = capacities[0] if capacities else 0
    queue, out, nxt = [], [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= full and nxt < len(room) and capacities[nxt] == full:
            out.append((d, start, full, nxt, 0))
            room[nxt], used[nxt] = 0, full
            start, nxt = start + full, nxt + 1
        if n > start:
            queue.append((start - n, d, start))
    heapq.heapify(queue)
    while queue:
        short, d, start = heapq.heappop(queue)
        n = -short
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            fits = np.flatnonzero(room)
        s = int(fits[np.argmin(cost[fits])])
        take = min(n, int(room[s]))
        out.append((d, start, take, s, int(used[s])))
        used[s] += take
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, d, start + take))
    return out


def pack(docs: DataFrame, tokenizer_json: str, *, end_id: int = 2, length: int = 4096, group_sequences: int = 256, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed little-endian).

    ``length`` must be a power of two. The tokenizer file (under 2 MB, fixed) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    closing = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("words", shared.value, lambda: WordIds(load_tokenizer(shared.value)))
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[object, bytes, int]] = []  # id, packed ids, ids before those still to be packed
        waiting = 0

        def emit(capacities: list[int]) -> pa.RecordBatch:
            """Packs the first held tokens, as many as the capacities take; keeps the rest."""
            nonlocal held, waiting, sequence
            want, now, rest = sum(capacities), [], []
            for key, packed, done in held:
                n = min(want, len(packed) // 4 - done)
                if n:
                    now.append((key, packed, done, n))
                if n < len(packed) // 4 - done:
                    rest.append((key, packed, done + n))
                want -= n
            rows = []
            for d, start, n, s, offset in balanced([x[3] for x in now], capacities, linear, quadratic):
                key, packed, done, _ = now[d]
                ids = packed[4 * (done + start) : 4 * (done + start + n)]
                rows.append((key, done + start, n, zlib.crc32(ids), len(packed) // 4, sequence + s, offset, ids))
            sequence += len(capacities)
            held, waiting = rest, waiting - sum(capacities)
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            cols = list(zip(*rows))
            kinds = [id_type, *[pa.int64()] * 6] + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                packed = encoder.encode(text.as_py() or "") + closing
                held.append((key.as_py(), packed, 0))
                waiting += len(packed) // 4
                if waiting >= group_sequences * length:
                    yield emit([length] * (waiting // length))
        if waiting:
            rest = waiting % length
            yield emit([length] * (waiting // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
