"""Byte-level BPE encoding and decoding by a segment tree of pair ranks.

``encode_decode`` needs only the rank file's bytes. Each match of the split pattern is
merged on its own: a segment tree over its byte positions holds, at each node, the
leftmost minimum of the pair ranks below it, so the next merge is the root and each merge
makes a few logarithmic point updates on its live neighbours.

Null and empty texts give no ids. Rows are independent, so ties, repeats and empty
tables need no rule; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackweave.llm.pretokens import pieces_of

#: Distinct pieces whose ids a task remembers before it starts afresh.
PIECE_CACHE = 500_000
_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank, of a rank file (base64 token, space, rank on each line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the piece itself if it is a token, else its bytes merged lowest rank first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    mask = (1 << shift) - 1
    rank = ranks.get
    # Leaf i: (rank of the pair that starts at live position i) and i in one integer, so min is leftmost.
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    while tree[1] < _NONE:
        i = tree[1] & mask
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
            r = rank(piece[i : after[end]])
            at_i = _NONE if r is None else r << shift | i
        else:
            at_i = _NONE
        changed = [(j, _NONE), (i, at_i)]
        p = before[i]
        if p >= 0:
            r = rank(piece[p:end])
            changed.append((p, _NONE if r is None else r << shift | p))
        for leaf, value in changed:
            x = size + leaf
            if tree[x] == value:
                continue
            tree[x] = value
            while x > 1:
                other = tree[x ^ 1]
                low = value if value < other else other
                x >>= 1
                if tree[x] == low:
                    break
                tree[x] = value = low
    ids = []
    i = 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PieceIds(dict):
    """piece -> its ids as little-endian 32-bit integers, for pieces met lately."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_CACHE:
            self.clear()
        out = self[piece] = np.array(merge_ids(piece.encode("utf-8", "surrogatepass"), self.ranks), dtype="<u4").tobytes()
        return out


class ByteBPE:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = PieceIds(ranks)
        self.tokens = {v: k for k, v in ranks.items()}

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces_of(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, rank_file: bytes, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 (and ids, packed little-endian) of every text.

    The rank file (under 1 MB, fixed) is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(read_ranks(shared.value))
        for batch in batches:
            counts, shas, decoded, packs = [], [], [], []
            for text in batch.column(1):
                packed = bpe.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                shas.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
                if with_ids:
                    packs.append(packed)
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(packs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
