"""Fill-in-the-middle transformation by a parallel automaton scan.

A text's units are the matches of ``[A-Za-z]+|[^A-Za-z]``. An automaton of four states reads
its UTF-8 bytes: it counts the units that begin and sees the sentinels. What a stretch of
bytes does is a function: for each state it may be entered in, the state it ends in, the
units that begin and whether a sentinel ends inside. Functions compose associatively, so a
stretch is a tree of functions, made level by level for all blocks at once; the place where
the unit of some rank begins is found by a descent from the root.

A text of more than ``chunk_bytes`` is read in chunks dealt over the cluster; each chunk
gives its function only. They are composed text by text (a handful of numbers a chunk), which
resolves the state each chunk is entered in and the units before it. The chunks that hold
the two cuts are then found by rank, and only these are searched.

The cuts come from the first four groups of eight hex digits of the SHA-256 of
``seed:doc_id``. A null text is an empty one, empty texts and those that hold a sentinel
stay plain, a null ``doc_id`` is hashed as no characters. Equal rows give equal rows, rows
of one id with different texts are cut each by itself. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import dropped, written

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk of a long text.
CHUNK_BYTES = 1 << 16

# Classes of bytes: other characters, "<", ">", letters of sentinels, other letters, bytes inside a character.
_OTHER, _OPEN, _CLOSE, _NAMING, _LETTER, _INSIDE = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[ord(c) for c in "PSM"]] = _NAMING
_CLASS[ord("<")], _CLASS[ord(">")] = _OPEN, _CLOSE
_CLASS[0x80:0xC0] = _INSIDE
# States: after no letter, after "<", after "<" and a sentinel's letter, after another letter.
_PLAIN, _OPENED, _NAMED, _WORD = range(4)
STATES = 4


def _step(state: int, kind: int) -> tuple[int, int, bool]:
    """Next state, units that begin, whether a sentinel ends."""
    if kind == _INSIDE:
        return state, 0, False
    if kind in (_NAMING, _LETTER):
        return _NAMED if kind == _NAMING and state == _OPENED else _WORD, int(state < _NAMED), False
    return _OPENED if kind == _OPEN else _PLAIN, 1, kind == _CLOSE and state == _NAMED


@dataclass
class Functions:
    """Functions of stretches, one a row: for each state, the last state, the units that begin, whether a sentinel ends."""

    ends: np.ndarray
    units: np.ndarray
    found: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, at: object) -> Functions:
        return Functions(self.ends[at], self.units[at], self.found[at])

    def then(self, other: Functions) -> Functions:
        """Row by row this function, then the other's."""
        at = self.ends + STATES * np.arange(len(self.ends))[:, None]
        return Functions(other.ends.ravel()[at], self.units + other.units.ravel()[at], self.found | other.found.ravel()[at])


def _blocks_of_four() -> Functions:
    """The functions of all runs of four classes, by their number in base 6."""
    one = [[_step(s, kind) for s in range(STATES)] for kind in range(6)]
    one = Functions(*[np.array([[x[i] for x in row] for row in one], dtype=d) for i, d in enumerate((np.int64, np.int64, bool))])
    pick = lambda f, n: f.take(np.tile(np.arange(len(f)), n)), lambda f, n: f.take(np.repeat(np.arange(len(f)), n))
    two = pick[1](one, 6).then(pick[0](one, 6))
    return pick[1](two, 36).then(pick[0](two, 36))


_FOUR = _blocks_of_four()
_NOTHING = _FOUR.take(slice(6**4 - 1, 6**4))  # four bytes that do nothing


class Scan:
    """The tree of functions over a stretch of bytes."""

    def __init__(self, data: np.ndarray):
        self.classes = np.full(max(4, -(-len(data) // 4) * 4), _INSIDE, dtype=np.uint8)
        self.classes[: len(data)] = _CLASS[data]
        of = self.classes.reshape(-1, 4).astype(np.int64)
        self.levels = [_FOUR.take(((of[:, 0] * 6 + of[:, 1]) * 6 + of[:, 2]) * 6 + of[:, 3])]
        while len(low := self.levels[-1]) > 1:
            if len(low) % 2:
                low = self.levels[-1] = Functions(*[np.concatenate(x) for x in ((low.ends, _NOTHING.ends), (low.units, _NOTHING.units), (low.found, _NOTHING.found))])
            self.levels.append(low.take(slice(0, None, 2)).then(low.take(slice(1, None, 2))))

    @property
    def whole(self) -> Functions:
        return self.levels[-1]

    def begin_of(self, rank: int, state: int = _PLAIN) -> int:
        """Byte at which the unit ``rank`` (from 0) begins, of those that begin here when entered in ``state``."""
        at = 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            if rank >= level.units[at, state]:
                rank -= int(level.units[at, state])
                state = int(level.ends[at, state])
                at += 1
        for i in range(4 * at, 4 * at + 4):
            state, begun, _ = _step(state, int(self.classes[i]))
            if begun and rank == 0:
                return i
            rank -= begun
        raise IndexError("fewer units begin here")


def resolved(parts: Functions) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """For a text's chunks in order: the state each is entered in, the units before it; and all its units, whether it holds a sentinel."""
    done, step = parts, 1
    while step < len(done):  # prefix compositions by doubling
        joined = done.take(slice(0, len(done) - step)).then(done.take(slice(step, None)))
        done = Functions(*[np.concatenate([a[:step], b]) for a, b in ((done.ends, joined.ends), (done.units, joined.units), (done.found, joined.found))])
        step *= 2
    entered = np.r_[_PLAIN, done.ends[:-1, _PLAIN]]
    before = np.r_[0, done.units[:-1, _PLAIN]]
    return entered, before, int(done.units[-1, _PLAIN]), bool(done.found[-1, _PLAIN])


@dataclass(frozen=True)
class Choice:
    """How a text is drawn: percentages of plain texts and of suffix-first ones, and the seed."""

    seed: str = "1"
    plain_from: int = 90
    suffix_first_below: int = 20

    def drawn(self, doc_id: object, units: int, held: bool, empty: bool) -> tuple[str, int, int]:
        """Form, and the units before the middle and before the suffix."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
        first, last = sorted((h[0] % (units + 1), h[1] % (units + 1)))
        form = "plain" if empty or held or h[2] % 100 >= self.plain_from else "spm" if h[3] % 100 < self.suffix_first_below else "psm"
        return form, first, last


def rearranged(data: bytes, form: str, first: int, last: int) -> bytes:
    if form == "plain":
        return data
    prefix, middle, suffix = data[:first], data[first:last], data[last:]
    head = PREFIX + prefix + SUFFIX + suffix if form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return head + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that was rearranged; no sentinel is in it, so the first of each kind is the one put there."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    left, _, right = head.removeprefix(one).partition(two)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _bytes_of(column: pa.Array, i: int) -> bytes:
    value = column[i].as_py()
    return b"" if value is None else value


SHAPE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string, output string"


def _row(data: bytes, units: int, form: str, first: int, last: int) -> tuple:
    """``first`` and ``last``: bytes before the middle and before the suffix."""
    out = rearranged(data, form, first, last)
    flat = np.frombuffer(data, dtype=np.uint8)
    chars = (None, None) if form == "plain" else (_characters(flat[:first]), _characters(flat[first:last]))
    return units, form, *chars, hashlib.sha256(out).hexdigest(), hashlib.sha256(restored(out, form)).hexdigest(), out


def _returned(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    output = pa.array([r[6] for r in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, *columns, output], names=["doc_id", *[c.split()[0] for c in SHAPE.split(", ")]])


def chunk_functions(long: DataFrame, chunk_bytes: int) -> DataFrame:
    """key, entered, before (lists by chunk), units, held: the long texts' chunks resolved; ``long``: key, text, equal texts under equal keys."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, key in enumerate(batch.column(0)):
                data = _bytes_of(texts, i)
                for at in range(0, len(data), chunk_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([at // chunk_bytes], pa.int32()), pa.array([data[at : at + chunk_bytes]], pa.binary())], names=["key", "chunk", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [Scan(np.frombuffer(data.as_py(), dtype=np.uint8)).whole for data in batch.column(2)]
            lists = [pa.array([getattr(f, name)[0].tolist() for f in whole], pa.list_(kind)) for name, kind in (("ends", pa.int32()), ("units", pa.int64()), ("found", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["key", "chunk", "ends", "units", "found"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                f = Functions(*[np.array([p[name] for p in parts], dtype=kind) for name, kind in (("ends", np.int64), ("units", np.int64), ("found", bool))])
                entered, before, units, held = resolved(f)
                rows.append((entered.tolist(), before.tolist(), units, held))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["key", "entered", "before", "units", "held"])

    chunks = long.select("key", "text").mapInArrow(cut, "key string, chunk int, data binary").repartition("key", "chunk")
    functions = chunks.mapInArrow(scan, "key string, chunk int, ends array<int>, units array<bigint>, found array<boolean>")
    # A text's chunks are as many as its bytes allow; those of equal texts are one.
    listed = functions.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("chunk", "ends", "units", "found"))).alias("parts"))
    return listed.mapInArrow(compose, "key string, entered array<int>, before array<bigint>, units bigint, held boolean")


def fill_in_middle(docs: DataFrame, *, choice: Choice = Choice(), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, output of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0)):
                data = _bytes_of(texts, i)
                scan = Scan(np.frombuffer(data, dtype=np.uint8))
                units, held = int(scan.whole.units[0, _PLAIN]), bool(scan.whole.found[0, _PLAIN])
                form, *ranks = choice.drawn(doc_id.as_py(), units, held, not data)
                first, last = (0, 0) if form == "plain" else [len(data) if r == units else scan.begin_of(r) for r in ranks]
                rows.append(_row(data, units, form, first, last))
            yield _returned(batch.column(0), rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column(1).cast(pa.binary())
            for i, (doc_id, entered, before, units, held) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)])):
                data = _bytes_of(texts, i)
                form, *ranks = choice.drawn(doc_id, units, held, False)
                cuts = []
                for rank in ranks if form != "plain" else ():
                    if rank == units:
                        cuts.append(len(data))
                        continue
                    chunk = int(np.searchsorted(before, rank, side="right")) - 1
                    part = np.frombuffer(data, dtype=np.uint8)[chunk * chunk_bytes : (chunk + 1) * chunk_bytes]
                    cuts.append(chunk * chunk_bytes + Scan(part).begin_of(rank - before[chunk], entered[chunk]))
                rows.append(_row(data, units, form, *(cuts or (0, 0))))
            yield _returned(batch.column(0), rows)

    shape = f"doc_id {kind}, {SHAPE}"
    out = docs.where(size <= chunk_bytes).mapInArrow(short, shape)
    long = docs.where(size > chunk_bytes).withColumn("key", F.sha2("text", 256))
    functions = written(chunk_functions(long, chunk_bytes))
    if functions.isEmpty():
        dropped(functions)
        return out
    found = long.join(functions, "key").select("doc_id", "text", "entered", "before", "units", "held")
    return out.unionByName(found.mapInArrow(place, shape))
