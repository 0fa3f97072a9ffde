"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in its own.

1. Of every ``width`` bytes the smallest hash of 32 bytes is the anchor. Only windows whose
   anchor is somewhere else too can be repeated; runs of neighbouring windows with the
   same anchor are cut out with their text.
2. Of equal runs of a batch all but the first are repeated as a whole; the others are
   dealt by anchor, so equal windows meet, and the same is done with all of an anchor as
   they stream by. An anchor at more than ``HOT_PLACES`` places of the table isn't dealt: each
   of its windows goes by its own hash, so what a task holds of an anchor does not grow with the table.
3. Ends of runs whose windows have no hash in common with another are trimmed off. All that
   stays is put together to shards, and external induced sorting (``induced_sort``) gives
   their suffixes in order with common-prefix values, which show the windows that are
   equal; all but the first of equal ones are repeated. The runs of an anchor are never
   parted, and a shard ends after the anchor with which it has ``SHARD_BYTES``; what it
   needs beyond ``MEMORY`` tuples goes to disk.
4. The repeated windows of each document are put together and cut out.

Exact copies of a document with a smaller id are found first by their digests; all their
bytes go, if they have ``width`` of them, and they take no part in the rest.

Strings are judged on the input and never cross documents. Null and empty texts have no
bytes. A null ``doc_id`` row is returned whole and is no source; rows with the same id are
judged each by itself against smaller ids and its own text, equal ones alike: inside, a
row is named by its id and a ``version``, the digest of its text. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.anchors import anchor_counts, distinct_rows, exact_copies, repeated_anchors, repeated_ids, window_anchors, with_version, without
from trackweave.llm.common import HASHED, dropped, mixed, written
from trackweave.llm.induced_sort import MEMORY, Stats, on_disk, parts, suffix_array

ANCHOR_BYTES = 32
BLOCK_BYTES = 1 << 20
#: Bytes of runs a task brings together, but for the rest of the last anchor.
SHARD_BYTES = 1 << 22
RUN_WINDOWS = 512
#: Most places of an anchor whose runs are held and sorted together.
HOT_PLACES = 1 << 14
#: Runs a task gathers before it passes them on.
RUNS_A_BATCH = 20_000
#: End of a span that takes all of its document.
WHOLE = 2**62

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Text bytes are moved up by one and runs end with zero, so no window goes across.
_RAISED = bytes([*range(1, 256), 255])


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each 32 bytes, by doubling."""
    h = _BYTE[data]
    for j, step in enumerate(_STEP):
        half = 1 << j
        if len(h) <= half:
            return np.empty(0, dtype=np.uint64)
        h = h[:-half] * step + h[half:]
    return mixed(h)


def wide_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` bytes, from those of powers of two."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h, out, at, j = mixed(_BYTE[data] + np.uint64(seed)) if seed else _BYTE[data], np.zeros(n, dtype=np.uint64), 0, 0
    while width >> j:
        step = _STEP[j % len(_STEP)]
        if width >> j & 1:
            out = out * step + h[at : at + n]
            at += 1 << j
        if width >> (j + 1):
            h = h[: -(1 << j)] * step + h[1 << j :]
        j += 1
    return mixed(out)


def trimmed(runs: list[tuple], width: int) -> list[tuple]:
    """Runs from their first to their last window whose hash another window has too; runs without any go."""
    texts = [r[4] for r in runs]
    hashes = wide_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), width)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    windows = np.array([r[3] for r in runs])
    owner = np.repeat(np.arange(len(runs)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    _, kind, count = np.unique(hashes[begins[owner] + inside], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[kind] > 1)
    out = []
    for a, b in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(at)]))(np.flatnonzero(np.diff(owner[at])) + 1)) if len(at) else ():
        d, v, s, _, text, anchor = runs[owner[at[a]]]
        low, high = int(inside[at[a]]), int(inside[at[b - 1]])
        out.append((d, v, s + low, high - low + 1, text[low : high + width], anchor))
    return out


def blocks(data: bytes | np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, hashes, anchor of each window) of a text block by block, so arrays stay small however long it is."""
    array = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    for at in range(0, max(0, len(array) - width + 1), BLOCK_BYTES):
        hashes = byte_hashes(array[at : at + BLOCK_BYTES + width - 1])
        yield at, hashes, window_anchors(hashes, width - ANCHOR_BYTES + 1)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors_of(docs: DataFrame, width: int) -> DataFrame:
    """anchor, doc_id, version, places: distinct anchors of every row and at how many places they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, places, owner = [], [], []
            for i, text in enumerate(batch.column(2)):
                for _, hashes, anchors in blocks(text_bytes(text.as_py()), width):
                    distinct, counts = anchor_counts(hashes, anchors)
                    values.append(distinct)
                    places.append(counts)
                    owner.append(np.full(len(distinct), i))
            if values:
                rows = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(places), pa.int64())], names=["anchor", "doc_id", "version", "places"])

    return docs.mapInArrow(run, f"anchor bigint, doc_id {kind}, version binary, places bigint")


def neighbours(at: np.ndarray, of_window: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, count) of the runs of neighbouring places in ``at`` with one anchor, ``RUN_WINDOWS`` at most."""
    cut = np.flatnonzero((np.diff(at) != 1) | (of_window[at[1:]] != of_window[at[:-1]])) + 1
    for a, b in zip(at[np.r_[0, cut]].tolist(), at[np.r_[cut, len(at)] - 1].tolist()):
        for p in range(a, b + 1, RUN_WINDOWS):
            yield p, min(RUN_WINDOWS, b + 1 - p)


def without_copies(found: list[tuple], ids: list, versions: list) -> Iterator[tuple]:
    """The runs of a batch, those whose text starts earlier in the batch without their text and, where one follows another, as one.

    ``found``: (row, anchor, start, windows, text, hot), by row and start. Rows with the same id don't come before each other.
    """
    low: dict[bytes, object] = {}
    for r in found:
        low[r[4]] = min(ids[r[0]], low.get(r[4], ids[r[0]]))
    own: set[tuple] = set()
    held: tuple | None = None
    for r in found:
        here = (r[4], versions[r[0]])
        if ids[r[0]] > low[r[4]] or here in own:
            if held and held[0] == r[0] and held[2] + held[3] == r[2] and held[5] == r[5]:
                held = (*held[:3], held[3] + r[3], *held[4:])
                continue
            if held:
                yield held
            # It is judged already, so it is dealt by its place.
            held = (r[0], xxhash.xxh3_64_intdigest(f"{ids[r[0]]} {r[2]}"), *r[2:4], None, r[5])
        else:
            own.add(here)
            if held:
                yield held
                held = None
            yield r
    if held:
        yield held


def runs_of(docs: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """anchor, doc_id, version, start, windows, text, hot: neighbouring windows with the same repeated anchor; those of a hot one singly, with their hash for an anchor.

    Of equal texts of a batch all but the first have no text any more: they are repeated.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()

            def passed(found: list[tuple], batch: pa.RecordBatch = batch, ids: list = ids, versions: list = versions) -> pa.RecordBatch:
                owner, anchor, start, windows, text, hot = zip(*without_copies(found, ids, versions))
                rows = [batch.column(c).take(pa.array(owner)) for c in (0, 1)]
                return pa.RecordBatch.from_arrays([pa.array(np.array(anchor, dtype=np.uint64).view(np.int64)), *rows, pa.array(start, pa.int64()), pa.array(windows, pa.int32()), pa.array(text, pa.binary()), pa.array(hot)], names=["anchor", "doc_id", "version", "start", "windows", "text", "hot"])

            for i, (value, cold, hot) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4))):
                data = text_bytes(value.as_py())
                cold, hot = (np.unique(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in (cold, hot))
                for base, _, of_window in blocks(data, width):
                    for wanted, singly in ((cold, False), (hot, True)):
                        at = np.flatnonzero(np.isin(of_window, wanted)) if len(wanted) else wanted
                        for p, n in neighbours(at, of_window) if len(at) else ():
                            text = data[base + p : base + p + n + width - 1]
                            if singly:
                                found += [(i, h, base + p + j, 1, text[j : j + width], True) for j, h in enumerate(wide_hashes(np.frombuffer(text, dtype=np.uint8), width))]
                            else:
                                found.append((i, of_window[p], base + p, n, text, False))
                            if len(found) >= RUNS_A_BATCH:
                                yield passed(found)
                                found = []
            if found:
                yield passed(found)

    rows = docs.join(repeated.hint(HASHED), ["doc_id", "version"]).select("doc_id", "version", "text", "anchors", "hot")
    return rows.mapInArrow(run, f"anchor bigint, doc_id {kind}, version binary, start bigint, windows int, text binary, hot boolean")


def shard_text(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The runs' texts one after the other, each with an end, in a scratch file, and where each begins."""
    begins = np.cumsum([0, *(len(r[4]) + 1 for r in runs)])
    t = on_disk(int(begins[-1]), np.uint8)
    for at in range(0, len(runs), RUNS_A_BATCH):
        part = b"".join([r[4].translate(_RAISED) + b"\x00" for r in runs[at : at + RUNS_A_BATCH]])
        t[begins[at] : begins[at] + len(part)] = np.frombuffer(part, dtype=np.uint8)
    return t, begins


def equal_windows(t: np.ndarray, begins: np.ndarray, windows: np.ndarray, width: int, memory: int, stats: Stats | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, run, place) of the windows that another one equals, kind by kind, in blocks that part no kind."""
    order, commons = suffix_array(t, width, memory, stats)
    kind, held = 0, []
    for s in parts(len(t), memory):
        place, common = np.asarray(order[s]), commons[s.start : s.stop + 1]
        common = common if len(common) > len(place) else np.r_[common, 0]
        # Windows are equal when no suffix between them has a shorter common prefix.
        kinds = kind + np.cumsum(common[:-1] < width)
        kind = int(kinds[-1])
        some = np.flatnonzero((common[:-1] >= width) | (common[1:] >= width))
        run = np.searchsorted(begins, place[some], side="right") - 1
        inside = place[some] - begins[run] < windows[run]
        held.append((kinds[some][inside], run[inside], place[some][inside]))
        kinds, run, place = (np.concatenate(x) for x in zip(*held))
        done = np.searchsorted(kinds, kind) if s.stop < len(t) else len(kinds)
        held = [(kinds[done:], run[done:], place[done:])]
        if done:
            yield kinds[:done], run[:done], place[:done]


def repeated_in_shard(runs: list[tuple], width: int, memory: int = MEMORY, stats: Stats | None = None) -> list[tuple]:
    """(doc_id, version, start, end) of all windows of a shard that start earlier too, neighbouring ones joined; runs: (doc_id, version, start, windows, text, anchor)."""
    t, begins = shard_text(runs)
    starts, windows = np.array([r[2] for r in runs]), np.array([r[3] for r in runs])
    rows = sorted({r[:2] for r in runs})
    number = {r: i for i, r in enumerate(rows)}
    row = np.array([number[r[:2]] for r in runs])
    doc = np.cumsum([0, *(a[0] != b[0] for a, b in zip(rows, rows[1:]))])[row]
    again = on_disk(len(t), np.uint8)
    for kind, run, place in equal_windows(t, begins, windows, width, memory, stats):
        start = starts[run] + place - begins[run]
        order = np.lexsort((start, row[run], kind))
        kind, run, place = kind[order], run[order], place[order]
        new = np.r_[True, kind[1:] != kind[:-1]]
        low = doc[run[np.flatnonzero(new)]][np.cumsum(new) - 1]
        first = new | np.r_[True, row[run[1:]] != row[run[:-1]]]
        again[place[(doc[run] > low) | ~first]] = 1
    out = []
    for s in parts(len(t), memory):
        place = s.start + np.flatnonzero(again[s])
        if len(place):
            run = np.searchsorted(begins, place, side="right") - 1
            start = starts[run] + place - begins[run]
            cut = np.flatnonzero((run[1:] != run[:-1]) | (np.diff(start) > width)) + 1
            for k, a, b in zip(run[np.r_[0, cut]].tolist(), start[np.r_[0, cut]].tolist(), start[np.r_[cut, len(run)] - 1].tolist()):
                out.append((*runs[k][:2], a, b + width))
    return out


def repeated_spans(docs: DataFrame, *, width: int = 100) -> DataFrame:
    """doc_id, version, start, end (bytes, end excluded): all repeated windows of every row, runs of them joined where they met."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    several = repeated_ids(docs)
    docs = distinct_rows(docs, several)
    copies = exact_copies(docs)
    docs = without(docs, copies)
    repeated = repeated_anchors(anchors_of(docs, width), within=True, hot=HOT_PLACES)
    dealt = runs_of(docs, repeated, width).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "version", "start")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, size, now, latest = [], 0, None, {}
        for batch in batches:
            id_type, rows = batch.schema.field("doc_id").type, []
            for *r, anchor, hot in zip(*(batch[c].to_pylist() for c in ("doc_id", "version", "start", "windows", "text", "anchor", "hot"))):
                text = r[4]
                if anchor != now:
                    now, latest = anchor, {}
                    if size >= SHARD_BYTES:
                        rows += found(met)
                        met, size = [], 0
                # Runs come by id, version and start: the smallest id has a first run of a text for each of its versions.
                d, v = (None, None) if text is None else latest.setdefault(text, (r[0], None))
                if d != r[0] or v == r[1]:
                    rows.append((*r[:3], r[2] + r[3] + width - 1))
                    continue
                latest[text] = (d, r[1])
                if not hot:  # equal windows of a hot anchor have all met here
                    met.append((*r, anchor))
                    size += len(text)
            if rows:
                yield as_spans(rows, id_type)
        if met and (rows := found(met)):
            yield as_spans(rows, id_type)

    def found(met: list[tuple]) -> list[tuple]:
        runs = trimmed(met, width)
        return repeated_in_shard(runs, width) if runs else []

    def as_spans(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, versions, starts, ends = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(versions, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "version", "start", "end"])

    spans = dealt.mapInArrow(search, f"doc_id {kind}, version binary, start bigint, end bigint")
    spans = spans.unionByName(copies.select("doc_id", "version", F.lit(0).cast("bigint").alias("start"), F.lit(WHOLE).alias("end")))
    spans = written(spans)
    dropped(repeated, copies, several)
    return spans


def without_spans(docs: DataFrame, spans: DataFrame, width: int, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the characters none of whose bytes go) of every row, and the columns in ``keep``; texts under ``width`` bytes stay whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    also = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, shas, kept = [], [], [], [], []
            for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = text_bytes(text.as_py())
                merged: list[list[int]] = []
                for a, b in sorted(zip(starts.as_py() or (), ends.as_py() or ())) if len(data) >= width else ():
                    b = min(b, len(data))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(data)]
                parts = [data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in merged))
                counts.append(len(merged))
                shas.append(hashlib.sha256(b"".join(parts)).hexdigest())
                kept.append("".join(p.decode("utf-8", "ignore") for p in parts) if merged else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, gone, counts)], pa.array(shas), pa.array(kept, pa.string()), *batch.columns[4:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *keep])

    several = repeated_ids(docs)
    listed = spans.groupBy("doc_id", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = with_version(docs.select("doc_id", "text", *keep), several).join(listed.hint(HASHED), ["doc_id", "version"], "left").select("doc_id", "text", "starts", "ends", *keep)
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string{also}")


def suffix_dedup(docs: DataFrame, *, width: int = 100) -> DataFrame:
    return without_spans(docs, repeated_spans(docs, width=width), width)
