"""Operator 6: packing documents into training sequences, best fit decreasing.

A document's ids (with an end id) that exceed the window are cut into full
windows first. What remains is placed in order of decreasing length, each
piece into the open window with the least room that still holds it; a segment
tree over the remaining capacities finds that window in logarithmic time.
Windows that stay far from full are dissolved: their pieces are cut to fill
the room of the others. What is then left in the last window of a block is
cut at powers of two, where no padding is due.

Each task packs its own rows in blocks of a bounded number of ids, so memory
does not depend on the input and no rows are exchanged between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from likeness.llm.arrow import CHUNK_CHARS
from likeness.llm.bpe import load
from likeness.runtime import ship


class OpenWindows:
    """Open windows by remaining capacity; the leaves of the tree are the capacities."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.by_room: dict[int, list[int]] = {}

    def put(self, room: int, w: int) -> None:
        held = self.by_room.setdefault(room, [])
        held.append(w)
        if len(held) == 1:
            i = room + self.size
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of a window with the least room of at least ``need``."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # climb until a right sibling holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                i += not self.any[i]
        room = i - self.size
        held = self.by_room[room]
        w = held.pop()
        if not held:
            while i and not (i < self.size and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i >>= 1
        return room, w


def pack_lengths(lengths: list[int], window: int, slack: int = 16) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold every id of every item once.

    Sequences are numbered from 0; those of the whole lie in [0, window] and
    are gapless. Items of length 0 give no piece.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, item, start
    n_seq = 0
    for i, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            out.append((i, k * window, window, n_seq, 0))
            n_seq += 1
        if n > full * window:
            rest.append((n - full * window, i, full * window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    free = OpenWindows(window)
    held: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    for piece in rest:
        found = free.take(piece[0])
        if found is None:
            held.append([])
            room.append(window)
            w = len(held) - 1
        else:
            w = found[1]
        held[w].append(piece)
        room[w] -= piece[0]
        if room[w]:
            free.put(room[w], w)
    # dissolve the emptiest windows into the room of the others
    loose = sorted((w for w in range(len(held)) if room[w] > slack), key=lambda w: (room[w], w))
    done = [w for w in range(len(held)) if room[w] <= slack]
    lo, hi = 0, len(loose) - 1
    while lo < hi:
        to, from_ = loose[lo], loose[hi]
        n, i, s = held[from_].pop()
        take = min(n, room[to])
        held[to].append((take, i, s))
        room[to] -= take
        room[from_] += take
        if take < n:
            held[from_].append((n - take, i, s + take))
        if not room[to]:
            done.append(to)
            lo += 1
        if not held[from_]:
            hi -= 1
    for w in done:
        at = 0
        for n, i, s in held[w]:
            out.append((i, s, n, n_seq, at))
            at += n
        n_seq += 1
    if lo == hi:
        left = window - room[loose[lo]]
        size, at = 1 << (left.bit_length() - 1), 0
        for n, i, s in held[loose[lo]]:
            while n:
                take = min(n, size - at)
                out.append((i, s, take, n_seq, at))
                n, s, at = n - take, s + take, at + take
                if at == size:
                    left -= size
                    n_seq, at, size = n_seq + 1, 0, 1 << max(left.bit_length() - 1, 0)
    return out


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, block_ids: int = 4_000_000, slack: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each.
    An empty table gives no rows. Other columns are dropped. A sequence holds
    rows of one input partition; its id has the partition in the upper bits.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))

    def flush(doc_ids: list, ids: list[np.ndarray], ends: list[np.ndarray], base: int):
        lens = np.concatenate([np.diff(e, prepend=0) for e in ends])
        flat = np.concatenate(ids)
        first = np.cumsum(lens) - lens
        got = np.array(pack_lengths(lens.tolist(), window, slack), np.int64).reshape(-1, 5)
        who, start, n, seq, at = got.T
        from_ = first[who] + start
        stops = np.cumsum(n)
        data = flat[np.repeat(from_ - (stops - n), n) + np.arange(int(stops[-1]))].astype("<u4")
        offsets = pa.py_buffer(np.append(0, stops * 4).astype(np.int32))
        arrays = [
            pa.array(doc_ids, pa.int64()).take(pa.array(who)),
            pa.array(start),
            pa.array(n),
            pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(data)]),
            pa.array(lens[who]),
            pa.array(seq + base),
            pa.array(at),
        ]
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        whole = pa.RecordBatch.from_arrays(arrays, names=names)
        for lo in range(0, len(n), 4096):
            yield whole.slice(lo, 4096)

    def run(batches):
        enc = load(path)
        base = TaskContext.get().partitionId() << 40
        doc_ids, ids, ends, held = [], [], [], 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
                    size += len(texts[hi])
                    hi += 1
                flat, stop = enc.encode(texts[lo:hi])
                stop_with = stop + np.arange(1, len(stop) + 1)
                ended = np.full(len(flat) + len(stop), end_id, np.int32)
                body = np.ones(len(ended), bool)
                body[stop_with - 1] = False
                ended[body] = flat
                doc_ids += keys[lo:hi]
                ids.append(ended)
                ends.append(stop_with)
                held += len(ended)
                if held >= block_ids:
                    yield from flush(doc_ids, ids, ends, base)
                    base += len(doc_ids) + held // window + 64  # more than the sequences of the block
                    doc_ids, ids, ends, held = [], [], [], 0
                lo = hi
        if held:
            yield from flush(doc_ids, ids, ends, base)

    return src.mapInArrow(run, f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
