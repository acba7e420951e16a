"""Packing of documents into training sequences of balanced attention cost."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import blocks, mix64, raw, small_batches
from vireo.llm.tokens import default_vocabulary, encoder


def attention_cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated cost of one piece: what every token costs, and what tokens pay each other."""
    return linear * length + quadratic * length * length


def plan(sizes: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each document's tokens
    once, in as few sequences as their sum allows.

    Whole sequences are cut off long documents first. What is left is assigned by descending
    size to the sequence of lowest cost of all that have room for it; if none has, it is cut
    at the room of the roomiest and the rest waits for its turn by size. Documents without
    tokens give no piece.

    Sequences with the same room are held in one heap by cost, and the heaps' least costs in
    a tree over room, so each search takes logarithmic time and no sequence is passed over.
    """
    pieces, rest, n = [], [], 0
    for d, size in enumerate(sizes):
        for at in range(0, size - capacity + 1, capacity):
            pieces.append((d, at, capacity, n, 0))
            n += 1
        if size % capacity:
            rest.append((-(size % capacity), d, size - size % capacity))
    heapq.heapify(rest)
    bins = -(-sum(-x[0] for x in rest) // capacity)
    room = [capacity] * bins
    none = (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, i) for i in range(bins)]
    half = 1 << capacity.bit_length()
    least = [none] * (2 * half)  # node half + r: least cost of room r; inner nodes: of their two

    def settle(r: int) -> None:
        at = half + r
        least[at] = heaps[r][0] if heaps[r] else none
        while at > 1:
            at >>= 1
            x, y = least[2 * at], least[2 * at + 1]
            least[at] = x if x <= y else y

    def cheapest(r: int) -> tuple[float, int]:
        lo, hi, best = half + r, 2 * half, none
        while lo < hi:
            if lo & 1:
                best, lo = min(best, least[lo]), lo + 1
            lo, hi = lo >> 1, hi >> 1
        return best

    settle(capacity)
    while rest:
        left, d, at = heapq.heappop(rest)
        left = -left
        best = cheapest(left)
        if best[1] < 0:
            r = next(r for r in range(left - 1, 0, -1) if heaps[r])
            best = heaps[r][0]
        cost, i = best
        r = room[i]
        heapq.heappop(heaps[r])
        settle(r)
        take = min(left, r)
        pieces.append((d, at, take, n + i, capacity - r))
        room[i] -= take
        if room[i]:
            heapq.heappush(heaps[room[i]], (cost + attention_cost(take, linear, quadratic), i))
            settle(room[i])
        if take < left:
            heapq.heappush(rest, (take - left, d, at + take))
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048, group_bytes: int = 24 << 20, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all
    documents. ids are the piece's token ids as little-endian unsigned 32-bit integers; start
    counts its document's ids before it; in each sequence the offsets run without gaps from 0.

    Documents are dealt, by a hash of their text and place, into groups of about group_bytes of text, each packed by one
    task that holds one group's tokens (compressed) and no more; the number of groups follows
    from the bytes of all texts. Each group leaves less than one sequence of padding.

    Null text counts as empty: every row has at least its end id. Repeated rows and ids are
    packed each for itself, and equal rows are dealt to all groups alike. A sequence's id has
    its group's number in the upper half, whatever task packs it. Ties in size go by the hash of id and text. A text longer
    than a group is one row of its group. An empty table gives no rows. Other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    groups = max(1, round(total / group_bytes))

    def encode(batches):
        run, squeeze = encoder(path), zstandard.ZstdCompressor(level=1).compress
        place = np.uint64(TaskContext.get().partitionId() << 40)  # of the task's next row among all
        for block in blocks(batches, "text", 8 << 20):
            row = 0
            for group in run.groups(raw(block, "text")):
                ids = [np.r_[x, end] for x in group]
                packed = [squeeze(x.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()) for x in ids]  # bytes of one weight together
                rid = block.column(1).slice(row, len(ids))
                at = mix64(rid.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ mix64(np.arange(len(ids), dtype=np.uint64) + place))
                group = pa.array((at % np.uint64(groups)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([group, block.column(0).slice(row, len(ids)), rid, pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())], names=["group", "id", "rid", "n", "packed"])
                row += len(ids)
                place += np.uint64(len(ids))

    def fill(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:  # of one group after the other, should partitions be joined
            group = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[len(group) > 0, group[1:] != group[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
                if held and held[-1].column(0)[0].as_py() != group[a]:
                    yield from fill_group(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from fill_group(held)

    def fill_group(batches):
        t = pa.Table.from_batches(batches).sort_by("rid").combine_chunks().to_batches()[0]
        ids, n, packed = t.column(1), t.column(3).to_pylist(), raw(t, "packed")
        base = t.column(0)[0].as_py() << 32
        pieces = sorted(plan(n, capacity, linear, quadratic))
        unpack = zstandard.ZstdDecompressor().decompress
        have, tokens = -1, None
        for i in range(0, len(pieces), 500):
            some = pieces[i : i + 500]
            blobs = []
            for d, at, length, _, _ in some:
                if d != have:
                    have, tokens = d, np.frombuffer(unpack(packed[d]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                blobs.append(tokens[at : at + length].tobytes())
            d, at, length, seq, off = (np.array(x, dtype=np.int64) for x in zip(*some))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(at), pa.array(length), pa.array(blobs, pa.binary()), pa.array(np.array(n, dtype=np.int64)[d]), pa.array(seq + base), pa.array(off)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInArrow(encode, f"group int, id {kind}, rid long, n long, packed binary")
    return coded.repartitionById(groups, "group").mapInArrow(fill, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
