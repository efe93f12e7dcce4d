"""Sequence packing by Karmarkar-Karp multiway differencing.

Each task cuts its documents' ids into full windows and one rest, and gathers rests until
they fill ``WINDOWS`` windows. Differencing then merges partial partitions, the largest
imbalance first, heavy windows of one against light windows of the other, which leaves
windows of nearly equal length. When one is over capacity the count of windows rises by one
and the differencing starts again, as long as no more than ``PADDING`` of the capacity stays
empty; then what is over capacity is cut off, and the largest surplus goes where most room is.
So most rests stay whole. Nothing is shuffled: what a task holds is a few hundred thousand
ids and one document, whatever the input's size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.tokens import ByteLevelIds

CAPACITY, WINDOWS, PADDING = 2048, 64, 0.02
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Partition the items into ``k`` lists of indices with nearly equal sums.

    Every item starts as a partition of its own: one window of its size and k - 1 empty
    ones. The two partitions of the largest spread are merged until one is left: the
    heaviest windows of one get the lightest of the other. Ties go by item order.
    """
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    # (-spread, order, sums descending, members); windows beyond the members are empty
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        # sums are descending and padded with empty windows: the j-th heaviest of b joins the (k-1-j)-th of a
        a = sums + [0] * (k - len(sums))
        m = sets + [[] for _ in range(k - len(sets))]
        for j, (s, own) in enumerate(zip(sums_b, sets_b, strict=True)):
            a[k - 1 - j] += s
            m[k - 1 - j] = m[k - 1 - j] + own
        at = sorted((i for i in range(k) if a[i]), key=a.__getitem__, reverse=True)
        sums, sets = [a[i] for i in at], [m[i] for i in at]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), order, sums, sets))
        order += 1
    sets = heap[0][3]
    return sets + [[] for _ in range(k - len(sets))]


def windows(sizes: list[int], capacity: int = CAPACITY, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of (item, start, length) pieces, none over capacity.

    The count of windows begins at the total's floor and rises while a window is over capacity
    and at most ``padding`` of all windows would stay empty. At the last count the surplus is cut.
    """
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    most = max(k, int(total / (capacity * (1 - padding))))
    while True:
        sets = differenced(sizes, k)
        sums = [sum(sizes[i] for i in s) for s in sets]
        if max(sums) <= capacity or k >= most:
            break
        k += 1
    out = [[(i, 0, sizes[i]) for i in s] for s in sets]
    room = [(n - capacity, j) for j, n in enumerate(sums) if n < capacity]
    heapq.heapify(room)
    over = []
    for j, n in enumerate(sums):
        while n > capacity:
            # the end of the longest piece
            at = max(range(len(out[j])), key=lambda x: out[j][x][2])
            i, start, length = out[j].pop(at)
            cut = min(n - capacity, length)
            if cut < length:
                out[j].insert(at, (i, start, length - cut))
            over.append((-cut, i, start + length - cut))
            n -= cut
    heapq.heapify(over)
    while over:
        cut, i, start = heapq.heappop(over)
        free, j = heapq.heappop(room)
        n = min(-cut, -free)
        out[j].append((i, start, n))
        if n < -cut:
            heapq.heappush(over, (cut + n, i, start + n))
        if n < -free:
            heapq.heappush(room, (free + n, j))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and its ids' checksum.

    ``with_ids`` adds the ids themselves (``array<int>``). Null and empty texts are the one
    ``end_id``; repeated rows are packed each; a null id stays null; no rows give no rows;
    further columns are left out; texts may be of any length. ``sequence_id`` is unique in the
    result: the task's number in its high bits. A sequence is shorter than ``capacity`` only if
    it is one of the near-equal windows.
    """
    small_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelIds(tokenizer)
        sequence, held, waiting = TaskContext.get().partitionId() << 40, 0, []
        out: list[tuple] = []

        def emit(doc, start, ids, total, offset):
            raw = ids.tobytes()
            out.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, *([ids] if with_ids else [])))

        def settle():
            nonlocal sequence, held
            for own in windows([len(x[2]) for x in waiting], capacity):
                offset = 0
                for i, at, n in sorted(own):
                    doc, start, ids, total = waiting[i]
                    emit(doc, start + at, ids[at : at + n], total, offset)
                    offset += n
                sequence += bool(own)
            waiting.clear()
            held = 0

        def batch():
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7 + with_ids)]
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), end_id], dtype="<u4")
                total = len(ids)
                full = total // capacity * capacity
                for at in range(0, full, capacity):
                    emit(doc, at, ids[at : at + capacity], total, 0)
                    sequence += 1
                if full < total:
                    waiting.append((doc, full, ids[full:].copy(), total))
                held += total - full
                # a total just below a whole count of windows leaves little slack
                if held >= WINDOWS * capacity and (-held % capacity <= capacity // 8 or held >= 2 * WINDOWS * capacity):
                    settle()
                if len(out) >= 4096:
                    yield batch()
        settle()
        yield batch()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(packed, schema)
