"""Cost-balanced packing of token sequences.

Documents become token ids (byte-level BPE, equal to the `tokenizers` library's ids) plus an end id. Each task
packs its documents in windows of about ``window`` tokens. Full capacities become sequences of their own. Of the
remaining tails a window opens as many sequences as their tokens fill, then assigns the tails in descending
length to the sequence of lowest estimated attention cost (linear plus quadratic in a piece's length) that has
room; a tail that fits nowhere is cut at the room of the lowest-cost sequence. What is left over of a window fills
sequences whose lengths are powers of two, so no sequence needs padding.

Nothing is shuffled: a sequence never spans two tasks. Null texts count as empty and give the end id alone; repeated
rows are packed as often as they stand; other columns are ignored. Sequence ids hold the partition's number.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PART_CHARS, default_ranks, encoder, text_slices
from .common import worker

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _ByRoom:
    """Open sequences, found by lowest cost among those with at least a given room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.tree: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def _update(self, room: int) -> None:
        heap, i = self.heaps[room], room + self.size
        self.tree[i] = (*heap[0], room) if heap else None
        i >>= 1
        while i:
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if b is None or (a is not None and a < b) else b
            i >>= 1

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence))
            self._update(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest sequence with at least ``room``."""
        best, a, b = None, room + self.size, 2 * self.size
        while a < b:
            for i in ([a] if a & 1 else []) + ([b - 1] if b & 1 else []):
                if self.tree[i] is not None and (best is None or self.tree[i] < best):
                    best = self.tree[i]
            a, b = (a + 1) >> 1, b >> 1
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._update(best[2])
        return best


def pack(lengths: list[int], capacity: int = 2048, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); every sequence comes out full."""
    pieces, sequence = [], 0
    tails = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((-(n % capacity), doc, n - n % capacity))
    total = -sum(t[0] for t in tails)
    sizes = [capacity] * (total // capacity) + [1 << i for i in reversed(range(capacity.bit_length())) if (total % capacity) >> i & 1]
    rooms, filled = _ByRoom(capacity), {}
    for size in sizes:
        rooms.put(size, 0.0, sequence)
        filled[sequence] = 0
        sequence += 1
    heapq.heapify(tails)
    while tails:
        n, doc, start = heapq.heappop(tails)
        n = -n
        got = rooms.take(n)
        if got is None:
            got = rooms.take(1)
            heapq.heappush(tails, (got[2] - n, doc, start + got[2]))
            n = got[2]
        cost, at, room = got
        pieces.append((doc, start, n, at, filled[at]))
        filled[at] += n
        rooms.put(room - n, cost + n + quadratic * n * n, at)
    return pieces


def pack_documents(docs: DataFrame, capacity: int = 2048, window: int = 4_000_000, quadratic: float = 1 / 4096, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids."""
    path = ranks_path or default_ranks()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        first = TaskContext.get().partitionId() << 36
        names, held, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, names, held, size
            if not names:
                return
            pieces = pack([len(x) for x in held], capacity, quadratic)
            for i in range(0, len(pieces), 20_000):
                part = pieces[i : i + 20_000]
                cut = [held[d][s : s + n] for d, s, n, _, _ in part]
                columns = [
                    pa.array([names[p[0]] for p in part], pa.int64()),
                    *(pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
                    pa.array([len(held[p[0]]) for p in part], pa.int64()),
                    pa.array([first + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)
            first += max(p[3] for p in pieces) + 1
            names, held, size = [], [], 0

        for batch in batches:
            for part, texts in text_slices(batch, "text", PART_CHARS):
                ids, counts = enc.encode_batch(texts)
                at = np.cumsum(counts) - counts
                for name, a, n in zip(part.column(0).to_pylist(), at.tolist(), counts.tolist(), strict=True):
                    names.append(name)
                    held.append(np.append(ids[a : a + n], np.int32(END_ID)))
                    size += n + 1
                if size >= window:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(worker(run), schema)
