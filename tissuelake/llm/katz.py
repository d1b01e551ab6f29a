"""Katz backoff language model of order three: Good-Turing discounts with exactly normalised backoff weights.

Tokens are words between white space (A-Z lowered) and one end token a text; two start marks stand before a text. Counts
up to ``K`` are discounted by Good-Turing, order by order, and what the discounts free goes to the words not seen after
a context, in proportion to their probability by the shorter context, down to the unknown word's probability:

    P(w | u v) = d3(c) c / C(u v)  where c = count(u v w) > 0,  else  b(u v) P(w | v);   P(w | v) alike, from P(w)
    b(h) = (1 - sum of seen) / (1 - sum of the shorter context's P over the seen words)

A context of which no count is discounted gives up one count's share, so b is never zero; one that never occurred leaves
the word to the shorter context. If the counts of counts as they stand put a discount outside (0, 1), as groups of
copies do, all of the order are taken from counts of counts smoothed by a log-linear fit. Only where that line falls no
faster than 1 / r, or fewer than two of the counts 1..K+1 occur, does absolute discounting of singletons take its place.

Documents are read once, as chunks of about ``chunk_bytes`` of text, which are written. Words go by their bytes to the
buckets that number them, so an n-gram is a few exact numbers, never a hash. A chunk sends each of its distinct
trigrams with its count to the bucket of the middle word, packed with all others for that bucket (never more packets
than distinct trigrams); there counts are summed, bigram counts follow as sums over the first word, and the chunk gets
back the counts and, of contexts from which it must back off, the counts of counts that make up the weights. Middle
words of more than ``heavy`` occurrences (more in very large corpora, so that there are at most ``MOST_HEAVY``) are
dealt by bigram instead, and bigrams as frequent as that by trigram; what their contexts need is summed by Spark to one
row a context, a bounded table that goes to all tasks. Nothing is capped or sampled.

Null texts count as empty (one end token); rows with null ids train the model and are scored; repeated rows count as
often as they stand; other columns are ignored. With no training text every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import mix64
from .common import discard_part, held_out, materialize, worker

K = 5
END = b""
BOS = 0
MOST_HEAVY = 1 << 17
SCHEMA = "key long, other long, kind int, data binary"
BODY, WORDS, STATS, IDS, MODEL, ASK, COUNTS, TOTALS = range(8)


# -- packets of arrays -------------------------------------------------------------------------------------------


def _small(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind not in "iub" or a.dtype.itemsize == 1:
        return np.ascontiguousarray(a)
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays (whole numbers must not be negative) as one packet; equal bytes of all numbers stand together."""
    raw = []
    for a in arrays:
        a = _small(np.asarray(a))
        raw += [b"%s %d %d\n" % (a.dtype.str.encode(), a.shape[0], a.shape[1] if a.ndim > 1 else 0), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    """The arrays of a packet, whole numbers as 64 bits."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, rows, columns = raw[at:end].split()
        kind, rows, columns = np.dtype(kind.decode()), int(rows), int(columns)
        n = rows * max(columns, 1)
        data = np.frombuffer(raw, np.uint8, n * kind.itemsize, end + 1).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(data.T).reshape(-1).view(kind)
        a = a.astype(np.int64) if kind.kind in "iu" else a
        out.append(a.reshape(rows, columns) if columns else a)
        at = end + 1 + n * kind.itemsize
    return out


def _joined(packets: list[list[np.ndarray]], i: int) -> np.ndarray:
    return np.concatenate([p[i] for p in packets])


# -- estimates ---------------------------------------------------------------------------------------------------


def turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's d(1..K) from the counts of counts as they stand, if each is between 0 and 1."""
    if not ((n[1 : K + 2] > 0).all() and n[1] > (K + 1) * n[K + 1]):
        return None
    r = np.arange(1, K + 1)
    out = (K + 1) * n[K + 1] / n[1]
    d = ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - out) / (1 - out)
    return d if ((d > 0) & (d < 1)).all() else None


def smoothed_turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's d(1..K) from counts of counts on the line log n(r) = a + b log r (Simple Good-Turing).

    The line is fitted through the counts that occur, each spread over the gaps beside it. On it (r + 1) n(r + 1) / (r n(r))
    is (1 + 1 / r) ** (b + 1), so every d is between 0 and 1 whenever b < -1; flatter lines give none.
    """
    r = np.flatnonzero(n[1 : K + 2] > 0) + 1
    if len(r) < 2:
        return None
    before = np.append(0, r[:-1])
    z = 2 * n[r] / (np.append(r[1:], 2 * r[-1] - before[-1]) - before)
    x, y = np.log(r), np.log(z)
    e = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()) + 1
    if e > -1e-6:
        return None
    out = np.expm1(e * np.log(K + 1))
    return (np.expm1(e * np.log1p(1 / np.arange(1, K + 1))) - out) / -out


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..K+1) from counts of counts n[0..K+1]; the last entry stands for all larger counts."""
    d = np.ones(K + 2)
    for estimate in (turing, smoothed_turing):
        found = estimate(n)
        if found is not None:
            d[1 : K + 1] = found
            return d
    if n[1] > 0:
        d[1] = 1 - min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2])))
    return d


@dataclass
class Unigrams:
    """Training totals and the unigram distribution; words of more than ``limit`` occurrences are heavy."""

    total: int = 0
    distinct: int = 0
    docs: int = 0
    d: np.ndarray = field(default_factory=lambda: np.ones(K + 2))
    unknown: float = 1.0
    scale: float = 1.0
    limit: int = 1 << 62

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.scale * self.d[np.minimum(c, K + 1)] * c / self.total, self.unknown)


def freed(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts that the discounts take from items of count 1..K (last axis of ``counts``)."""
    return counts @ ((1 - d[1 : K + 1]) * np.arange(1, K + 1))


def weights(total: np.ndarray, by_count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: what scales their seen words, and the share that is free for the others."""
    known = np.maximum(total, 1)
    free = freed(d, by_count) / known
    none = free <= 0
    return np.where(none, known / (known + 1), 1.0), np.where(none, 1 / (known + 1), free)


def katz_probability(c: np.ndarray, total: np.ndarray, p_seen: np.ndarray, by_count: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(w | h) from count(h w), the context's total, the shorter context's sum over the words seen after h, the
    numbers of successors with count 1..K, and P(w | shorter context)."""
    scale, free = weights(total, by_count, d)
    back = free / np.maximum(1 - p_seen, 1e-300)
    return np.where(total == 0, p, np.where(c > 0, scale * d[np.minimum(c, K + 1)] * c / np.maximum(total, 1), back * p))


def tally(counts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner, how many of its items have count 1..K (n x K)."""
    return np.stack([np.bincount(owner[counts == r], minlength=n) for r in range(1, K + 1)], 1)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]


# -- rows --------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "other", "kind", "data"])


def _chunks(docs: DataFrame, chunk_bytes: int, emit: Callable[[int, pa.Table], Iterator[tuple]]) -> DataFrame:
    """Rows that ``emit(chunk, rows)`` makes of each chunk of a task's rows; a chunk's number is partition << 24 | place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                j = i
                while j < batch.num_rows and (j == i or size + lengths[j] <= chunk_bytes):
                    size += int(lengths[j])
                    j += 1
                held.append(batch.slice(i, j - i))
                i = j
                if size >= chunk_bytes or i < batch.num_rows:
                    yield _batch(list(emit(chunk, pa.Table.from_batches(held).combine_chunks())))
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield _batch(list(emit(chunk, pa.Table.from_batches(held).combine_chunks())))

    return docs.mapInArrow(worker(run), SCHEMA)


def _by_key(rows: DataFrame, parts: int, place: Column, work: Callable, schema: str) -> DataFrame:
    """Bring the rows of each key together, in partition ``place``, and let ``work(key, {kind: [(other, data)]})`` make
    record batches of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for k, other, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if key is not None:
                        yield from work(key, held)
                    key, held = k, {}
                held.setdefault(kind, []).append((other, data))
        if key is not None:
            yield from work(key, held)

    dealt = rows.select("key", "other", "kind", "data").repartitionById(parts, place.cast("int"))
    return dealt.sortWithinPartitions("key", "kind", "other").mapInArrow(worker(run), schema)


def _unpacked(rows: DataFrame, kind: int, schema: str, columns: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """The packets of one kind as ordinary rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns(unpack_arrays(data))], names)

    return rows.filter(F.col("kind") == kind).select("data").mapInArrow(worker(run), schema)


def _sum_stats(rows: DataFrame) -> np.ndarray:
    """The sum of all STATS packets, which are short arrays of one length."""
    got = _unpacked(rows, STATS, "i long, v long", lambda a: [np.arange(len(a[0])), a[0]]).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["i"] + 1 for r in got), default=0), np.int64)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def _cut(place: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Of sorted places: each bucket that occurs, and the range of its entries."""
    ends = np.searchsorted(place, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, int(ends[b]), int(ends[b + 1])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values that ascend within runs as differences; a run's first value stays."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _unstepped(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values again, from the lengths of the runs."""
    total, starts = np.cumsum(steps), np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - steps[starts], lengths)


# -- words -------------------------------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (the end token first), the number of each token's word, and how many tokens each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets, flat = split.offsets.to_numpy(), split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[full]
    found = flat.filter(pa.array(full)).dictionary_encode()
    out = np.zeros(len(doc) + len(texts), np.int64)
    out[np.arange(len(doc)) + doc] = found.indices.to_numpy(zero_copy_only=False) + 1
    return [END, *found.dictionary.cast(pa.binary()).to_pylist()], out, np.bincount(doc, minlength=len(texts)) + 1


def _read_chunk(chunk: int, rows: pa.Table, buckets: int) -> Iterator[tuple]:
    """A chunk's tokens as a packet of its own, and its words with their training counts for the buckets."""
    words, token, size = tokens(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    train = rows["train"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    token = place[token]
    count = np.bincount(token, np.repeat(train, size), len(words)).astype(np.int64)
    bucket = np.array([xxhash.xxh3_64_intdigest(words[i]) % buckets for i in order.tolist()], np.int64)
    ids = rows["doc_id"].combine_chunks()
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield chunk, 0, BODY, pack_arrays(token, size, train, bucket, named, values.view(np.float64))
    asked = np.argsort(bucket, kind="stable")
    for b, i, j in _cut(bucket[asked], buckets):
        mine = [words[order[k]] for k in asked[i:j].tolist()]
        yield b, chunk, WORDS, pack_arrays(np.array([len(w) for w in mine]), np.frombuffer(b"".join(mine), np.uint8), count[asked[i:j]])


def _numbers(rank: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers of words by their rank in a bucket, from 1; frequent words have small ones."""
    return rank * buckets + bucket + 1


def _number_words(bucket: int, held: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    asked = [(other, unpack_arrays(data)) for other, data in held[WORDS]]
    packets = [a for _, a in asked]
    size, raw = _joined(packets, 0), _joined(packets, 1).astype(np.uint8)
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    at = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = found.dictionary
    count = np.bincount(at, _joined(packets, 2), len(names)).astype(np.int64)
    order = pc.sort_indices(pa.table({"c": count, "w": names}), [("c", "descending"), ("w", "ascending")]).to_numpy().astype(np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    rows, i = [], 0
    for other, a in asked:
        mine = at[i : i + len(a[0])]
        i += len(a[0])
        rows.append((other, bucket, IDS, pack_arrays(rank[mine], count[mine])))
    ends = pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
    rows.append((bucket, 0, STATS, pack_arrays(np.array([count.sum(), (count > 0).sum(), count[ends].sum(), *_counts_of_counts(count)]))))
    known = order[count[order] > 0]
    kept = names.take(pa.array(known)).to_pylist()
    rows.append((bucket, 0, MODEL, pack_arrays(_numbers(rank[known], bucket, buckets), count[known], np.array([len(w) for w in kept], np.int64), np.frombuffer(b"".join(kept), np.uint8))))
    yield _batch(rows)


# -- n-grams of a chunk ------------------------------------------------------------------------------------------


class Chunk:
    """Distinct n-grams of a chunk, in the order in which it asks the buckets for them."""

    def __init__(self, held: dict, uni: Unigrams, buckets: int):
        self.uni, self.buckets = uni, buckets
        token, self.size, train, bucket, self.named, values = unpack_arrays(held[BODY][0][1])
        self.doc_ids, self.train, n = values.view(np.int64), train.astype(bool), len(bucket)
        asked = np.argsort(bucket, kind="stable")
        got = [(b, unpack_arrays(data)) for b, data in sorted(held[IDS])]
        ids, count = np.empty(n, np.int64), np.empty(n, np.int64)
        ids[asked] = np.concatenate([_numbers(a[0], b, buckets) for b, a in got])
        count[asked] = _joined([a for _, a in got], 1)
        order = np.argsort(ids)  # from here on words go in the order of their numbers, after the start mark
        place = np.empty(n, np.int64)
        place[order] = np.arange(1, n + 1)
        token = place[token]
        self.ids, self.count = np.append(BOS, ids[order]), np.append(uni.docs, count[order])
        self.heavy = self.count > uni.limit
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        first = np.zeros(len(token), bool)
        first[np.cumsum(self.size) - self.size] = True
        self.w = token
        self.v = np.where(first, 0, np.append(0, token[:-1]))
        self.u = np.where(first, 0, np.append(0, self.v[:-1]))
        self.base = n + 1

    def _seen(self, which: np.ndarray, n: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(which, self.train[self.doc[of]], n).astype(np.int64)

    # bigrams of heavy words

    def pairs(self) -> None:
        at = np.flatnonzero(self.heavy[self.v])
        key, which = np.unique(self.v[at] * self.base + self.w[at], return_inverse=True)
        v, w = key // self.base, key % self.base
        place = (mix64(self.ids[v].astype(np.uint64) ^ mix64(self.ids[w].astype(np.uint64))) % np.uint64(self.buckets)).astype(np.int64)
        self.pair_key, self.pair_order = key, np.argsort(place, kind="stable")
        self.pair_args = (place, v, w, which, at)

    def pair_requests(self) -> Iterator[tuple[int, bytes]]:
        place, v, w, which, at = self.pair_args
        o, seen = self.pair_order, self._seen(which, len(v), at)
        for b, i, j in _cut(place[o], self.buckets):
            rows = o[i:j]
            new = np.flatnonzero(_changes(v[rows]))
            yield b, pack_arrays(self.ids[v[rows][new]], np.diff(np.append(new, len(rows))), self.ids[w[rows]], seen[rows], self.count[w[rows]])

    def learn_pairs(self, answers: list[tuple[int, bytes]]) -> None:
        self.pair_count = np.zeros(len(self.pair_key), np.int64)
        if answers:
            self.pair_count[self.pair_order] = np.concatenate([unpack_arrays(data)[0] for _, data in sorted(answers)])

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs of a heavy word and the next one, which occur in the chunk."""
        return self.pair_count[np.searchsorted(self.pair_key, v * self.base + w)]

    # trigrams

    def trigrams(self) -> None:
        context, of = np.unique(self.v * self.base + self.u, return_inverse=True)
        key, self.which = np.unique(of * self.base + self.w, return_inverse=True)
        c, w = key // self.base, key % self.base
        v, u = context // self.base, context % self.base
        hot = self.heavy[v] & self.heavy[u]
        spread = np.zeros(len(context), bool)
        inner = hot & ((u > 0) | (v > 0))
        spread[inner] = self.pair_counts(u[inner], v[inner]) > self.uni.limit
        spread[hot & ~inner] = True  # the two start marks, when there are so many documents
        name = self.ids.astype(np.uint64)
        near = mix64(name[v])
        near = np.where(self.heavy[v], mix64(near ^ name[u]), near)[c]
        near = np.where(spread[c], mix64(near ^ mix64(name[w])), near)
        place = (near % np.uint64(self.buckets)).astype(np.int64)
        o = np.argsort(place, kind="stable")
        # all that follows is in the order in which buckets are asked
        self.order, self.place, c, self.tw = o, place[o], c[o], w[o]
        self.tv, self.tu, self.tspread = v[c], u[c], spread[c]
        new_v, new_c = _changes(self.place, self.tv), _changes(self.place, c)
        self.v_at, self.c_at = np.flatnonzero(new_v), np.flatnonzero(new_c)
        self.v_run, self.c_run = np.cumsum(new_v) - 1, np.cumsum(new_c) - 1

    def low(self) -> np.ndarray:
        """What a bucket must be told of each trigram's end: count(v w) of heavy v, else count(w)."""
        out, at = self.count[self.tw].copy(), np.flatnonzero(self.heavy[self.tv])
        out[at] = self.pair_counts(self.tv[at], self.tw[at])
        return out

    def trigram_requests(self) -> Iterator[tuple[int, bytes]]:
        seen, low = self._seen(self.which, len(self.order))[self.order], self.low()
        for b, i, j in _cut(self.place, self.buckets):
            vs = self.v_at[np.searchsorted(self.v_at, i) : np.searchsorted(self.v_at, j)]
            cs = self.c_at[np.searchsorted(self.c_at, i) : np.searchsorted(self.c_at, j)]
            first = np.searchsorted(cs, vs)
            u = self.ids[self.tu[cs]]
            yield b, pack_arrays(self.ids[self.tv[vs]], self.heavy[self.tv[vs]], np.diff(np.append(first, len(cs))), _steps(u, first), self.tspread[cs], np.diff(np.append(cs, j)), self.ids[self.tw[i:j]], seen[i:j], low[i:j])


# -- sums of a bucket --------------------------------------------------------------------------------------------


def _add_pairs(bucket: int, held: dict, uni: Unigrams) -> Iterator[pa.RecordBatch]:
    asked = [(other, unpack_arrays(data)) for other, data in held[ASK]]
    packets = [a for _, a in asked]
    names, v = np.unique(np.repeat(_joined(packets, 0), _joined(packets, 1)), return_inverse=True)
    key, first, at = np.unique(v << 40 | _joined(packets, 2), return_index=True, return_inverse=True)
    count = np.bincount(at, _joined(packets, 3), len(key)).astype(np.int64)
    owner, known = key >> 40, count > 0
    p = uni.p(_joined(packets, 4)[first])
    rows, i = [], 0
    for other, a in asked:
        rows.append((other, bucket, COUNTS, pack_arrays(count[at[i : i + len(a[2])]])))
        i += len(a[2])
    n = len(names)
    rows.append((bucket, 0, TOTALS, pack_arrays(names, np.bincount(owner, count, n).astype(np.int64), np.bincount(owner[known], p[known], n), tally(count, owner, n))))
    rows.append((bucket, 0, STATS, pack_arrays(_counts_of_counts(count))))
    rows.append((bucket, 0, MODEL, pack_arrays(names[owner[known]], key[known] & ((1 << 40) - 1), count[known])))
    yield _batch(rows)


def _add_trigrams(bucket: int, held: dict, uni: Unigrams) -> Iterator[pa.RecordBatch]:
    asked = [(other, unpack_arrays(data)) for other, data in held[ASK]]
    packets = [a for _, a in asked]
    low40 = (1 << 40) - 1
    names, v_first, v_of = np.unique(_joined(packets, 0), return_index=True, return_inverse=True)
    heavy = _joined(packets, 1).astype(bool)[v_first]
    before = np.concatenate([_unstepped(a[3], a[2]) for a in packets])
    contexts, c_first, c_of = np.unique(np.repeat(v_of, _joined(packets, 2)) << 40 | before, return_index=True, return_inverse=True)
    spread = _joined(packets, 4).astype(bool)[c_first]
    key, first, t_of = np.unique(np.repeat(c_of, _joined(packets, 5)) << 40 | _joined(packets, 6), return_index=True, return_inverse=True)
    count = np.bincount(t_of, _joined(packets, 7), len(key)).astype(np.int64)
    low = _joined(packets, 8)[first]
    context, w, n_v, n_c = key >> 40, key & low40, len(names), len(contexts)
    v = contexts[context] >> 40
    known = count > 0
    # bigrams of the words that are here with all their contexts
    pairs, pair_first, pair_of = np.unique(v << 40 | w, return_index=True, return_inverse=True)
    pair_count = np.bincount(pair_of, count, len(pairs)).astype(np.int64)
    pair_v = pairs >> 40
    ours = ~heavy[pair_v]
    have = ours & (pair_count > 0)
    total2 = np.bincount(pair_v[ours], pair_count[ours], n_v).astype(np.int64)
    by2 = tally(pair_count[ours], pair_v[ours], n_v)
    seen1 = np.bincount(pair_v[have], uni.p(low[pair_first[have]]), n_v)
    count2 = np.where(heavy[v], low, pair_count[pair_of])
    # trigram contexts; the words seen after one by their bigram count
    total3 = np.bincount(context, count, n_c).astype(np.int64)
    by3 = tally(count, context, n_c)
    lower = np.where(known, count2, 0)
    by_lower = tally(lower, context, n_c)
    large = lower > K
    more = np.bincount(context[large], lower[large], n_c).astype(np.int64)
    mask = (by3 > 0) @ (1 << np.arange(K))
    rows, t_at, c_at, v_at = [], 0, 0, 0
    for other, a in asked:
        t, c, vs = t_of[t_at : t_at + len(a[6])], c_of[c_at : c_at + len(a[3])], v_of[v_at : v_at + len(a[0])]
        t_at, c_at, v_at = t_at + len(t), c_at + len(c), v_at + len(vs)
        got = count[t]
        unseen = got == 0
        c_start = np.cumsum(a[5]) - a[5]
        backing = np.logical_or.reduceat(unseen, c_start)
        v_back = np.logical_or.reduceat(backing, np.cumsum(a[2]) - a[2]) & ~heavy[vs]
        need = c[backing & ~spread[c] & (total3[c] > 0)]
        vb = vs[v_back]
        rows.append((other, bucket, COUNTS, pack_arrays(got, total3[c], mask[c], by3[need], by_lower[need], more[need], count2[t[unseen & ~heavy[v[t]]]], total2[vb], by2[vb], seen1[vb])))
    s = np.flatnonzero(spread)
    rows.append((bucket, 0, TOTALS, pack_arrays(names[contexts[s] >> 40], contexts[s] & low40, total3[s], by3[s], by_lower[s], more[s])))
    rows.append((bucket, 0, STATS, pack_arrays(np.concatenate([_counts_of_counts(pair_count[ours]), _counts_of_counts(count)]))))
    kept, size = np.unique(context[known], return_counts=True)
    mine, n_contexts = np.unique(contexts[kept] >> 40, return_counts=True)
    rows.append((bucket, 0, MODEL, pack_arrays(names[mine], n_contexts, _steps(contexts[kept] & low40, np.cumsum(n_contexts) - n_contexts), size, _steps(w[known], np.cumsum(size) - size), count[known])))
    yield _batch(rows)


# -- scores ------------------------------------------------------------------------------------------------------


class Heavy:
    """Contexts (a word, or one and the word before it) that are dealt over buckets, and the columns of their sums."""

    def __init__(self, table: pa.Table, columns: list[str | list[str]], before: str | None = None):
        """``table`` is sorted by v and ``before``."""
        v = table["v"].to_numpy()
        self.names = np.unique(v)
        self.keys = self._key(v, table[before].to_numpy() if before else 0)
        self.columns = [np.stack([table[n].to_numpy() for n in c], 1) if isinstance(c, list) else table[c].to_numpy() for c in columns]

    def _key(self, v: np.ndarray, u: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(self.names, v) << 40 | u

    def find(self, v: np.ndarray, u: np.ndarray | int = 0) -> list[np.ndarray]:
        """The columns of contexts that are all here."""
        at = np.searchsorted(self.keys, self._key(v, u))
        return [c[at] for c in self.columns]


def _log_probabilities(chunk: Chunk, answers: list[list[np.ndarray]], heavy2: Heavy, heavy3: Heavy, d2: np.ndarray, d3: np.ndarray) -> np.ndarray:
    """log10 P(w | u v) of the chunk's distinct trigrams, in their own order."""
    uni = chunk.uni
    c3, total, mask = (_joined(answers, i) for i in range(3))
    unseen, n_c, n_v = c3 == 0, len(total), len(chunk.v_at)
    spread, hot = chunk.tspread[chunk.c_at], chunk.heavy[chunk.tv[chunk.v_at]]
    c_back = np.logical_or.reduceat(unseen, chunk.c_at) if n_c else np.zeros(0, bool)
    v_back = np.logical_or.reduceat(unseen, chunk.v_at) if n_v else np.zeros(0, bool)
    by3, lower, more = np.zeros((n_c, K)), np.zeros((n_c, K)), np.zeros(n_c)
    need = c_back & ~spread & (total > 0)
    by3[need], lower[need], more[need] = (_joined(answers, i) for i in (3, 4, 5))
    if spread.any():
        at = chunk.c_at[spread]
        total[spread], by3[spread], lower[spread], more[spread] = heavy3.find(chunk.ids[chunk.tv[at]], chunk.ids[chunk.tu[at]])
        mask[spread] = (by3[spread] > 0) @ (1 << np.arange(K))
    # bigrams
    total2, by2, seen1 = np.zeros(n_v, np.int64), np.zeros((n_v, K)), np.zeros(n_v)
    light = v_back & ~hot
    total2[light], by2[light], seen1[light] = (_joined(answers, i) for i in (7, 8, 9))
    dense = v_back & hot
    if dense.any():
        total2[dense], seen1[dense], by2[dense] = heavy2.find(chunk.ids[chunk.tv[chunk.v_at[dense]]])
    # seen trigrams
    c, kept = chunk.c_run, mask[:, None] >> np.arange(K) & 1
    scale = weights(total, kept, d3)[0]
    p = scale[c] * d3[np.minimum(c3, K + 1)] * c3 / np.maximum(total, 1)[c]
    # the others
    at = np.flatnonzero(unseen)
    v, w, run, ctx = chunk.tv[at], chunk.tw[at], chunk.v_run[at], c[at]
    c2, far = np.zeros(len(at), np.int64), chunk.heavy[v]
    c2[~far] = _joined(answers, 6)
    c2[far] = chunk.pair_counts(v[far], w[far])
    p2 = katz_probability(c2, total2[run], seen1[run], by2[run], uni.p(chunk.count[w]), d2)
    known2 = np.maximum(total2, 1)
    share2 = weights(total2, by2, d2)[0] / known2
    seen2 = share2[run] * (lower[ctx] @ (d2[1 : K + 1] * np.arange(1, K + 1)) + d2[K + 1] * more[ctx])
    p[at] = katz_probability(np.zeros(len(at), np.int64), total[ctx], seen2, by3[ctx], p2, d3)
    out = np.empty(len(p))
    out[chunk.order] = np.log10(p)
    return out


@dataclass
class KatzModel:
    """The unigrams, the discounts of order two and three, and tables (bucket, packed arrays) of the counts: words (number,
    count, length, bytes), bigrams of heavy words (v, w, count), trigrams (v, contexts of each, u, words of each, w, count;
    u and w as steps within their runs)."""

    uni: Unigrams
    d2: np.ndarray
    d3: np.ndarray
    words: DataFrame
    pairs: DataFrame | None
    trigrams: DataFrame


def _model_rows(table: DataFrame) -> DataFrame:
    return table.filter(F.col("kind") == MODEL).select(F.col("key").alias("bucket"), "data")


def katz_scores(docs: DataFrame, train_col: str, chunk_bytes: int = 8_000_000, heavy: int = 1 << 18) -> tuple[DataFrame, KatzModel]:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of the rows where ``train_col`` is true."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(train_col).alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // chunk_bytes))
    kind = lambda table, k: table.filter(F.col("kind") == k)

    chunks = materialize(_chunks(docs, chunk_bytes, lambda chunk, rows: _read_chunk(chunk, rows, buckets)), "katz-chunks", "kind")
    low = (1 << 24) - 1
    n_chunks, most = kind(chunks, BODY).agg(F.count(F.lit(1)), F.max(F.col("key").bitwiseAND(F.lit(low)))).first()
    parts, key = max(1, n_chunks), F.col("key")
    by_chunk = (F.shiftright(key, 24) * F.lit((most or 0) + 1) + key.bitwiseAND(F.lit(low))) % F.lit(parts)
    words = materialize(_by_key(kind(chunks, WORDS), buckets, key, lambda b, held: _number_words(b, held, buckets), SCHEMA), "katz-words", "kind")

    discard_part(chunks, WORDS)
    stats, uni = _sum_stats(words), Unigrams()
    if len(stats):
        uni.total, uni.distinct, uni.docs = (int(x) for x in stats[:3])
        uni.d = discounts(stats[3:])
        uni.limit = max(heavy, uni.total // MOST_HEAVY)
    if uni.total:
        uni.unknown = float(freed(uni.d, stats[4 : K + 4]) / uni.total)
        if uni.unknown <= 1e-12:
            uni.unknown, uni.scale = 1 / (uni.total + 1), uni.total / (uni.total + 1)
    body = kind(chunks, BODY).unionByName(kind(words, IDS))
    held_uni = spark.sparkContext.broadcast(uni)

    def ask_pairs(chunk: int, held: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(held, held_uni.value, buckets)
        c.pairs()
        for b, data in c.pair_requests():
            yield _batch([(b, chunk, ASK, data)])

    asked = _by_key(body, parts, by_chunk, ask_pairs, SCHEMA)
    pairs = materialize(_by_key(asked, buckets, key, lambda b, held: _add_pairs(b, held, held_uni.value), SCHEMA), "katz-pairs", "kind")
    sums = _unpacked(pairs, TOTALS, "v long, total long, seen double, " + ", ".join(f"n{r} long" for r in range(1, K + 1)), lambda a: [*a[:3], *a[3].T])
    got = sums.groupBy("v").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).orderBy("v").toArrow()  # MOST_HEAVY rows at most
    heavy2 = Heavy(got, ["total", "seen", [f"n{r}" for r in range(1, K + 1)]])

    def received(held: dict) -> Chunk:
        c = Chunk(held, held_uni.value, buckets)
        c.pairs()
        c.learn_pairs(held.get(COUNTS, []))
        c.trigrams()
        return c

    def ask_trigrams(chunk: int, held: dict) -> Iterator[pa.RecordBatch]:
        for b, data in received(held).trigram_requests():
            yield _batch([(b, chunk, ASK, data)])

    body = body.unionByName(kind(pairs, COUNTS))
    asked = _by_key(body, parts, by_chunk, ask_trigrams, SCHEMA)
    trigrams = materialize(_by_key(asked, buckets, key, lambda b, held: _add_trigrams(b, held, held_uni.value), SCHEMA), "katz-trigrams", "kind")
    counts = _sum_stats(trigrams)
    counts = counts if len(counts) else np.zeros(2 * (K + 2), np.int64)
    n2, n3 = counts[: K + 2], counts[K + 2 :]
    more = _sum_stats(pairs)
    d2, d3 = discounts(n2 + more if len(more) else n2), discounts(n3)
    fields = ["total", *(f"n{r}" for r in range(1, K + 1)), *(f"m{r}" for r in range(1, K + 1)), "more"]
    sums = _unpacked(trigrams, TOTALS, "v long, u long, " + ", ".join(f"{f} long" for f in fields), lambda a: [*a[:3], *a[3].T, *a[4].T, a[5]])
    got = sums.groupBy("v", "u").agg(*[F.sum(c).alias(c) for c in fields]).orderBy("v", "u").toArrow()  # MOST_HEAVY rows at most
    heavy3 = Heavy(got, ["total", fields[1 : K + 1], fields[K + 1 : 2 * K + 1], "more"], "u")
    shared = spark.sparkContext.broadcast((heavy2, heavy3, d2, d3))

    def evaluate(_: int, held: dict) -> Iterator[pa.RecordBatch]:
        answers = [unpack_arrays(data) for other, data in sorted(held.get(COUNTS, [])) if other >= 0]
        chunk = received({**held, COUNTS: [(~other, data) for other, data in held.get(COUNTS, []) if other < 0]})
        uni, n = chunk.uni, len(chunk.size)
        logp = _log_probabilities(chunk, answers, *shared.value)
        base = np.log10((chunk.count + 0.1) / (uni.total + 0.1 * (uni.distinct + 1)))
        made = {
            "doc_id": pa.array(chunk.doc_ids, mask=~chunk.named.astype(bool)),
            "held_out": pa.array(~chunk.train),
            "n_tokens": pa.array(chunk.size),
            "n_known": pa.array(np.bincount(chunk.doc, (chunk.count > 0)[chunk.w], n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, uni.total, np.int64)),
            "base_score": pa.array(np.bincount(chunk.doc, base[chunk.w], n)),
            "score": pa.array(np.bincount(chunk.doc, logp[chunk.which], n)),
        }
        yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    first = kind(pairs, COUNTS).withColumn("other", F.bitwise_not("other"))  # answers about pairs bear the bucket's complement
    body = kind(chunks, BODY).unionByName(kind(words, IDS)).unionByName(first).unionByName(kind(trigrams, COUNTS))
    scored = _by_key(body, parts, by_chunk, evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored, KatzModel(uni, d2, d3, _model_rows(words), _model_rows(pairs), _model_rows(trigrams))


def lm_report(docs: DataFrame) -> DataFrame:
    """The digest of op10: learns from ids whose remainder modulo 10 is not 0, scores all documents."""
    return katz_scores(docs.withColumn("train", ~held_out("doc_id", 10, 0)), "train")[0]
