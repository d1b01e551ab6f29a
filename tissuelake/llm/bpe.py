"""Byte-level BPE: length-bucketed padded matrices in which every row merges its leftmost minimum-rank pair each round.

A batch of texts is split with array operations that reproduce the public split pattern (contractions, an
optional blank before letters, digits or signs, white space). Every distinct piece of the batch is encoded
once: pieces of like length are the rows of a padded matrix of token ids; each round looks the ranks of
changed pairs up in a hash table, merges the leftmost pair of least rank in every row, shifts the rest of
the row left, and takes finished rows out. Pieces of more than ``LONG`` bytes, for which rounds over a matrix
would be quadratic, go through a heap that does the same merges in the same order.

Null texts count as empty and give no ids; repeated rows, null ids and extra columns pass through row by row; a column
that is called like the one made is replaced. Hashes only group a batch's pieces: that the pieces of a group are equal
is compared code point by code point, and known pieces are looked up by their text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without, worker

LONG = 1024
NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters that are encoded together.
PART_CHARS = 1 << 19


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for value, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(name, points):
            table[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = value
    return table


def split_points(points: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Where pieces start, for code points of texts that end at ``doc_ends``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[0] = first[n] = True
    first[doc_ends] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = start.copy()
    at = np.flatnonzero(start[:n] & ~first[:n])  # a run that follows another one of its text
    at = at[kind[at - 1] == SPACE]
    start[at - 1] = True
    start[at[points[at - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & start[:n] & runs[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = points[quote + 1]
    two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0) * ~first[np.minimum(quote + 2, n)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, size in ((quote[short], 2), (quote[long], 3)):
        start[found + 1] = False
        start[found + size] = True
    return np.flatnonzero(start[:n])


def _parts(text: str) -> Iterator[str]:
    """A long text in parts; each cut stands before a blank after a visible character, where a piece starts anyway."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of every entry, in order."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes and decodes by a rank file (a line: base64 of the token's bytes, its rank)."""

    def __init__(self, ranks_path: str, max_cache: int = 350_000):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.max_cache = ranks, max_cache
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        written = [b" %d" % i for i in range(size)]
        self.digit_bytes = np.frombuffer(b"".join(written), np.uint8)
        self.digit_len = np.array([len(t) for t in written], np.int64)
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)
        self._clear()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none; a negative id stands for padding."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo].astype(np.int64) << 32 | b[todo]
        slot = self._slot(keys)
        while len(todo):
            got = self.keys[slot]
            hit = got == keys
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (got != -1)
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and finished rows (padded with -1)."""
        rows = np.arange(len(ids))
        width = ids.shape[1]
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        cols = np.arange(width)
        while len(rows):
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            live = best != NONE
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, rank, j, best = rows[live], ids[live], rank[live], j[live], best[live]
                if not len(rows):
                    return
                width = max(2, int((ids >= 0).sum(1).max()))
                ids, rank, cols = ids[:, :width], rank[:, :width], cols[:width]
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            r = np.arange(len(rows))
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[r, j] = best
            left = np.maximum(j - 1, 0)
            rank[r, left] = self.pair_rank(ids[r, left], ids[r, left + 1])
            right = np.minimum(j + 1, width - 1)
            rank[r, j] = np.where(j + 1 < width, self.pair_rank(ids[r, j], ids[r, right]), NONE)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, in n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.ranks
        spans = [bytes([b]) for b in piece]
        heap = [(table[spans[i] + spans[i + 1]], i, ids[i], ids[i + 1]) for i in range(n - 1) if spans[i] + spans[i + 1] in table]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], spans[i] = rank, spans[i] + spans[k]
            ids[k], after[i] = -1, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := table.get(spans[x] + spans[y])) is not None:
                    heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        longs = {int(i): np.array(self._merge_long(pieces[i]), np.int32) for i in np.flatnonzero(sizes > LONG)}
        low = 0
        for width in (2, 4, 6, 8, 12, 16, 32, 64, 128, 256, 512, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, (1 << 20) // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                raw = np.frombuffer(b"".join(pieces[k] for k in part), np.uint8)
                inside = np.arange(width) < sizes[part][:, None]
                ids = np.full(inside.shape, -1, np.int32)
                ids[inside] = self.byte_ids[raw]
                found += [(part[r], done) for r, done in self._merge_rows(ids)]
        count = np.zeros(len(pieces), np.int64)
        for rows, done in found:
            count[rows] = (done >= 0).sum(1)
        for i, ids in longs.items():
            count[i] = len(ids)
        at = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for rows, done in found:
            flat[gather(at[rows], count[rows])] = done[done >= 0]
        for i, ids in longs.items():
            flat[at[i] : at[i] + len(ids)] = ids
        return flat, count

    def _learn(self, pieces: list[str]) -> None:
        flat, count = self.encode_pieces([p.encode() for p in pieces])
        n, base = len(self.known), self.used
        while n + len(pieces) > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        while base + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[base : base + len(flat)] = flat
        self.count[n : n + len(pieces)] = count
        self.at[n : n + len(pieces)] = base + np.cumsum(count) - count
        self.used += len(flat)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(parts)
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        counts = np.zeros(len(parts), np.int64)
        if not text:
            return np.zeros(0, np.int32), counts
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = split_points(points, ends)
        stop = np.append(begin[1:], len(points))
        sample, back = _distinct(text, points, begin, stop)
        if len(self.known) + len(sample) > self.max_cache:
            self._clear()
        names = [text[i:j] for i, j in zip(begin[sample].tolist(), stop[sample].tolist(), strict=True)]
        where = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(where < 0)
        if len(new):
            first = len(self.known)
            self._learn([names[i] for i in new])
            where[new] = np.arange(first, first + len(new))
        entry = where[back]
        each = self.count[entry]
        ids = self.flat[gather(self.at[entry], each)]
        tokens = np.append(0, np.cumsum(each))
        upto = tokens[np.searchsorted(begin, ends)]
        return ids, np.diff(upto, prepend=0)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            for p in _parts(t or ""):
                parts.append(p)
                owner.append(k)
        out, counts, i = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= PART_CHARS):
                size += len(parts[j])
                j += 1
            ids, each = self._encode_parts(parts[i:j])
            out.append(ids)
            np.add.at(counts, owner[i:j], each)
            i = j
        return np.concatenate(out), counts

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[gather(self.token_at[ids], self.token_len[ids])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.digit_bytes[gather(self.digit_at[ids], self.digit_len[ids])].tobytes()[1:]


def _distinct(text: str, points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces that tile ``points``: where each distinct piece occurs, and each piece's number among them."""
    power, inverse = _powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_point_values()[points] * power, out=total[1:])
    hashes = (total[stop] - total[begin]) * inverse[begin]
    _, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
    size, same = stop - begin, sample[back]
    if (size == size[same]).all() and (points[gather(begin[same], size)] == points).all():
        return sample, back
    seen: dict[str, int] = {}  # different pieces share a hash
    back = np.fromiter((seen.setdefault(text[i:j], len(seen)) for i, j in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, len(begin))
    return np.unique(back, return_index=True)[1], back


@lru_cache(1)
def _point_values() -> np.ndarray:
    return mix64(np.arange(0x110000, dtype=np.uint64))


BASE = 0x2545F4914F6CDD1D
_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64, and of its inverse."""
    if not _power_cache or len(_power_cache[0]) < n:
        size = max(n, PART_CHARS)
        _power_cache[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _power_cache[0][:n], _power_cache[1][:n]


@lru_cache(2)
def encoder(ranks_path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(ranks_path)


def text_slices(batch: pa.RecordBatch, text_col: str, chars: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in slices of about ``chars`` characters."""
    texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= chars):
            size += len(texts[j] or "")
            j += 1
        yield batch.slice(i, j - i), texts[i:j]
        i = j


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``df`` with the text's token ids as array<int>."""
    path, df = ranks_path or default_ranks(), without(df, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, text_col, PART_CHARS):
                ids, counts = enc.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])

    return df.mapInArrow(worker(run), T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids give null."""
    path, df = ranks_path or default_ranks(), without(df, bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            made = pa.array([None if x is None else enc.decode(np.array(x, np.int64)) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, bytes_col])

    return df.mapInArrow(worker(run), T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def token_report(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """The digest of op4: number of ids, hash of the ids, hash of what they decode to."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text", PART_CHARS):
                ids, counts = enc.encode_batch(texts)
                ends = np.cumsum(counts)
                hashed, plain = [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    hashed.append(hashlib.sha256(enc.decimal(ids[a:b])).hexdigest())
                    plain.append(hashlib.sha256(enc.decode(ids[a:b])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(hashed, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(worker(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
