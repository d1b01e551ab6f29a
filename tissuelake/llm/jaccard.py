"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops them, exact sets decide.

A document is the set of its shingles of ``WORDS`` words (lower case, split at white space; a shorter text is one
shingle). Equal word sequences are one text, so copies are never compared: texts carry their number of documents.
Texts, words and shingles are told apart by 128 bits that start from a cryptographic hash of their bytes.

Every text has 96 MinHash values in 24 bands of 4. Texts that agree in a band are a candidate pair, looked at in the
first band where they agree and nowhere else. Its values are compared sixteen at a time; with a uniform prior on the
similarity, the pair is dropped as soon as the posterior probability that it reaches ``threshold`` falls below
``tolerance``. What is left is decided by the exact Jaccard similarity of the shingle sets.

Buckets of any size are cut into blocks of about ``BLOCK`` texts (a 32nd of the bucket, up to ``MOST``, in large ones,
so that a text is sent 32 times at most in buckets of up to 32 * MOST texts); a task compares one block with itself or
with another one, so no group comes together in one task. Pairs never become rows: tasks return, per text, how many documents it is
linked to and one edge of a spanning forest of its links.

A true pair at similarity 0.8 shares no band with probability 3e-6. Documents without words (null or blank) have no
link and are their own class. Repeated rows count as copies. Rows with null ids are compared and counted like all
others; only the class of a group that has no id at all is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import gather, mix64, text_slices
from .common import discard, fresh, materialize, worker
from .components import components

WORDS = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
BLOCK, MOST = 512, 8192
PAIRS = 1 << 16
#: Characters that are cut into words together.
SLICE = 1 << 20
BITMAP_BITS = 24
MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two columns) of all shingles in order, and how many each normalised text has (0 for an empty one)."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), pattern=" ")
    words = np.where([bool(t) for t in texts], np.diff(split.offsets.to_numpy()), 0)
    flat = split.flatten()
    found = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    total = int(words.sum())
    counts = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    names = np.zeros((total + WORDS, 2), np.uint64)
    bits = b"".join(map(digest, found.dictionary.cast(pa.large_binary()).to_pylist()))
    names[:total] = np.frombuffer(bits, np.uint64).reshape(-1, 2)[found.indices.to_numpy(zero_copy_only=False)]
    every = np.zeros((total, 2), np.uint64)
    for i in range(WORDS):
        every = mix64(every ^ np.uint64(i)) + names[i : total + i]
    first = np.cumsum(words) - words
    out = every[gather(first, counts)]
    short = np.flatnonzero((words > 0) & (words < WORDS))
    if len(short):  # these end before their fifth word
        made = np.zeros((len(short), 2), np.uint64)
        for i in range(WORDS):
            made = mix64(made ^ np.uint64(i)) + np.where((i < words[short])[:, None], names[first[short] + i], np.uint64(i))
        out[(np.cumsum(counts) - counts)[short]] = made
    return mix64(out), counts


def codes(rows: np.ndarray) -> np.ndarray:
    """Numbers of 128-bit values, equal for equal values only, in the order of the values."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    ahead = rows[order]
    number = np.cumsum(np.append(False, (ahead[1:] != ahead[:-1]).any(1)))
    out = np.empty(len(rows), np.int64)
    out[order] = number
    return out


def distinct(rows: np.ndarray) -> np.ndarray:
    """Each 128-bit value once."""
    return rows[np.unique(codes(rows), return_index=True)[1]]


def minhashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16-bit MinHash values (text x 96) of texts that each have a shingle."""
    out = np.zeros((len(counts), HASHES), np.uint16)
    if len(counts):
        first = np.cumsum(counts) - counts
        for i in range(HASHES):
            out[:, i] = mix64(np.minimum.reduceat(hashes * MULTIPLIERS[i] + OFFSETS[i], first)).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Per number of compared values, the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= x | m of t match) = P(Binomial(t + 1, x) <= m).
    """
    out = np.zeros(HASHES + 1, np.int64)
    for t in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(t + 1, m) * threshold**m * (1 - threshold) ** (t + 1 - m)
        out[t] = m
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                texts = [normalised(t) for t in texts]
                hashes, counts = shingles(texts)
                sig = np.zeros((len(texts), HASHES), np.uint16)
                sig[counts > 0] = minhashes(hashes[:, 0], counts[counts > 0])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(sig.view(np.int64).ravel()))
                rid = pa.array([digest(t.encode()) if t else None for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), rid, bands], ["doc_id", "rid", "sig"])

    return docs.select("doc_id", "text").mapInArrow(worker(run), "doc_id long, rid binary, sig array<long>")


GROUP = ["band", "v", "i", "j"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, and where each group starts."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = _starts(table)
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks(), starts[:-1]
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _starts(held)


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table[c].to_numpy().astype(np.int64) for c in GROUP], 1)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)


def _compared(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per text and group with a surviving pair: its place in the group and its partners' places (larger ones)."""
    floor = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches):
            n = table.num_rows
            size = np.diff(np.append(starts, n))
            group = np.repeat(np.arange(len(starts)), size)
            after = np.repeat(starts + size, size) - np.arange(n) - 1
            mine, cross = table["mine"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()
            band = table["band"].to_numpy()
            bands = table["sig"].combine_chunks().flatten().to_numpy().reshape(n, BANDS)
            values = bands.view(np.uint16)
            ends, lefts, rights = np.cumsum(after), [], []
            row = 0
            while row < n:
                upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
                k = after[row:upto]
                left, right = np.repeat(np.arange(row, upto), k), gather(np.arange(row, upto) + 1, k)
                row = upto
                keep = ~cross[left] | (mine[left] != mine[right])
                left, right = left[keep], right[keep]
                keep = (bands[left] == bands[right]).argmax(1) == band[left]
                left, right = left[keep], right[keep]
                same = np.zeros(len(left), np.int64)
                for t in range(STEP, HASHES + 1, STEP):
                    same += (values[left, t - STEP : t] == values[right, t - STEP : t]).sum(1)
                    keep = same >= floor[t]
                    left, right, same = left[keep], right[keep], same[keep]
                lefts.append(left)
                rights.append(right)
            left, right = np.concatenate(lefts), np.concatenate(rights)
            rows = np.unique(np.concatenate([left, right]))
            if not len(rows):
                continue
            count = np.bincount(np.searchsorted(rows, left), minlength=len(rows))
            order = np.argsort(left, kind="stable")
            first = starts[group]
            partners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array((right[order] - first[right[order]]).astype(np.int32)))
            taken = table.select([*GROUP, "rid", "size"]).take(pa.array(rows)).combine_chunks()
            columns = [taken[c].combine_chunks() for c in taken.column_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((rows - first[rows]).astype(np.int32)), partners], [*GROUP, "rid", "size", "place", "partners"])

    return members.mapInArrow(worker(run), "band int, v long, i long, j long, rid binary, size long, place int, partners array<int>")


def named(docs: DataFrame, rid_col: str = "rid") -> DataFrame:
    """``docs`` with ``rid_col`` (a new column), the name of the row's text; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                rid = [digest(t.encode()) if t else None for t in map(normalised, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rid, pa.binary())], [*part.schema.names, rid_col])

    return docs.mapInArrow(worker(run), T.StructType([*docs.schema.fields, T.StructField(rid_col, T.BinaryType())]))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted shingle sets (rid, set) of the texts in ``wanted`` (rid, low: the id of a document that has the text, or null).

    A bitmap over the first bits of rid (2 MB at any size) spares most other texts the work; the join is exact.
    """
    word = F.conv(F.substring(F.hex("rid"), 1, BITMAP_BITS // 4), 16, 10).cast("long")
    bits = wanted.select(word.alias("w")).groupBy(F.floor(F.col("w") / 32).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w % 32 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), np.int64)
    bitmap[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, nameless = held.value, set()
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                hits, names, kept, no_id = [], [], [], part.column(0).is_null().to_pylist()
                for k, t in enumerate(map(normalised, texts)):
                    rid = digest(t.encode())
                    w = int.from_bytes(rid[: BITMAP_BITS // 8], "big")
                    if t and bitmap[w >> 5] >> (w & 31) & 1:
                        if no_id[k]:  # once a task: any number of rows may have no id
                            if rid in nameless:
                                continue
                            nameless.add(rid)
                        hits.append(k)
                        names.append(rid)
                        kept.append(t)
                hashes, counts = shingles(kept)
                ends = np.cumsum(counts)
                sets = [distinct(hashes[a:b]).tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hits, pa.int64())), pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["low", "rid", "set"])

    sets, asked = docs.select("doc_id", "text").mapInArrow(worker(run), "low long, rid binary, set binary"), wanted.select(F.col("rid").alias("name"), F.col("low").alias("least"))
    return sets.join(asked, (F.col("rid") == F.col("name")) & F.col("low").eqNullSafe(F.col("least")), "left_semi").dropDuplicates(["rid"]).select("rid", "set")


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Per text and group: documents linked to it, and its parent in a forest of the group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches):
            out = [[], [], []]
            places, partners = table["place"].to_numpy(), table["partners"].to_pylist()
            names, weight = table["rid"].to_pylist(), table["size"].to_numpy()
            raw = table["set"]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                sets = [np.frombuffer(raw[k].as_py(), np.uint64).reshape(-1, 2) for k in range(a, b)]
                size = np.array([len(s) for s in sets], np.int64)
                code = codes(np.concatenate(sets))
                at = np.cumsum(size) - size
                place = {int(p): k for k, p in enumerate(places[a:b])}
                mark = np.zeros(int(code.max()) + 1, np.int64)
                links, parent = np.zeros(b - a, np.int64), list(range(b - a))

                def find(x: int, parent=parent) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for k in range(b - a):
                    other = np.array([place[p] for p in partners[a + k]], np.int64)
                    if not len(other):
                        continue
                    mark[code[at[k] : at[k] + size[k]]] = 1
                    for i in range(0, len(other), 128):
                        part = other[i : i + 128]
                        both = np.add.reduceat(mark[code[gather(at[part], size[part])]], np.cumsum(size[part]) - size[part])
                        part = part[both / (size[k] + size[part] - both) >= threshold]
                        links[k] += weight[a + part].sum()
                        links[part] += weight[a + k]
                        for p in part.tolist():
                            x, y = find(k), find(p)
                            parent[max(x, y)] = min(x, y)
                    mark[code[at[k] : at[k] + size[k]]] = 0
                for k in np.flatnonzero(links).tolist():
                    out[0].append(names[a + k])
                    out[1].append(int(links[k]))
                    out[2].append(names[a + find(k)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["rid", "links", "parent"])

    return rows.mapInArrow(worker(run), "rid binary, links long, parent binary")


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, rid: the name of the text, null without words), and texts (rid, low: least id, root, class_id, n_links)."""
    signed = materialize(_signed(docs), "jaccard-signatures")
    texts = materialize(signed.filter("rid is not null").groupBy("rid").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("low"), F.first("sig").alias("sig")), "jaccard-texts")
    bands = texts.select("rid", F.posexplode("sig").alias("band", "v"))
    shared = bands.groupBy("band", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.col("n") / 32)))
    members = bands.join(shared, ["band", "v"]).join(texts.select("rid", "size", "sig"), "rid").withColumn("mine", F.pmod(F.xxhash64("rid"), parts))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    members = members.select("band", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rid", "size", "mine", "sig")
    pairs = materialize(_compared(members.repartition(*GROUP).sortWithinPartitions(*GROUP, "rid"), threshold, tolerance), "jaccard-pairs")
    wanted = pairs.select("rid").distinct().join(texts.select("rid", "low"), "rid")
    rows = pairs.join(_sets(docs, wanted), "rid").repartition(*GROUP).sortWithinPartitions(*GROUP, "place")
    found = materialize(_verified(rows, threshold), "jaccard-links")
    discard(pairs)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("u"), F.col("parent").alias("v")))
    place = texts.select("rid", "size", "low").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = place.groupBy("root").agg(F.min("low").alias("class_id"))
    info = place.join(least, "root").join(links, "rid", "left").select("rid", "low", "root", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "rid"), info


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id (least id of the document's connected group), n_links (documents at ``threshold`` or above)."""
    rows, info = jaccard_groups(docs, threshold, tolerance)
    out = rows.join(info.drop("root", "low"), "rid", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_groups(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """``docs`` with one row of every group of linked documents: the least id's, of the texts under that id the first by name.

    Of a group without any id one row stays. Rows without words are linked to nothing and all stay.
    """
    _, texts = jaccard_groups(docs, threshold, tolerance)
    order = F.struct(F.col("low").isNull().alias("none"), "low", "rid")
    key = lambda rid, id: F.concat(F.col(rid), F.coalesce(F.col(id).cast("string"), F.lit("-")).cast("binary"))
    least = texts.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.rid").alias("rid"), F.col("m.low").alias("low")).select(key("rid", "low").alias("key"))
    name = fresh(docs, "rid")
    rows = named(docs, name)
    rows = rows.filter(F.col(name).isNotNull()).select(key(name, "doc_id").alias("key"), F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"))
    kept = rows.join(least, "key", "left_semi").dropDuplicates(["key"]).select("row.*").drop(name)
    return kept.unionByName(named(docs, name).filter(F.col(name).isNull()).drop(name)).select(*[f"`{c}`" for c in docs.columns])
