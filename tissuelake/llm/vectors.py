"""What the two vector searches share: valid rows, blocks of rows and of queries, their pairs, and partial top-k lists.

Vectors are packed into blocks of one dimension. A block of queries meets every block of rows once, as a row that holds
both; blocks are the only things paired, queries are a table like any other, and one plan covers all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, worker

#: Queries and rows of a block.
BLOCK, ROWS = 4096, 8192
QUERIES = "block long, dim int, names binary, queries binary"
CANDIDATES = "dim int, ids binary, vectors binary"


def usable(df: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and embedding of rows that can take part: an id, a vector, and finite components only."""
    fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    df = df.select("vec_id", "embedding").filter(fine)
    return df.filter("exists(embedding, x -> x <> 0)") if nonzero else df


def vectors_of(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dim)


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length of vectors: the length, the rows that have it, and their matrix."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield dim, rows, flat.reshape(len(rows), dim)


def row_blocks(df: DataFrame, extra: Callable[[int, np.ndarray], bytes] | None = None) -> DataFrame:
    """Rows packed as they are read; ``extra(dim, vectors)`` makes one more column, ``codes``."""
    names = ["dim", "ids", "vectors"] + (["codes"] if extra else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            made = [dim, ids.tobytes(), vectors.tobytes()] + ([extra(dim, vectors)] if extra else [])
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names)  # noqa: B905

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim, rows, vectors in _by_dimension(batch.column(1)):
                for i in range(0, len(rows), ROWS):
                    held.setdefault(dim, []).append((ids[rows[i : i + ROWS]], vectors[i : i + ROWS]))
                    if sum(len(x) for x, _ in held[dim]) >= ROWS:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return df.select("vec_id", "embedding").mapInArrow(worker(run), CANDIDATES + (", codes binary" if extra else ""))


def query_blocks(df: DataFrame, every: int, block: int = BLOCK) -> DataFrame:
    """Queries (ids divisible by ``every``; of rows with one id, the least vector) as a table of blocks of about ``block``."""
    queries = df.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    parts = max(1, -(-queries.count() // block))
    dealt = queries.groupBy(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"))
    rows = dealt.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))  # about ``block`` rows a group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, part, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values
                names = held.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = held.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | dim]), pa.array([dim], pa.int32()), pa.array([names.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["block", "dim", "names", "queries"])

    return materialize(rows.mapInArrow(worker(run), QUERIES), "query-blocks")


def paired(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of queries with every block of rows (of any dimension: see ``same``)."""
    return queries.crossJoin(rows.withColumnRenamed("dim", "row_dim"))


def pairs_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The pairs of a batch whose dimensions agree, one at a time."""
    for i in range(batch.num_rows):
        if batch["dim"][i].as_py() == batch["row_dim"][i].as_py():
            yield {n: batch[n][i].as_py() for n in batch.schema.names}


class Partial:
    """A task's best rows of every query, by block of queries; blocks leave when there are many."""

    def __init__(self, k: int, kind: pa.DataType, blocks: int = 64):
        self.k, self.kind, self.blocks, self.held = k, kind, blocks, {}

    def add(self, block: int, names: np.ndarray, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = self.held.pop(block, None)
        new = (q, score, ids)
        if kept:
            new = tuple(np.concatenate(x) for x in zip(kept[1], new, strict=True))
        take = best(*new, self.k)
        self.held[block] = (names, tuple(x[take] for x in new))
        if len(self.held) > self.blocks:
            yield self._out(next(iter(self.held)))

    def _out(self, block: int) -> pa.RecordBatch:
        names, (q, score, ids) = self.held.pop(block)
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids), pa.array(score, self.kind)], ["query_id", "vec_id", "score"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for block in list(self.held):
            yield self._out(block)


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def final(parts: DataFrame, k: int) -> DataFrame:
    """The k best of every query from the tasks' partial lists (query_id, vec_id, score)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
