"""Exact top-k search by distributed histogram selection.

Every query is scored against every other row of its dimension, block by block. A round lets each task count its scores
by the next eight bits of their value, among those that agree with what is known of the query's k-th score; the summed
counts tell the next eight bits. After the last round the k-th value of every query is exact. A last pass keeps the
rows at or above it, ties by the smaller id. A round is one plan over all queries; its state is a table with a row a
block of queries.

A task reports only the counts down to where its own scores alone would reach k: the k-th value cannot lie lower.

Rows without id, vector or finite components take no part; vectors of different dimensions are not compared; a
query's own id is excluded; rows that repeat an id are candidates each, and of rows with one id the least vector is the
query; fewer than k candidates are all returned. Scores are exact; one that leaves the range of 64 bits becomes that
range's end. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, worker
from .vectors import BLOCK, Partial, final, paired, pairs_of, query_blocks, row_blocks, usable, vectors_of

BITS = 8
SIZE = 1 << BITS
STEP = 2048
STATE = "block long, known binary, need binary"
PART = "query_id long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: int = 64) -> np.ndarray:
    return np.floor(vectors * scale)


def _whole(values: np.ndarray) -> np.ndarray:
    """Integers of any size from whole doubles."""
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly below 2**53, and the few that need more are taken apart."""
    large, wide = np.abs(queries).max(1, initial=0) >= 2**26, np.abs(rows).max(1, initial=0) >= 2**26
    if not (large.any() or wide.any()):
        top = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(rows).max(initial=0)) * queries.shape[1]
        return (queries @ rows.T).astype(np.int64) if top < 2**53 else queries.astype(np.int64) @ rows.astype(np.int64).T
    out = np.zeros((len(queries), len(rows)), np.int64)
    out[np.ix_(~large, ~wide)] = scores(queries[~large], rows[~wide])
    for q, r in ((large, np.ones(len(rows), bool)), (~large, wide)):
        if q.any() and r.any():
            exact = _whole(queries[q]) @ _whole(rows[r]).T
            out[np.ix_(q, r)] = np.clip(exact, LOW, HIGH).astype(np.int64)
    return out


def _scored(pair: dict, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of rows, scores (query x row) and the mask of each query's own rows."""
    names, ids = np.frombuffer(pair["names"], np.int64), np.frombuffer(pair["ids"], np.int64)
    matrix, rows = quantised(vectors_of(pair["queries"], pair["dim"]), scale), quantised(vectors_of(pair["vectors"], pair["dim"]), scale)
    for i in range(0, len(ids), STEP):
        part = ids[i : i + STEP]
        at = np.minimum(np.searchsorted(names, part), len(names) - 1)
        col = np.flatnonzero(names[at] == part)
        own = np.zeros((len(names), len(part)), bool)
        own[at[col], col] = True
        yield part, scores(matrix, rows[i : i + STEP]), own


def _key(score: np.ndarray, offset: int) -> np.ndarray:
    """Scores as unsigned numbers in the same order."""
    return score.view(np.uint64) + np.uint64(offset)


def _inside(tally: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many scores have a larger digit, and the digits that can hold the k-th score."""
    above = tally[:, ::-1].cumsum(1)[:, ::-1] - tally
    return above, (tally > 0) & (above < need[:, None])


def _round(queries: DataFrame, state: DataFrame, rows: DataFrame, shift: int, first: bool, offset: int, scale: int) -> DataFrame:
    """The state after eight more bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out(block: int) -> pa.RecordBatch:
            tally, need = held.pop(block)
            q, digit = np.nonzero(_inside(tally, need)[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q), pa.array(digit), pa.array(tally[q, digit])], ["block", "q", "digit", "n"])

        for batch in batches:
            for pair in pairs_of(batch):
                known, need = (np.frombuffer(pair[c], t) for c, t in (("known", np.uint64), ("need", np.int64)))
                tally = held.pop(pair["block"], (np.zeros((len(need), SIZE), np.int64),))[0]
                lines = np.arange(len(need))[:, None] * SIZE
                for _, score, own in _scored(pair, scale):
                    key = _key(score, offset)
                    use = ~own if first else ~own & (key >> np.uint64(shift + BITS) == known[:, None])
                    tally += np.bincount((lines + (key >> np.uint64(shift) & np.uint64(SIZE - 1)).astype(np.int64))[use], minlength=tally.size).reshape(tally.shape)
                held[pair["block"]] = (tally, need)
                if len(held) > 8:
                    yield out(next(iter(held)))
        for block in list(held):
            yield out(block)

    seen = paired(queries.join(state, "block"), rows).mapInArrow(worker(count), "block long, q long, digit long, n long")
    summed = seen.groupBy("block", "q", "digit").agg(F.sum("n").alias("n"))  # 256 rows a query at most

    def narrow(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known, need = np.frombuffer(left["known"].iloc[0], np.uint64), np.frombuffer(left["need"].iloc[0], np.int64)
        tally = np.zeros((len(need), SIZE), np.int64)
        tally[right["q"].to_numpy(np.int64), right["digit"].to_numpy(np.int64)] = right["n"].to_numpy(np.int64)
        above, inside = _inside(tally, need)
        digit = np.where(inside.any(1), inside.argmax(1), 0)
        known = known << np.uint64(BITS) | digit.astype(np.uint64)
        return pd.DataFrame({"block": [key[0]], "known": [known.tobytes()], "need": [(need - above[np.arange(len(need)), digit]).tobytes()]})

    return materialize(state.groupBy("block").cogroup(summed.groupBy("block")).applyInPandas(narrow, STATE), "topk-state")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query (ids divisible by ``every``)."""
    rows = usable(embeddings)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * scale + 1, 2))
    reach = rows.agg(F.max(norm)).first()[0]
    if reach is None:
        return final(embeddings.sparkSession.createDataFrame([], PART), k)
    fits = reach < 2.0**62
    offset = int(reach) + 1 if fits else 1 << 63
    shift = -(-(2 * offset).bit_length() // BITS) * BITS if fits else 64
    queries, packed = query_blocks(rows, every, block), materialize(row_blocks(rows), "topk-rows")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(x.as_buffer()) // 8 for x in batch["names"]]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array([np.zeros(n, np.uint64).tobytes() for n in size], pa.binary()), pa.array([np.full(n, k, np.int64).tobytes() for n in size], pa.binary())], ["block", "known", "need"])

    state = materialize(queries.mapInArrow(worker(begin), STATE), "topk-state")
    for down in range(shift - BITS, -1, -BITS):
        old, state = state, _round(queries, state, packed, down, down == shift - BITS, offset, scale)
        discard(old)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Partial(k, pa.int64())
        for batch in batches:
            for pair in pairs_of(batch):
                least = np.frombuffer(pair["known"], np.uint64)
                for ids, score, own in _scored(pair, scale):
                    q, col = np.nonzero((_key(score, offset) >= least[:, None]) & ~own)
                    yield from kept.add(pair["block"], np.frombuffer(pair["names"], np.int64), q, score[q, col], ids[col])
        yield from kept.rest()

    return final(paired(queries.join(state, "block"), packed).mapInArrow(worker(select), PART), k)
