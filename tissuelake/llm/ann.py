"""Approximate nearest neighbours by inner product: score-aware (anisotropic) product quantisation.

Sub-vectors of two components get 4-bit codes. The codebooks and the codes minimise a loss in which the part of the
residual that is parallel to the vector weighs ``eta`` times the rest, since it is the part that shifts large inner
products. Codebooks are fitted on about ``sample`` rows (chosen by a hash of the id); every row is indexed.

A search scans the codes of all rows: a query's inner products with the centroids form tables, two codes share one
byte and one table of 256 entries, and a row's estimate is the sum of its table entries. Of every block of ``ROWS``
rows the ``rerank`` best estimates among distinct vectors, and all others that the estimates' usual error (root mean
square on the sample) leaves level with them, get the exact inner product in double precision. So a crowd of almost
equal vectors, whose codes are the same, is reranked whole.

Rows without id, vector or finite components, and zero vectors, take no part; every dimension has codebooks of its own
and vectors of different dimensions are not compared. Equal vectors stand for one another: ties go to smaller ids. A
query's own id is excluded; of rows with one id the least vector is the query; fewer than k candidates are all returned
when ``rerank`` >= k. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rate, materialize, sampled, worker
from .vectors import BLOCK, Partial, final, paired, pairs_of, query_blocks, row_blocks, usable, vectors_of

PART = "query_id long, vec_id long, score double"


class Codebooks:
    """Centroids of every sub-space: array (sub-spaces, 16, 2); an odd number of sub-spaces is padded."""

    def __init__(self, dim: int, eta: float = 4.0):
        self.dim, self.eta = dim, eta
        self.subs = -(-dim // 4) * 2
        self.centroids = np.zeros((self.subs, 16, 2))
        self.noise = 0.0

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.pad(x, ((0, 0), (0, 2 * self.subs - self.dim)))
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return x.reshape(len(x), self.subs, 2), unit.reshape(len(x), self.subs, 2)

    def _assign(self, x: np.ndarray, unit: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and each sub-space's part of the residual along the vector."""
        n = np.arange(len(x))
        near = np.stack([((x[:, m, None] - self.centroids[m]) ** 2).sum(2).argmin(1) for m in range(self.subs)], 1)
        along = np.stack([((x[:, m] - self.centroids[m][near[:, m]]) * unit[:, m]).sum(1) for m in range(self.subs)], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.subs):
                rest = total - along[:, m]
                diff = x[:, m, None] - self.centroids[m]
                par = (diff * unit[:, m, None]).sum(2)
                code = ((diff**2).sum(2) + (self.eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
                near[:, m], along[:, m] = code, par[n, code]
                total = rest + along[:, m]
        return near, along

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 5) -> Codebooks:
        if not len(x):
            return self
        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)  # copies of one vector would take centroids from the others
        x, unit = self._split(x)
        for m in range(self.subs):
            self.centroids[m] = x[rng.integers(0, len(x), 16), m]
        for _ in range(rounds):
            near, along = self._assign(x, unit, 1)
            total = along.sum(1)
            for m in range(self.subs):
                target = total - along[:, m] + (x[:, m] * unit[:, m]).sum(1)
                for c in range(16):
                    rows = near[:, m] == c
                    if rows.any():
                        u = unit[rows, m]
                        left = rows.sum() * np.eye(2) + (self.eta - 1) * u.T @ u
                        self.centroids[m, c] = np.linalg.solve(left, x[rows, m].sum(0) + (self.eta - 1) * target[rows] @ u)
                    else:
                        self.centroids[m, c] = x[rng.integers(len(x)), m]
                new = ((x[:, m] - self.centroids[m][near[:, m]]) * unit[:, m]).sum(1)
                total, along[:, m] = total - along[:, m] + new, new
        near, _ = self._assign(x, unit, 1)
        left = np.stack([x[:, m] - self.centroids[m][near[:, m]] for m in range(self.subs)], 1)
        self.noise = float(np.sqrt((left**2).sum() / len(x) / self.dim))
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Two 4-bit codes a byte."""
        near, _ = self._assign(*self._split(x), sweeps)
        return (near[:, ::2] << 4 | near[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Per query and code byte, the 256 sums of two centroids' inner products with the query."""
        q = np.pad(queries, ((0, 0), (0, 2 * self.subs - self.dim))).reshape(len(queries), self.subs, 2)
        part = np.einsum("qmd,mcd->qmc", q, self.centroids)
        return (part[:, ::2, :, None] + part[:, 1::2, None, :]).reshape(len(queries), self.subs // 2, 256).astype(np.float32)


@dataclass
class Index:
    """Usable rows, their packed blocks with codes, and the codebooks of every dimension."""

    rows: DataFrame
    blocks: DataFrame
    books: dict[int, Codebooks]


def build_index(embeddings: DataFrame, sample: int = 8192, eta: float = 4.0) -> Index:
    """Codebooks from about ``sample`` rows of each dimension, and the codes of all usable rows."""
    rows = usable(embeddings, nonzero=True)
    found = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dimension
    books = {}
    for dim, n in sorted(found.items()):
        got = rows.filter((F.size("embedding") == dim) & sampled("vec_id", bounded_rate(n, sample))).orderBy("vec_id").toArrow().combine_chunks()  # about `sample` rows
        flat = got["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        books[dim] = Codebooks(dim, eta).fit(flat.reshape(-1, dim))
    return Index(rows, materialize(row_blocks(rows, lambda dim, vectors: books[dim].encode(vectors).tobytes()), "ann-index"), books)


def _scan(ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, queries: tuple[np.ndarray, np.ndarray], books: Codebooks, k: int, rerank: int) -> list[np.ndarray]:
    """Of one block: query numbers, exact scores, ids."""
    order = np.argsort(ids, kind="stable")
    ids, rows, codes = ids[order], rows[order], codes[order]
    kinds = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    _, first, back = np.unique(kinds, return_index=True, return_inverse=True)
    members = np.argsort(back, kind="stable")  # of each distinct vector, by id
    size = np.bincount(back)
    at = np.cumsum(size) - size
    distinct = rows[first]
    where = codes[first].T.astype(np.intp) + 256 * np.arange(codes.shape[1])[:, None]
    names, matrix = queries
    out = []
    for i in range(0, len(names), 256):
        for j, table in enumerate(books.tables(matrix[i : i + 256]), i):
            guess = table.ravel().take(where).sum(0)
            cut = np.partition(guess, -rerank)[-rerank] if len(guess) > rerank else -np.inf
            take = np.flatnonzero(guess >= cut - books.noise * np.linalg.norm(matrix[j]))
            exact = (distinct[take] * matrix[j]).sum(1)  # one order of summation, so equal vectors tie exactly
            n = np.minimum(size[take], k + 1)
            got = members[np.repeat(at[take], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            score, found = np.repeat(exact, n), ids[got]
            keep = found != names[j]
            score, found = score[keep], found[keep]
            if len(found) > k:
                keep = np.lexsort((found, -score))[:k]
                score, found = score[keep], found[keep]
            out.append((np.full(len(found), j), score, found))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(index: Index, k: int = 20, every: int = 20, rerank: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (ids divisible by ``every``)."""
    spark = index.rows.sparkSession
    if not index.books:
        return final(spark.createDataFrame([], PART), k)
    books = index.books

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Partial(k, pa.float64())
        for batch in batches:
            for pair in pairs_of(batch):
                ids, dim = np.frombuffer(pair["ids"], np.int64), pair["dim"]
                names = np.frombuffer(pair["names"], np.int64)
                codes = np.frombuffer(pair["codes"], np.uint8).reshape(len(ids), -1)
                q, score, found = _scan(ids, vectors_of(pair["vectors"], dim), codes, (names, vectors_of(pair["queries"], dim)), books[dim], k, rerank)
                yield from kept.add(pair["block"], names, q, score, found)
        yield from kept.rest()

    return final(paired(query_blocks(index.rows, every, block), index.blocks).mapInArrow(worker(scan), PART), k)
