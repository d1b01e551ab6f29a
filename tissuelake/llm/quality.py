"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` characters. Each passage is encoded from shares of character classes,
word lengths, how many of its words are distinct, and hashed character pairs, through a learned tanh layer. Gated
attention (a tanh branch times a sigmoid branch) weights the passages; the weighted sum of their codes is scored by a
logistic unit. All weights are learned together from document labels by gradient descent.

Training takes about ``max_docs`` labelled documents (chosen by a hash of the id), fewer rows (chosen by a hash of id
and text) if an id stands on many or if they have more than ``max_passages`` passages together, and every passage of
each; scoring reads every passage of every text. Null texts count as empty: one passage of zeros. Equal texts under one id and label teach once. Words of a passage count as equal if their 64-bit
hashes are, which moves one feature, never an identity.
Labels other than 0 and 1 teach nothing; of contradicting labels of an id the lowest counts. With no label, or labels of
one kind only, every score is the share of label 1 (0.5 without any). Repeated rows are scored row by row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _point_values, _powers, mix64, text_slices
from .common import bounded_rate, held_out, sampled, without, worker

PASSAGE = 512
PAIRS = 64
KINDS = 8
WIDTH = KINDS + 6 + PAIRS


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Class of every code point: other, lower, upper, digit, blank, line end, stop or comma, other sign."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        table[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c in "\r\n" else 4 if c.isspace() else 6 if c in ".,;:" else 7 if i < 0x2100 and not c.isalnum() else 0
    return table


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order (at least one a text), and how many each text has."""
    texts = [t or "" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(counts.sum()), WIDTH), np.float32)
    n = int(sizes.sum())
    if not n:
        return out, counts
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    row = (np.cumsum(counts) - counts)[doc] + (np.arange(n) - first[doc]) // PASSAGE
    kind = _kinds()[points]
    tally = np.bincount(row * KINDS + kind, minlength=len(out) * KINDS).reshape(-1, KINDS).astype(np.float32)
    size = np.maximum(tally.sum(1, keepdims=True), 1)
    out[:, :KINDS] = tally / size
    space = (kind == 4) | (kind == 5)
    edge = np.append(True, row[1:] != row[:-1])
    begin = np.flatnonzero(~space & (np.append(True, space[:-1]) | edge))
    if len(begin):
        stop = np.flatnonzero(~space & np.append(space[1:] | edge[1:], True)) + 1
        power, inverse = _powers(n)
        total = np.append(np.uint64(0), np.cumsum(_point_values()[points] * power))
        word = (total[stop] - total[begin]) * inverse[begin]
        own = row[begin]
        words = np.bincount(own, minlength=len(out)).astype(np.float32)
        distinct = np.unique(mix64(word ^ mix64(own.astype(np.uint64))), return_index=True)[1]
        span = (stop - begin).astype(np.float64)
        out[:, KINDS] = np.bincount(own[distinct], minlength=len(out)) / np.maximum(words, 1)
        out[:, KINDS + 1] = np.bincount(own, span, len(out)) / np.maximum(words, 1) / 10
        out[:, KINDS + 2] = np.sqrt(np.bincount(own, span * span, len(out)) / np.maximum(words, 1)) / 10
        signs = np.bincount(own, kind[stop - 1] >= 6, len(out))
        out[:, KINDS + 3] = signs / np.maximum(words, 1)
        out[:, KINDS + 4] = np.bincount(own, kind[begin] == 2, len(out)) / np.maximum(words, 1)
    out[:, KINDS + 5] = np.log1p(size[:, 0]) / 8
    pair = (mix64(points[:-1].astype(np.uint64) << np.uint64(32) | points[1:].astype(np.uint64)) >> np.uint64(58)).astype(np.int64)
    same = row[:-1] == row[1:]
    hashed = np.bincount(row[:-1][same] * PAIRS + pair[same], minlength=len(out) * PAIRS).reshape(-1, PAIRS)
    out[:, KINDS + 6 :] = hashed / size * 8
    return out, counts


class Model:
    """Weights as plain arrays; ``share`` is what an unlearned model answers."""

    def __init__(self, share: float = 0.5):
        self.share, self.weights = share, None

    def _forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, w: dict) -> dict:
        h = np.tanh((x - w["mean"]) / w["std"] @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "bag": bag, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def _gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, w: dict) -> dict:
        """Of the mean cross-entropy, by each learned array."""
        starts = np.cumsum(counts) - counts
        f, xs = self._forward(x, starts, counts, w), (x - w["mean"]) / w["std"]
        out = (f["p"] - y) / len(y)
        dz = out[:, None] * w["c"]
        dh = f["att"][:, None] * dz[f["bag"]]
        da = (dz[f["bag"]] * f["h"]).sum(1)
        de = f["att"] * (da - np.add.reduceat(f["att"] * da, starts)[f["bag"]])
        dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": xs.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
        self.share = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return self
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        w = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "W": rng.normal(0, 0.15, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
        learn = [k for k in w if k not in ("mean", "std")]
        m, v, step = {k: 0.0 for k in learn}, {k: 0.0 for k in learn}, 0
        starts = np.cumsum(counts) - counts
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                n = counts[pick]
                at = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[pick], n, strict=True)])
                grad = self._gradient(x[at], n, y[pick], w)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k in learn:
                    g = grad[k] + decay * w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = {k: a.astype(np.float64) for k, a in w.items()}
        return self

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), self.share)
        return np.round(self._forward(x, np.cumsum(counts) - counts, counts, self.weights)["p"], 12)  # sums over a batch end differently in the last digits


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_passages: int = 200_000, **options) -> Model:
    """Learn from ``labels`` (doc_id, quality) and the texts of ``docs``."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taken = known.filter(sampled("doc_id", bounded_rate(known.count(), max_docs)))  # about max_docs rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    each = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / PASSAGE))
    seen = rows.select("doc_id", F.xxhash64("text").alias("t"), each.alias("n")).distinct().agg(F.count(F.lit(1)), F.sum("n")).first()
    rate = min(bounded_rate(seen[0], max_docs), bounded_rate(seen[1] or 0, max_passages))
    if rate < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("row"), "doc_id", "text"), F.lit(1 << 30)) < rate * (1 << 30))
    rows = rows.dropDuplicates(["doc_id", "text"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                x, counts = passages(texts)
                ends = np.cumsum(counts)
                made = [x[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(made, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(worker(features), f"doc_id long, quality {labels.schema['quality'].dataType.simpleString()}, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, WIDTH) for r in got]
    y = np.array([r["quality"] for r in got], np.float64)
    return Model().fit(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), np.array([len(b) for b in bags], np.int64), y, **options)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``score_col``, in place of a column that is called so."""
    docs = without(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(*passages(texts)), pa.float64())], [*part.schema.names, score_col])

    return docs.mapInArrow(worker(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The digest of op5: learns from ids whose remainder is not 2, scores all documents."""
    model = fit_quality(docs, labels.filter(~held_out("doc_id", 4, 2)), **options)
    out = score_quality(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), model)
    score = F.col("quality_score")
    return out.select("doc_id", "held_out", score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
