"""Language identification by rank-order profiles.

A profile is a language's ``size`` most frequent n-grams (one to three characters, inside words, with word edges) in
order. A document's own most frequent n-grams are compared with every profile by the out-of-place distance: the
difference of the ranks, or the greatest possible one for an n-gram that the profile lacks. The nearest language wins,
ties by name; the score is one minus the distance as a share of the greatest distance.

Profiles are fitted on about ``per_lang`` labelled documents of each language (chosen by a hash of the id; whole texts).
Rows without text or lang teach nothing; without any labelled row every document is ``und`` with score 0, as is a text
that is null or has no letter. Repeated rows and null ids are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rate, held_out, sampled, without, worker

UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams: 21 bits a character, the length kept by an offset of the first one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]])
    points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    two = (points[:-1] + 1) << 21 | points[1:]
    three = ((points[:-2] + 1) << 42 | points[1:-1] << 21 | points[2:])[points[1:-1] != 0]
    return np.concatenate([points[points != 0], two, three])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order, ties by code; codes is sorted."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(train: DataFrame, per_lang: int = 2000, size: int = 400) -> dict[str, list[int]]:
    """Profiles of the languages in ``train`` (doc_id, text, lang)."""
    train = train.filter("text is not null and lang is not null")
    seen = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return {}
    rates = F.create_map(*[F.lit(x) for k, n in sorted(seen.items()) for x in (k, bounded_rate(n, per_lang))])
    rows = train.filter(sampled("doc_id", rates[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(np.unique(ngrams(text), return_counts=True))
            for lang, found in held.items():
                codes, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = rows.select("text", "lang").mapInArrow(worker(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():  # size rows a language
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Model:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ngrams(text) if text and self.langs else ()
        if not len(codes):
            return UNKNOWN, 0.0
        own = ranked(*np.unique(codes, return_counts=True), self.size)
        at = np.searchsorted(self.codes, own)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == own, at, len(self.codes))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        k = int(away.argmin())
        return self.langs[k], float(1 - away[k] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with ``lang_col`` and ``score_col``, in place of columns that are called so."""
    docs = without(docs, lang_col, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(profiles, size)
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [*batch.schema.names, lang_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(worker(run), schema)


def language_report(docs: DataFrame, per_lang: int = 2000, size: int = 400) -> DataFrame:
    """The digest of op1: learns from documents whose remainder is not 2, predicts all."""
    profiles = fit_profiles(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"), per_lang, size)
    out = predict(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), profiles, size)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
