"""The language model against a plain model of order three."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.llm import katz
from tissuelake.llm.common import held_out

SF = "/root/testdata/sf0.01"


def docs(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def toks(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]


class Plain:
    """Counts of all orders in dictionaries; probabilities by the recursion as it is written."""

    def __init__(self, texts, order=3):
        self.n = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            x = toks(t)
            padded = [0] * (order - 1) + x
            for k in range(1, order + 1):
                self.n[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
        self.d = [None] + [katz.discounts(np.array([0] + [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])) for c in self.n[1:]]
        self.total, self.after = collections.defaultdict(collections.Counter), collections.defaultdict(list)
        for k in range(2, order + 1):
            for g, c in self.n[k].items():
                self.total[k][g[:-1]] += c
                self.after[g[:-1]].append(g[-1])
        self.size = sum(self.n[1].values())
        self.memo = {}

    def cut(self, k, c):
        return self.d[k][min(c, katz.K + 1)] * c

    def free(self, h):
        """What scales the words seen after h, and the mass that is left for the others."""
        k = len(h) + 1
        s = sum(self.cut(k, self.n[k][(*h, w)]) for w in self.after[h]) / self.total[k][h]
        return (self.total[k][h] / (self.total[k][h] + 1), 1 / (self.total[k][h] + 1)) if 1 - s < 1e-12 else (1, 1 - s)

    def back(self, h):
        if h not in self.memo:
            self.memo[h] = self.free(h)[1] / (1 - sum(self.p(h[1:], w) for w in self.after[h]))
        return self.memo[h]

    def p(self, h, w):
        if not h:
            c = self.n[1][(w,)]
            return self.cut(1, c) / self.size if c else 1 - sum(self.cut(1, c) for c in self.n[1].values()) / self.size
        k = len(h) + 1
        if not self.total[k][h]:
            return self.p(h[1:], w)
        c = self.n[k][(*h, w)]
        return self.free(h)[0] * self.cut(k, c) / self.total[k][h] if c else self.back(h) * self.p(h[1:], w)


def brute(rows):
    m = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 10 or i is None])
    v = len(m.n[1])
    for h in [(0, 0), (0,), *list(m.total[3])[1:2]]:
        assert abs(sum(m.p(h, w) for (w,) in m.n[1]) + m.p(h, "\0never") - 1) < 1e-9
    out = collections.defaultdict(list)
    for i, t in rows:
        x = toks(t)
        padded = [0, 0, *x]
        score = sum(math.log10(m.p((padded[k], padded[k + 1]), w)) for k, w in enumerate(x))
        out[i].append((len(x), sum(m.n[1][(w,)] > 0 for w in x), m.size, sum(math.log10((m.n[1][(w,)] + 0.1) / (m.size + 0.1 * (v + 1))) for w in x), score))
    return out


def check(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and (r.base_score, r.score) == pytest.approx(w[3:], rel=1e-9) for w in want[r.doc_id]), r


@pytest.mark.parametrize("heavy", [1 << 18, 300, 20])
def test_katz(spark, heavy):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "THE \x0b the\x1fx é É"), (None, "a null id a null id"), (None, None), rows[0], rows[0]]
    df = docs(spark, rows).withColumn("train", ~held_out("doc_id", 10, 0)).withColumns({"key": F.lit("x"), "kind": F.lit(1), "Data": F.lit(2)})
    check(katz.katz_scores(df, "train", chunk_bytes=60_000, heavy=heavy)[0].collect(), brute(rows))


def test_words_are_told_apart_by_their_bytes(spark):
    """Thue-Morse words collide under every polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, f"{a} x {a} y"), (2, f"{b} x"), (3, f"{a} z {b} {b}"), (5, f"{b} y z {a}"), *[(i, "p q r s p q") for i in range(6, 30)]]
    check(katz.lm_report(docs(spark, rows)).collect(), brute(rows))


def test_katz_without_training_text(spark):
    assert katz.lm_report(docs(spark, [])).count() == 0
    df = docs(spark, [(1, "a b")]).withColumn("train", F.lit(False))
    r = katz.katz_scores(df, "train")[0].first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_katz_discounts_where_raw_counts_fail():
    for n in ([0, 215810, 61309, 26017, 14862, 13741, 7222], [0, 1000, 300, 0, 100, 90, 0], [0, 0, 50, 0, 9, 0, 4]):
        seen = [r for r in range(1, katz.K + 2) if n[r]]
        around = [0, *seen, 2 * seen[-1] - ([0, *seen][-2])]
        z = [n[r] / (0.5 * (after - before)) for before, r, after in zip(around, seen, around[2:], strict=False)]
        b, a = np.polyfit(np.log(seen), np.log(z), 1)
        line = lambda r: math.exp(a + b * math.log(r))
        star = lambda r: (r + 1) * line(r + 1) / line(r)
        out = (katz.K + 1) * line(katz.K + 1) / line(1)
        want = [(star(r) / r - out) / (1 - out) for r in range(1, katz.K + 1)]
        assert katz.discounts(np.array(n))[1:-1] == pytest.approx(want, rel=1e-9)
        assert all(0 < d < 1 for d in want) and sorted(want) == want
    assert katz.discounts(np.array([0, 1000, 250, 100, 52, 31, 20]))[1:-1] == pytest.approx([(x - 0.12) / 0.88 for x in (0.5, 0.6, 0.52 * 4 / 3, 0.31 * 5 / 2.08, 6 * 20 / (5 * 31))])
    assert katz.discounts(np.array([0, 5, 9, 9, 9, 9, 9]))[2:].tolist() == [1.0] * katz.K and katz.discounts(np.zeros(7, int)).tolist() == [1.0] * 7
