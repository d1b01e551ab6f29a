"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.llm import ann, bpe, jaccard, langid, packing, pii, quality, topk

SF = "/root/testdata/sf0.01"
EMPTY = "doc_id long, text string"


def docs(spark, rows, parts=4):
    return spark.createDataFrame(rows, EMPTY).repartition(parts)


# -- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


def valid(kind, v):
    n = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in v.split("."))
    return {"email": True, "card": 16 <= len(n) <= 19 and luhn(n or "1"), "phone": 8 <= len(n) <= 15}[kind]


def test_pii_matches_the_plain_patterns(spark):
    random.seed(3)
    marks = list("ab1123456.@+-_() %é😀") + ["4041894974608795", "+1 (988) 555-2485", "10.0.0.1", "a@b.co", "300.1.1.1"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["x " * 2000 + "a@b.cc " * 1500, "1" * 20000 + ".1.1.1", "a" * 50000 + "@", "a@b" + ".c" * 30000, None, ""]
    got = {r.doc_id: r for r in pii.pii_report(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m.group()))
        assert ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in BASE) == want
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "call (269) 555-3296 GB82 WEST 1234 5698 7654 32 x"), (2, "+1 (269) 555-3296 4524132264652876"), (3, "plain 269 555 3296"), (4, None)]
    df = docs(spark, rows)
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert got == {1: "phone_local:5:19,iban:20:47", 2: "phone_local:0:17,card_run:18:34", 3: "", 4: ""}
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red == {1: "call [PHONE_LOCAL] [IBAN] x", 2: "[PHONE_LOCAL] [CARD_RUN]", 3: rows[2][1], 4: None}
    assert pii.pii_report(df.limit(0)).count() == 0


def test_pii_iban_before_short_words(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68539007547034"]
    tails = ["", ", x", " BIC x", " AND", " 12 x", " BANK CODE 1", " A", " BIC", " " + ibans[0]]
    rows = [(i * 100 + j, f"to {v}{t}") for i, v in enumerate(ibans) for j, t in enumerate(tails)]
    got = {r.doc_id: r.spans for r in pii.pii_report(docs(spark, rows)).collect()}
    for i, v in enumerate(ibans):
        for j, t in enumerate(tails):
            spans = [x for x in got[i * 100 + j].split(",") if x.startswith("iban")]
            end = 3 + len(v)
            assert spans == [f"iban:3:{end}", *([f"iban:{end + 1}:{end + 1 + len(ibans[0])}"] if t.endswith(ibans[0]) else [])]
    red = pii.redact(docs(spark, [(1, "AT61 1904 3002 3457 3201 AND"), (2, "AT61 1904 3002 3457 3202 AND")])).collect()
    assert {r.text for r in red} == {"[IBAN] AND", "AT61 1904 3002 3457 3202 AND"}


# -- byte-level BPE and packing


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    enc = bpe.Encoder(bpe.default_ranks(), max_cache=3000)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    random.seed(1)
    marks = list("abcde'stmdrevl  \n\t12.!é你😀  ") + ["'s", "'re", "'ll", ' "', " the", " hello", "==", "\r\n", "\x1c", "\x85"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 40))) for _ in range(8000)]
    texts += ["", None, "a" * 5000, "ab" * 3000, "=-" * 4000, "你好" * 900, "word " * 300_000]
    ids, counts = enc.encode_batch(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == ref.encode_ordinary(t or "")
        assert enc.decode(ids[a:b]) == (t or "").encode()
    back = bpe.decode(bpe.encode(docs(spark, [(1, "Héllo wörld's"), (2, None)]))).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {1: "Héllo wörld's".encode(), 2: b""}


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()] + [(10**6, None), (10**6 + 1, ""), (None, "a b")]
    p = packing.pack_documents(docs(spark, rows)).toPandas()
    lengths = p.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and (lengths == 2048).mean() > 0.75  # each of four tasks may end in up to 11 short ones
    s = p.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for doc_id, text in rows:
        mine = p[p.doc_id.isna() if doc_id is None else p.doc_id == doc_id].sort_values("start")
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in mine.itertuples()] == [0, *np.cumsum(mine.length)[:-1]]
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


# -- vectors


def vectors(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[n // 2 :: 3] = x[0]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)


def nearest(x, k):
    out = set()
    for i in range(0, len(x), 20):
        s = (x * x[i]).sum(1)
        other = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:k]
        out |= {(i, r + 1, int(j)) for r, j in enumerate(other)}
    return out


def test_exact_top_k(spark):
    x, df = vectors(spark)
    got = {(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df, block=7).collect()}
    assert got == nearest(np.floor(x.astype(float) * 64), 20)


def test_approximate_recall(spark):
    x, df = vectors(spark)
    got = {(r.query_id, r.vec_id) for r in ann.search(ann.build_index(df)).collect()}
    want = {(q, v) for q, _, v in nearest(x.astype(float), 20)}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("search", [topk.top_k, lambda df: ann.search(ann.build_index(df))])
def test_vector_edges(spark, search):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 2.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (40, [3.0, -1.0]), (42, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in search(df).collect()) == [(0, 1, 40), (40, 1, 0), (40, 2, 0)]
    assert search(df.limit(0)).count() == 0


# -- near duplicates


def brute_classes(rows):
    sets, inv = [], collections.defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            inv[s].add(k)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for m, b in collections.Counter(m for g in s for m in inv[g] if m > k).items():
            if b / (len(s) + len(sets[m]) - b) >= 0.8:
                links[k] += 1
                links[m] += 1
                x, y = find(k), find(m)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), 10**18), rows[k][0])
    return sorted((rows[k][0], low[find(k)], links[k]) for k in range(len(rows)))


@pytest.mark.parametrize("block", [512, 40])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    random.seed(1)
    words = [f"w{i}" for i in range(300)]
    core = [random.choice(words) for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    for i in range(200):
        c = list(core)
        for _ in range(random.randint(0, 3)):
            c[random.randrange(150)] = random.choice(words)
        rows.append((100000 + i, " ".join(c)))
    rows += [(200000, None), (200001, ""), (200002, "a b"), (200003, "A  b\n")]
    assert sorted(map(tuple, jaccard.jaccard_classes(docs(spark, rows)).collect())) == brute_classes(rows)


def test_jaccard_edges(spark):
    got = jaccard.jaccard_classes(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 2), (3, 3, 2), (3, 3, 2), (None, None, 0)], key=str)
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0


def test_jaccard_links_rows_without_ids(spark):
    import corpus_pipeline as c

    near = " ".join(f"w{i}" for i in range(60))
    lone = " ".join(f"v{i}" for i in range(60))
    rows = [(7, near + " x"), *[(None, near + " y")] * 3, *[(None, lone + " x")] * 3, *[(None, lone + " y")] * 2, (None, None), (None, "")]
    got = sorted(map(tuple, jaccard.jaccard_classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 7, 3), *[(None, 7, 3)] * 3, *[(None, None, 4)] * 5, (None, None, 0), (None, None, 0)], key=str)
    kept = [tuple(r) for r in c.near_duplicates(spark, docs(spark, rows), SF).collect()]
    assert len(kept) == 4 and {(7, near + " x"), (None, None), (None, "")} < set(kept)
    assert sum((t or "").startswith(lone) for _, t in kept) == 1


# -- classifiers


def test_language_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.language_report(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    edge = spark.createDataFrame([(1, None, "en"), (2, "12 !", None), (None, "x", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_report(edge).collect()} == {"und"}


def test_quality_accuracy(spark):
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_report(df, labels).join(labels, "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    edge = quality.quality_report(docs(spark, [(1, None), (2, ""), (None, "x")]), labels.limit(0)).collect()
    assert [r.score for r in edge] == [0.5] * 3


def test_quality_learns_from_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, counts, y: seen.append((x, counts)) or self)
    texts = ["a" * (512 * 60) + "!" * 512 + "a" * (512 * 40 + 7), "b", None] + ["c" * 5000] * 97
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality long")
    quality.fit_quality(docs(spark, list(enumerate(texts))), labels)
    x, counts = seen[0]
    want, n = quality.passages(texts)
    assert sorted(counts) == sorted(n) and sorted(map(bytes, x)) == sorted(map(bytes, want))
    quality.fit_quality(docs(spark, list(enumerate(texts))), labels, max_passages=500)
    x, counts = seen[1]
    assert 0 < len(x) < 800 and set(counts) <= set(n)


def test_gradient_of_attention_model():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 5, 300)
    y = rng.integers(0, 2, 300).astype(float)
    x = rng.normal(size=(int(counts.sum()), 6)).astype(np.float32)
    x[np.cumsum(counts) - counts, 0] += 6 * y  # one passage of each bag tells the label
    model = quality.Model().fit(x, counts, y, epochs=80)
    assert ((model.score(x, counts) > 0.5) == y).mean() > 0.95


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    rows = [(1, "call me at a@b.co", "en", "s", 17), (2, "call me at a@b.co", "en", "s", 17), (3, None, None, None, None), (None, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in c.near_duplicates(spark, df, SF).collect()), key=str) == [1, 3, None]
    assert {r.text for r in c.personal_data(spark, df, SF).collect()} == {"call me at [EMAIL]", None, "x"}
    assert c.language(spark, df, SF).columns == df.columns
    out = c.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and set(out.doc_id) < {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_pipeline_language_cut(spark):
    import corpus_pipeline as c

    random.seed(4)
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null and lang is not null")
    foreign = [
        "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
        " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9))) for _ in range(300)),
        " ".join("".join(random.choice("asdfjkl") for _ in range(random.randint(2, 9))) for _ in range(300)),
    ]
    bad = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(foreign)], df.schema)
    clean = {r.doc_id for r in df.select("doc_id").collect()}
    assert {r.doc_id for r in c.language(spark, df.unionByName(bad), SF).select("doc_id").collect()} == clean
