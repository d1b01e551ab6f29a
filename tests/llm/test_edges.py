"""Each operator on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; plain versions."""

import collections
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.llm import bpe, jaccard, langid, packing, pii, quality

SF = "/root/testdata/sf0.01"


def docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


ODD = [(1, None), (2, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (4, "x" * 300_000), (5, "word " * 40_000)]


def test_empty_tables_give_no_rows(spark):
    none = docs(spark, [])
    for made in (bpe.token_report(none), packing.pack_documents(none), pii.pii_report(none), jaccard.jaccard_classes(none), bpe.decode(bpe.encode(none)), pii.redact(none), jaccard.first_of_groups(none)):
        assert made.count() == 0
    assert langid.language_report(none.withColumn("lang", F.lit("en"))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality long")
    assert quality.quality_report(none, labels).count() == 0


def test_columns_of_the_same_name(spark):
    taken = {"ids": F.lit("mine"), "Decoded": F.lit(1), "lang_pred": F.lit(2), "LANG_SCORE": F.lit(3), "quality_score": F.lit(4), "pii": F.lit(5), "__pii": F.lit(6), "__pii_text": F.lit(7), "rid": F.lit(8), "key": F.lit(9), "row": F.lit(10), "low": F.lit(11)}
    df = docs(spark, ODD[:5]).withColumns(taken)
    names = df.columns
    made = bpe.decode(bpe.encode(df))
    assert sorted(c.lower() for c in made.columns) == sorted(c.lower() for c in names)
    assert {bytes(r.decoded).decode() for r in made.collect()} == {"", "the cat"}
    lang = langid.predict(df, {"en": [1]})
    assert len(lang.columns) == len(names) and lang.count() == 5
    score = quality.score_quality(df, quality.Model(0.25))
    assert {r.quality_score for r in score.collect()} == {0.25}
    assert pii.redact(df).columns == names and {r.pii for r in pii.redact(df).collect()} == {5}
    assert pii.find_pii(df).schema["pii"].dataType.typeName() == "array"
    kept = jaccard.first_of_groups(df)
    assert kept.columns == names and sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3]


def test_bpe_tells_pieces_apart(spark):
    """Thue-Morse strings collide under polynomial hashes modulo 2**64."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in (10, 11, 12):
        pair = thue_morse(n)
        for batch in ([*pair], [*reversed(pair)], [pair[0] + " " + pair[1]]):
            one, each = bpe.Encoder(bpe.default_ranks()), bpe.encoder(bpe.default_ranks())
            for enc in (one, each):
                ids, counts = enc.encode_batch(batch)
                assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in batch]
        df = docs(spark, list(enumerate(pair)), 1)
        assert {bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(df)).collect()} == set(pair)


def test_shingles_are_told_apart(spark):
    a, b = thue_morse(10)
    rows = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, " ".join([a] * 9) + " " + b)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(docs(spark, rows)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0)}


def test_jaccard_odd_rows(spark):
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(docs(spark, ODD).withColumn("size", F.lit("x"))).collect())
    assert got == {(1, 1, 0): 1, (2, 2, 0): 1, (None, 3, 2): 1, (3, 3, 2): 2, (4, 4, 0): 1, (5, 5, 0): 1}


def test_one_row_of_each_group(spark):
    """An id on two texts keeps the row of the group that it leads, not a copy that belongs to another one."""
    base = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(base), " ".join([*base[:-1], "z"]), " ".join(f"v{i}" for i in range(60))
    rows = [(7, a), (9, near), (5, other), (9, other), (7, a), (None, near)]
    kept = sorted(map(tuple, jaccard.first_of_groups(docs(spark, rows)).collect()))
    assert kept == [(5, other), (7, a)]


# -- packing


def plain_pack(lengths, capacity, quadratic):
    """The rule as it is stated, with a scan over all open sequences for every piece."""
    pieces, sequence, tails = [], 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n // capacity * capacity, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, doc, n // capacity * capacity))
    total = sum(t[0] for t in tails)
    size = [capacity] * (total // capacity) + [1 << i for i in range(30, -1, -1) if total % capacity >> i & 1]
    cost, used = [0.0] * len(size), [0] * len(size)
    while tails:
        n, doc, start = max(tails, key=lambda t: (t[0], -t[1], -t[2]))
        tails.remove((n, doc, start))
        fits = [k for k in range(len(size)) if size[k] - used[k] >= n] or [k for k in range(len(size)) if size[k] > used[k]]
        k = min(fits, key=lambda k: (cost[k], k))
        m = min(n, size[k] - used[k])
        if m < n:
            tails.append((n - m, doc, start + m))
        pieces.append((doc, start, m, sequence + k, used[k]))
        cost[k], used[k] = cost[k] + m + quadratic * m * m, used[k] + m
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_packing_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.choice([rng.integers(1, 90), rng.integers(1, 30), 64, 128, 1], 200)] + [int(x) for x in rng.integers(1, 200, 50)]
    assert sorted(packing.pack(lengths, 64, 1 / 32)) == sorted(plain_pack(lengths, 64, 1 / 32))
    assert packing.pack([], 64) == []


def test_packing_balances_cost():
    """Costs are nearer to one another than by first fit over the same pieces in the same order."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 600, 3000).tolist()
    pieces = packing.pack(lengths, 2048)
    cost, first = collections.Counter(), [[0, 0.0] for _ in range(sum(lengths) // 2048 + 1)]
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 4096
    for n in sorted(lengths, reverse=True):
        for seq in first:
            if seq[0] + n <= 2048:
                seq[0], seq[1] = seq[0] + n, seq[1] + n + n * n / 4096
                break
    whole = {s for s, n in collections.Counter({s: sum(p[2] for p in pieces if p[3] == s) for s in cost}).items() if n == 2048}
    spread = lambda c: np.std(c) / np.mean(c)
    assert spread([cost[s] for s in whole]) < 0.25 * spread([c for n, c in first if n > 2000])


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(docs(spark, ODD, 1).withColumn("length", F.lit("x"))).toPandas()
    assert rows.length.sum() == sum(rows.groupby(["doc_id", "doc_tokens"], dropna=False).doc_tokens.first() * [1, 1, 2, 1, 1, 1])
    sizes = rows.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


# -- personal data


def test_pii_is_linear_in_matches(spark):
    took = []
    for n in (12_500, 100_000):
        text = " ".join(f"user{i}@mail.example.com tel {i % 900 + 100}-555-{i % 9000 + 1000}" for i in range(n // 2))
        df = docs(spark, [(1, text)], 1)
        began = time.time()
        r = pii.pii_report(df).first()
        assert (r.n_email, r.spans.count("phone_local")) == (n // 2, n // 2)
        assert pii.redact(df).first().text == " ".join(["[EMAIL] tel [PHONE_LOCAL]"] * (n // 2))
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 5


def test_pii_overlaps_and_context(spark):
    texts = ["+1 212 555 1234 call 212-555-1234", "4111 1111 1111 1111", "ref 4111111111111111 x", "212-555-1234 (mobile)", "212.555.1234", "no 1-2-3", "phone " + "x" * 50 + " 212-555-1234"]
    got = [[s.split(":")[0] for s in r.spans.split(",") if s] for r in pii.pii_report(docs(spark, list(enumerate(texts)), 1)).orderBy("doc_id").collect()]
    assert got == [["phone", "phone_local"], ["card"], ["card"], ["phone_local"], [], [], []]


def test_pii_odd_rows(spark):
    got = [tuple(r)[:5] for r in pii.pii_report(docs(spark, [(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co"), (2, None)])).collect()]
    assert sorted(got, key=str) == [(1, 1, 0, 0, 0)] * 2 + [(2, 0, 0, 0, 0), (None, 1, 0, 0, 0)]


# -- language


def test_language_by_hand(spark):
    """Profiles and distances as the definition has them, from text and dictionaries."""

    def grams(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        s = " " + " ".join(s.split()) + " "
        if len(s) < 3:
            return collections.Counter()
        out = collections.Counter(c for c in s if c != " ")
        out.update(s[i : i + 2] for i in range(len(s) - 1))
        out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
        return out

    def order(count, size):
        key = lambda g: [0 if c == " " else ord(c) for c in g]
        number = lambda g: key(g)[0] if len(g) == 1 else (key(g)[0] + 1) << 21 | key(g)[1] if len(g) == 2 else (key(g)[0] + 1) << 42 | key(g)[1] << 21 | key(g)[2]
        return sorted(count, key=lambda g: (-count[g], number(g)))[:size]

    train = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, "the the", "en"), (4, None, "en"), (5, "x", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    sums = collections.defaultdict(collections.Counter)
    for _, t, lang in train[:3]:
        sums[lang].update(grams(t))
    profiles = {k: order(c, 20) for k, c in sums.items()}
    made = langid.fit_profiles(df, size=20)
    tests = ["the cat and the hound", "die katze", "Der Hund 12", "", None, "...", "the the the", "ß é", "a " * 30_000]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs(spark, list(enumerate(tests))), made, size=20).collect()}
    for i, t in enumerate(tests):
        own = order(grams(t or ""), 20)
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        away = {k: sum(abs(p.index(g) - r) if g in p else 20 for r, g in enumerate(own)) for k, p in profiles.items()}
        lang = min(sorted(away), key=away.get)
        assert got[i] == (lang, pytest.approx(1 - away[lang] / (20 * len(own))))


# -- quality


def test_attention_model_by_hand():
    """The forward pass in plain loops, and every gradient against differences."""
    rng = np.random.default_rng(2)
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, 4))
    w = {"mean": rng.normal(size=4), "std": rng.uniform(0.5, 2, 4), "W": rng.normal(size=(4, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}

    def plain(w):
        out, at = [], 0
        for n in counts:
            h = [[math.tanh(sum((x[i][k] - w["mean"][k]) / w["std"][k] * w["W"][k][j] for k in range(4)) + w["b"][j]) for j in range(3)] for i in range(at, at + n)]
            e = [sum(math.tanh(sum(v[j] * w["V"][j][g] for j in range(3))) / (1 + math.exp(-sum(v[j] * w["U"][j][g] for j in range(3)))) * w["a"][g] for g in range(2)) for v in h]
            att = [math.exp(v) / sum(map(math.exp, e)) for v in e]
            z = [sum(a * v[j] for a, v in zip(att, h, strict=True)) for j in range(3)]
            out.append(1 / (1 + math.exp(-sum(z[j] * w["c"][j] for j in range(3)) - w["d"][0])))
            at += n
        return out

    loss = lambda w: -sum(math.log(p if t else 1 - p) for p, t in zip(plain(w), y, strict=True)) / len(y)
    model = quality.Model()
    model.weights = w
    assert model.score(x, counts).tolist() == pytest.approx(plain(w), rel=1e-11)
    grad = model._gradient(x, counts, y, w)
    for name, g in grad.items():
        for at in np.ndindex(w[name].shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = {k: v.copy() for k, v in w.items()}
                other[name][at] += step
                moved.append(loss(other))
            assert g[at] == pytest.approx((moved[0] - moved[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(3, 0), (9, 5), (None, 1)], "doc_id long, quality long")
    df = docs(spark, [*ODD, *[(7, "same")] * 40])
    out = quality.quality_report(df, labels.filter("quality = 1"), max_docs=5).collect()
    assert len(out) == len(ODD) + 40 and {r.score for r in out} == {1.0} and {r.predicted for r in out} == {1}
    mixed = quality.quality_report(df, labels).collect()
    assert all(0 <= r.score <= 1 for r in mixed) and len({r.score for r in mixed if r.doc_id == 7}) == 1


# -- pipeline


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, quality_score double, rid string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None, None, None, None), (1, "the cat sat on the mat " * 9, "en", "s", 9, "e", 0.5, "r")]
    df = spark.createDataFrame(rows, schema)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.collect()
