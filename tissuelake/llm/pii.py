"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is DataFrame expressions. The base kinds (email, ip, card, phone) are always kept when their
validator holds. The added kinds (``phone_local``, ``card_run``, ``iban``) need score >= ``threshold``;
the score is the kind's prior plus a bonus when a context word stands within ``window`` characters before or
after the span (the characters are looked for as far as the second next span of the kind on that side).
Added spans that overlap a base span of the same family are dropped.

Defined results: null text counts as empty; no match gives empty span lists and zero counts; null ids and
repeated rows pass through row by row; extra columns are kept. ``find_pii`` puts its column in the place of one
that is called so; ``redact`` adds no column.

The patterns match exactly what the contract's patterns match, leftmost and non-overlapping. They are
written with possessive quantifiers and a look-behind (or ``\\G``, the end of the match before), so a long
run of one character class is read once and not once per starting position. Work grows in proportion to a text's
length and number of matches: offsets, overlaps and merged spans come from block-wise running sums and maxima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("phone_local", "card_run", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

#: Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A listed country's own length, else (other countries and lengths) any length up to 35; blanks between groups of four."""
    group = r"(?:\x20?[A-Z0-9]{4})"
    rest = lambda n: rf"{group}{{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    own = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{own}|[A-Z]{{2}}[0-9]{{2}}{group}{{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9(+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "card_run": r"(?<![0-9])[0-9]{16,19}(?![0-9])",
    "iban": _iban(),
}
#: Cheap test that a text can hold the kind at all.
TRIGGERS = {"email": "@", "phone": "+"}
IP_OK = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])?(?:\.|$)){4}$"
PRIOR = {"phone_local": 0.4, "card_run": 0.7, "iban": 0.7}
CONTEXT = {
    "phone_local": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|handy|téléphone|teléfono|móvil)\b",
    "card_run": r"(?i)\b(?:card|credit|visa|mastercard|karte|carte|tarjeta)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
#: Running values are taken in blocks of this length, and text is cut in chunks of that many characters.
BLOCK, CHUNK = 256, 4096
SPAN = "struct<start:bigint,end:bigint,value:string,near:string>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sum, maximum or minimum (``op``) of an array of numbers."""
    none = F.array().cast("array<bigint>")
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(op(F.try_element_at(a, F.lit(-1)), x), x)))
    ends = lambda rows: F.aggregate(F.transform(rows, lambda r: F.element_at(r, -1)), none, grow)
    shift = lambda rows, e: F.flatten(F.transform(rows, lambda r, i: F.when(i > 0, F.transform(r, lambda x: op(x, F.get(e, i - 1)))).otherwise(r)))

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
        inner = F.transform(blocks, lambda b: F.aggregate(b, none, grow))
        return _bind(inner, lambda rows: _bind(ends(rows), lambda e: shift(rows, e)))

    return _bind(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(none))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _positions(matches: str, gaps: str, window: int) -> Column:
    """Spans with code-point offsets and the characters near them, from the matches and the text between them."""

    def near(p: Column, i: Column) -> Column:
        if not window:
            return F.lit("")
        at = lambda name, k: F.coalesce(F.get(p[name], k), F.lit(""))
        before = F.substring(F.concat(F.when(i > 0, at("g", i - 1)).otherwise(F.lit("")), F.when(i > 0, at("m", i - 1)).otherwise(F.lit("")), at("g", i)), -window, window)
        return F.concat(before, F.lit("\n"), F.substring(F.concat(at("g", i + 1), at("m", i + 1), at("g", i + 2)), 1, window))

    def spans(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["g"], F.lit(1), F.size(p["m"])), p["m"], lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        made = lambda e: F.transform(p["m"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("value"), near(p, i).alias("near")))
        return _bind(_running(steps, _add), made)

    found = _bind(F.struct(F.col(matches).alias("m"), F.col(gaps).alias("g")), spans)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (of one kind) that overlap none of ``others``: a merge by start."""
    event = lambda mine: lambda x: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["end"].alias("end"), x["value"].alias("value"), x["near"].alias("near"))
    least, most = F.lit(-1).cast("bigint"), F.lit(1 << 60)

    def merged(events: Column) -> Column:
        ended = _running(F.transform(events, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(least)), F.greatest)
        begins = _running(F.reverse(F.transform(events, lambda x: F.when(x["mine"] == 0, x["start"]).otherwise(most))), F.least)
        keep = lambda e, b: F.filter(events, lambda x, i: (x["mine"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(b, F.size(events) - 1 - i) >= x["end"]))
        return _bind(ended, lambda e: _bind(begins, lambda b: keep(e, b)))

    joined = _bind(F.array_sort(F.concat(F.transform(spans, event(1)), F.transform(others, event(0)))), merged)
    plain = F.transform(joined, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["near"].alias("near")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), plain).otherwise(spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(IP_OK)
    if kind == "card":
        return F.when(n.between(16, 19), luhn_ok(digits(value))).otherwise(F.lit(False))
    if kind == "card_run":
        return luhn_ok(value)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "phone_local":
        return n.between(10, 13)
    return mod97_ok(value) if kind == "iban" else F.lit(True)


def _checker(kind: str):
    return lambda span: _valid(kind, span["value"])


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.6, window: int = 40, out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array of struct(kind, start, end, value, score), by kind, then start."""
    docs = without(docs, out_col)
    tag = fresh(docs, "__pii")
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag = "_" + tag
    text, m, g, s, c = (f"{tag}_{x}" for x in ("text", "m", "g", "s", "c"))
    df = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{m}_{k}": F.when(F.contains(F.col(text), F.lit(TRIGGERS[k])) if k in TRIGGERS else F.lit(True), F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({f"{g}_{k}": F.when(F.size(f"{m}_{k}") > 0, F.split(F.col(text), PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    df = df.withColumns({f"{s}_{k}": F.filter(_positions(f"{m}_{k}", f"{g}_{k}", window if k in CONTEXT else 0), _checker(k)) for k in KINDS})
    family = {"phone_local": ["phone", "ip"], "card_run": ["card"], "iban": []}
    df = df.withColumns({f"{c}_{k}": _clear_of(F.col(f"{s}_{k}"), F.concat(*[F.col(f"{s}_{f}") for f in of])) if of else F.col(f"{s}_{k}") for k, of in family.items()})

    def scored(kind: str) -> Column:
        if kind in BASE_KINDS:
            return F.transform(F.col(f"{s}_{kind}"), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(1.0).alias("score")))
        sure = (lambda x: F.startswith(x["value"], F.lit("+"))) if kind == "phone_local" else (lambda x: F.lit(False))
        score = lambda x: F.lit(PRIOR[kind]) + F.when(sure(x) | x["near"].rlike(CONTEXT[kind]), 0.3).otherwise(0.0)
        made = F.transform(F.col(f"{c}_{kind}"), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), score(x).alias("score")))
        return F.filter(made, lambda x: x["score"] >= threshold)

    df = df.withColumn(out_col, F.concat(*[scored(k) for k in KINDS]))
    return df.select(*[f"`{n}`" for n in [*docs.columns, out_col]])


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one, named by the first.

    Texts without spans, null ones included, stay as they are.
    """
    pii = fresh(docs, "__pii")
    found = find_pii(docs, text_col, out_col=pii, **options)
    text = F.col(f"`{text_col}`")
    spans = F.array_sort(F.transform(pii, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def piece(p: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the chunks."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        part = lambda k, lo, n: F.substring(F.coalesce(F.get(p["chunks"], k), F.lit("")), (lo + 1).cast("int"), n.cast("int"))
        far = F.concat(part(i, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(p["chunks"], i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(0), b % CHUNK))
        return F.when(i == j, part(i, a % CHUNK, b - a)).otherwise(far)

    def rewritten(p: Column) -> Column:
        made = lambda e: F.transform(p["spans"], lambda x, i: _bind(F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0)), lambda at: F.when(x["start"] >= at, F.concat(piece(p, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))))
        rest = lambda e: piece(p, F.element_at(e, -1), F.element_at(e, -1) + p["left"])
        return _bind(_running(F.transform(p["spans"], lambda x: -x["back"]), F.greatest), lambda e: F.concat(F.array_join(made(e), ""), rest(e)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = _bind(F.struct(spans.alias("spans"), chunks.alias("chunks"), F.length(text).alias("left")), rewritten)
    changed = F.when(F.size(pii) > 0, whole).otherwise(text)
    return found.select(*[changed.alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns])


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of op3: counts, base_sha256 and the list of all spans of each document."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("pii", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", named), ",").alias("spans"),
    )
