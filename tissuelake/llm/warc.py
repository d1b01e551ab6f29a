"""WARC archives: writing with de-duplicated payloads, and reading by boundary-chain verification.

Writing: payloads of at least ``min_bytes`` that are equal (SHA-1 and length) are stored once, by the row with the
largest page_id; the others become revisit records that refer to it. Records leave through Spark's text writer, whose
line separator is the blank lines that end a record, so each part file is a plain WARC file. The table of payloads that
occur more than once is broadcast if it is small, else the bodies cross a join compressed.

Reading: files are read in splits, cut at the magic line that starts a record. Payloads can hold that line too, so
every occurrence is only a candidate. A first pass turns each candidate into an edge to its successor's offset (header
plus stated length) and follows the edges to the first offset outside its split by pointer jumping. The edges that
lead into a split from elsewhere are few; pointer jumping over them from each file's start finds the entry of every
split. A second pass walks each split's records from its entry, one after the other, and hashes their payloads; it
holds one record at a time, however many false headers a payload has. A record that a magic line cuts at its split's
end is put together from the pieces that the next splits, told which record they begin in, hand on.

Null html counts as empty; a null page_id can only be a response where no other row has its payload; equal rows
with the largest page_id are all responses; null urls give an empty target; other columns are ignored; an empty table
gives an archive without records, and no archive no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, tidy, worker, workspace

MAGIC = "WARC/1.1\r\n"
TAIL = "\r\n\r\n"
#: zstd level of page bodies while they are shuffled.
LEVEL = 9
WHEN = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _recode(rows: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """``rows`` with every body, never null, put through ``change``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            made = pa.array([change(v.as_py()) for v in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([made if n == "body" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return rows.mapInArrow(worker(run), rows.schema)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, small: int = 8 << 20) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``; tables under ``small`` bytes are broadcast."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "digest": sha1_base32(F.col("body").cast("binary"))})
    found = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    keep = materialize(found.filter("n > 1 and kept is not null").drop("n"), "warc-kept")
    if keep.count() * 96 <= small:  # bytes of a row in memory
        joined = rows.join(F.broadcast(keep), ["digest", "bytes"], "left")
    else:
        packed = _recode(rows.withColumn("body", F.col("body").cast("binary")), lambda v: zstandard.compress(v, LEVEL))
        joined = _recode(packed.join(keep.hint("merge"), ["digest", "bytes"], "left"), zstandard.decompress).withColumn("body", F.col("body").cast("string"))
    rows = joined.withColumn("revisit", F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {WHEN}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("kept")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.when(F.col("revisit"), F.lit(0)).otherwise(F.octet_length(http) + F.col("bytes")),
        F.lit(TAIL),
        F.when(F.col("revisit"), "").otherwise(F.concat(http, F.col("body"))),
    )
    with tidy(pages.sparkSession):
        rows.select(record.alias("value")).write.option("lineSep", TAIL).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic line, in file order within each split."""
    df = spark.read.option("lineSep", MAGIC).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


_FIELD = {k: re.compile(rb"(?:^|\r\n)" + k.encode() + rb": *([^\r]*)", re.I) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Length", "X-Payload-Length")}
_META = "record_type string, record_id string, target_uri string, refers_to_id string, stated_digest string, payload_bytes long, payload_digest string"
_COLUMNS = [c.split()[0] for c in _META.split(", ")] + ["payload"]
_LEN = len(MAGIC)
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _record_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = dict(c.split() for c in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in kinds.items()], list(kinds))


def _header(chunk: bytes, names: tuple[str, ...] = tuple(_FIELD)) -> tuple[dict[str, str], int, int] | None:
    """Fields, where the block starts in the chunk, and the block's length."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k: m[1].decode("utf-8", "replace").strip() for k in names if (m := _FIELD[k].search(chunk, 0, end))}
    size = fields.get("Content-Length", "")
    return (fields, end + 4, int(size)) if size.isascii() and size.isdigit() and len(size) < 16 else None


def _described(fields: dict[str, str], block: bytes | None) -> dict:
    """The record's row; block is None where it has not been seen whole."""
    kind = fields.get("WARC-Type", "")
    out = {"record_type": kind, "record_id": fields.get("WARC-Record-ID"), "target_uri": fields.get("WARC-Target-URI"), "refers_to_id": fields.get("WARC-Refers-To"), "stated_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "payload_bytes": None, "payload_digest": None, "payload": None}
    if block is None:
        return out
    if kind == "revisit":
        stated = fields.get("X-Payload-Length", "")
        return out | {"payload_bytes": int(stated) if stated.isdigit() else None, "payload_digest": out["stated_digest"]}
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if block.startswith(b"HTTP/") and cut >= 0 else block
    return out | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload}


def exits(start: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """The first offset on each candidate's chain that is no candidate, by pointer jumping; start is sorted."""
    if not len(start):
        return succ
    at = np.minimum(np.searchsorted(start, succ), len(start) - 1)
    inside = (start[at] == succ) & (succ > start)
    jump = np.where(inside, at, np.arange(len(start)))
    while not np.array_equal(nxt := jump[jump], jump):
        jump = nxt
    return succ[jump]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, bool]]:
    """Split, offset in the split's stream, text, and whether a magic line stands before it, of every chunk."""
    key, pos = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if key != (file, block):
                key, pos = (file, block), 0
            value = value.as_py()
            yield key, pos, value, pos > 0 or block > 0
            pos += len(value) + _LEN


_EDGE = "file string, block long, start long, succ long, exit long, total long"


def _edges(chunks: DataFrame) -> DataFrame:
    """Per split a row with its length (start is null), and a row a candidate; offsets count from the split's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, start, succ = None, 0, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            a, b = np.array(start, np.int64), np.array(succ, np.int64)
            out = exits(a, b)
            for i in range(0, max(1, len(a)), 100_000):
                n = len(a[i : i + 100_000])
                head = [] if i else [None]
                columns = [pa.array(head + x[i : i + n].tolist(), pa.int64()) for x in (a, b, out)]
                size = n + len(head)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.int64()), *columns, pa.array([total] * size, pa.int64())], ["file", "block", "start", "succ", "exit", "total"])

        for split, pos, value, marked in _walk(batches):
            if split != key:
                yield from done()
                key, start, succ = split, [], []
            if marked and (head := _header(value, ("Content-Length",))):  # what precedes the file's first magic line starts no record
                start.append(pos - _LEN)
                succ.append(pos + head[1] + head[2] + len(TAIL))
            total = pos + len(value) + _LEN
        yield from done()

    return chunks.mapInArrow(worker(run), _EDGE)


def _splits(found: DataFrame) -> DataFrame:
    """A row a split: name (16 bytes), base (its offset in the file), entry (its first true record's offset)."""
    size = found.filter("start is null").select("file", "block", "total")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = size.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    edges = found.filter("start is not null").join(base, ["file", "block"]).select("file", "block", *[(F.col(c) + F.col("base")).alias(c) for c in ("start", "succ", "exit")])
    heads = edges.groupBy("file").agg(F.min("block")).select("file", F.lit(0).cast("long").alias("start"))
    targets = edges.select("file", F.col("exit").alias("start")).distinct()
    jump = materialize(edges.join(targets.unionByName(heads).distinct(), ["file", "start"]).select("file", "start", F.col("exit").alias("nxt")), "warc-jumps")
    reached, n = materialize(heads, "warc-reached"), -1
    while True:
        old, reached = reached, materialize(reached.unionByName(reached.join(jump, ["file", "start"]).select("file", F.col("nxt").alias("start"))).distinct(), "warc-reached")
        discard(old)
        if n == (n := reached.count()):
            break
        old, jump = jump, materialize(jump.alias("a").join(jump.select("file", F.col("start").alias("nxt"), F.col("nxt").alias("further")), ["file", "nxt"], "left").select("file", "start", F.coalesce("further", "nxt").alias("nxt")), "warc-jumps")
        discard(old)
    entry = edges.join(reached, ["file", "start"]).groupBy("file", "block").agg(F.min("start").alias("entry"))
    name = F.unhex(F.md5(F.concat_ws("#", "file", "block")))
    return base.join(entry, ["file", "block"], "left").select("file", "block", name.alias("name"), "base", "entry")


class _Places:
    """Numbers of every split (32 bytes a split, so a 4-millionth of the archive at 128 MB a split)."""

    def __init__(self, table: pa.Table, columns: list[str]):
        self.names = np.array([n.hex() for n in table["name"].to_pylist()], "S32")
        self.order = np.argsort(self.names)
        self.names = self.names[self.order]
        self.columns = [pc.fill_null(table[c], -1).to_numpy()[self.order] for c in columns]

    def find(self, split: tuple[str, int]) -> list[int]:
        at = np.searchsorted(self.names, hashlib.md5(f"{split[0]}#{split[1]}".encode()).hexdigest().encode())
        return [int(c[at]) for c in self.columns]


_WHOLE = _META + ", payload binary"
_CUT = "file string, start long, succ long, body_at long, record_type string, record_id string, target_uri string, refers_to_id string, stated_digest string, x_length string"
_PIECE = "file string, start long, at long, data binary"


def _records(chunks: DataFrame, places: Broadcast, what: str, payloads: bool = True) -> DataFrame:
    """The second pass. ``what``: whole records, the headers of records that are cut, or the pieces of these."""
    magic, schema = MAGIC.encode(), {"whole": _WHOLE, "cut": _CUT, "pieces": _PIECE}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        base = want = lead = until = -1
        open_, block = None, bytearray()  # the record that is being read: start, successor, where its body starts, fields

        def add(row: dict) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            held.append(row)
            size += len(row.get("payload") or row.get("data") or b"") + 200
            if size > 4_000_000:
                yield _record_batch(held, schema)
                held, size = [], 0

        def end_split() -> Iterator[pa.RecordBatch]:
            if open_ is None:
                return
            start, succ, body_at, fields = open_
            if what == "cut":
                yield from add(_described(fields, None) | {"file": key[0], "start": start, "succ": succ, "body_at": body_at, "x_length": fields.get("X-Payload-Length")})
            if what == "pieces":
                yield from add({"file": key[0], "start": start, "at": body_at, "data": bytes(block)})

        for split, pos, value, marked in _walk(batches):
            if split != key:
                yield from end_split()
                key, open_, block = split, None, bytearray()
                base, want, lead, until = places.value.find(split)
            at = base + pos  # where the text starts; its magic line stands before it
            if open_ is None and marked and at - _LEN == want:
                fields, body, n = _header(value)
                start, want = want, at + body + n + len(TAIL)
                open_, block = (start, want, at + body, fields), bytearray(value[body : body + n])
            elif open_ is not None:
                block += (magic + value)[: open_[1] - len(TAIL) - open_[2] - len(block)]
            elif what == "pieces" and marked and at - _LEN < until - len(TAIL):
                yield from add({"file": key[0], "start": lead, "at": at - _LEN, "data": (magic + value)[: until - len(TAIL) - at + _LEN]})
            if open_ is not None and len(block) == open_[1] - len(TAIL) - open_[2]:
                if what == "whole":
                    row = _described(open_[3], bytes(block))
                    yield from add(row if payloads else row | {"payload": None})
                open_ = None
        yield from end_split()
        if held:
            yield _record_batch(held, schema)

    return chunks.mapInArrow(worker(run), schema)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per true record: record_type, record_id, target_uri, refers_to_id, digests, length and payload."""
    found = materialize(_edges(_chunks(spark, path)), "warc-candidates")
    splits = materialize(_splits(found), "warc-splits")
    discard(found)

    def places(table: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(_Places(table.select("name", "base", "entry", "lead", "until").toArrow(), ["base", "entry", "lead", "until"]))

    none = F.lit(None).cast("long")
    known = places(splits.withColumns({"lead": none, "until": none}))
    cut = materialize(_records(_chunks(spark, path), known, "cut"), "warc-cut")  # a row a split at most
    whole = _records(_chunks(spark, path), known, "whole", payloads).select(*_COLUMNS)
    if cut.isEmpty():
        return whole
    # true records do not overlap: a split begins inside the last cut record before it, or inside none
    events = splits.select("file", F.col("base").alias("at"), F.lit(1).alias("side"), "name", "base", "entry", none.alias("start"), none.alias("succ"))
    events = events.unionByName(cut.select("file", F.col("start").alias("at"), F.lit(0).alias("side"), "start", "succ"), allowMissingColumns=True)
    so_far = Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = events.withColumns({"lead": F.last("start", ignorenulls=True).over(so_far), "until": F.last("succ", ignorenulls=True).over(so_far)}).filter("side = 1")
    pieces = _records(_chunks(spark, path), places(last), "pieces")

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        block = b"".join(bytes(d) for d in rows.sort_values("at")["data"])[: int(r["succ"] - len(TAIL) - r["body_at"])]
        fields = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Refers-To": r["refers_to_id"], "WARC-Payload-Digest": r["stated_digest"] or "", "X-Payload-Length": r["x_length"] or ""}
        out = _described(fields, block)
        return pd.DataFrame([out if payloads else out | {"payload": None}])[_COLUMNS]

    return whole.unionByName(pieces.join(cut, ["file", "start"]).groupBy("file", "start").applyInPandas(joined, _WHOLE))


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The digest of op7, taken from what is read back."""
    spark = pages.sparkSession
    path = workspace(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path, min_bytes)
    back = read_warc(spark, path, payloads=False)
    return back.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number(F.col("refers_to_id")).alias("refers_to"))
