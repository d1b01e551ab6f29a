"""Image folders, masks, Feather and compressed CSV as sources and sinks; outputs that are kept, skipped or replaced.

Files are listed and read by Spark's binary source, so any store that Spark reaches will do; a task decodes one file at a
time. Sinks that Spark has no writer for go through pyarrow's file systems, a file a key.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "y long, x long, value double"
#: TIFF field types by number: bytes of one value and its struct letter.
FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}


def decode_tiff(data: bytes) -> np.ndarray:
    """The pages of an uncompressed grey-scale TIFF of one size: array (page, y, x). ValueError for any other file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    pages, at = [], struct.unpack(order + "I", data[4:8])[0]
    try:
        while at:
            n = struct.unpack_from(order + "H", data, at)[0]
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in FIELD:
                    size, letter = FIELD[kind]
                    place = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                    tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
            get = lambda tag, default: tags.get(tag, (default,))
            if get(259, 1)[0] != 1 or get(277, 1)[0] != 1:
                raise ValueError("only uncompressed files of one sample a pixel")
            kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[get(339, 1)[0]] }{get(258, 8)[0] // 8}")
            raw = b"".join(data[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
            pages.append(np.frombuffer(raw, kind, tags[257][0] * tags[256][0]).reshape(tags[257][0], tags[256][0]))
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except (struct.error, KeyError, TypeError) as e:
        raise ValueError("broken TIFF file") from e
    return np.stack(pages)


def encode_tiff(pages: np.ndarray) -> bytes:
    """An uncompressed little-endian TIFF of (page, y, x) or (y, x), a strip a page."""
    pages = pages[None] if pages.ndim == 2 else pages
    kind = pages.dtype.newbyteorder("<")
    out = io.BytesIO()
    out.write(b"II" + struct.pack("<HI", 42, 8))
    for i, page in enumerate(pages):
        raw = np.ascontiguousarray(page.astype(kind)).tobytes()
        sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
        start = out.tell()
        tags = [(256, page.shape[1]), (257, page.shape[0]), (258, kind.itemsize * 8), (259, 1), (262, 1), (273, start + 2 + 12 * 10 + 4), (277, 1), (278, page.shape[0]), (279, len(raw)), (339, sample)]
        end = start + 2 + 12 * len(tags) + 4 + len(raw)
        out.write(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags))
        out.write(struct.pack("<I", end + end % 2 if i + 1 < len(pages) else 0) + raw + b"\0" * (end % 2 if i + 1 < len(pages) else 0))
    return out.getvalue()


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _pixel_rows(files: DataFrame, keys: dict[str, str], page: str | None) -> DataFrame:
    """(keys, page?, y, x, value) of files (keys, path, content); a file that cannot be read has one row without pixels."""
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + (f", {page} long" if page else "") + f", {PIXELS}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                own = {k: row[k] for k in keys}
                try:
                    image = decode_tiff(row["content"])
                except ValueError as e:
                    yield pd.DataFrame([{**own, **({page: None} if page else {}), "y": None, "x": None, "value": None, "error": f"{row['path']}: {e}"}])
                    continue
                for k, one in enumerate(image):
                    y, x = np.indices(one.shape).reshape(2, -1)
                    yield pd.DataFrame({**own, **({page: k} if page else {}), "y": y, "x": x, "value": one.ravel().astype(float), "error": None})

    return files.select(*keys, "path", "content").mapInPandas(run, schema)


def _wanted(rows: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """Rows of the names; a name without a row is an error."""
    if names is None:
        return rows
    held = {r[0] for r in rows.filter(F.col(column).isin(names)).select(column).distinct().collect()}
    if set(names) - held:
        raise ValueError(f"no files for {column} {sorted(set(names) - held)}")
    return rows.filter(F.col(column).isin(names))


def read_image_tree(spark: SparkSession, path: str, fovs: list[str] | None = None, channels: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Images in ``path``/fov/[folder/]channel.tif[f] as (fov, channel, y, x, value, error); error names an unreadable file."""
    middle = rf"/{folder}" if folder else ""
    parts = rf"/([^/]+){middle}/([^/]+)\.tiff?$"
    found = _files(spark, path, "*.{tif,tiff}").filter(F.col("path").rlike(parts))
    named = found.select(F.regexp_extract("path", parts, 1).alias("fov"), F.regexp_extract("path", parts, 2).alias("channel"), "path", "content")
    return _pixel_rows(_wanted(_wanted(named, "fov", fovs), "channel", channels), {"fov": "string", "channel": "string"}, None)


def read_image_stacks(spark: SparkSession, path: str, channels: list[str], fovs: list[str] | None = None) -> DataFrame:
    """Images of several pages in ``path``/fov.tif[f]; the pages are ``channels`` in their order."""
    parts = r"/([^/]+)\.tiff?$"
    named = _files(spark, path, "*.{tif,tiff}").select(F.regexp_extract("path", parts, 1).alias("fov"), "path", "content")
    rows = _pixel_rows(_wanted(named, "fov", fovs), {"fov": "string"}, "page")
    names = F.array(*[F.lit(c) for c in channels])
    return rows.withColumn("channel", F.get(names, F.col("page").cast("int"))).select("fov", "channel", "y", "x", "value", "error")


def read_masks(spark: SparkSession, path: str, ending: str, fovs: list[str] | None = None) -> DataFrame:
    """Label images ``path``/fov<ending>.tif[f] as (fov, y, x, label, error)."""
    parts = rf"/([^/]+){ending}\.tiff?$"
    named = _files(spark, path, f"*{ending}.{{tif,tiff}}").select(F.regexp_extract("path", parts, 1).alias("fov"), "path", "content")
    rows = _pixel_rows(_wanted(named, "fov", fovs), {"fov": "string"}, None)
    return rows.select("fov", "y", "x", F.col("value").cast("long").alias("label"), "error")


def _save(path: str, data: bytes) -> None:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{place}.part") as out:
        out.write(data)
    system.move(f"{place}.part", place)  # a file is whole or not there, also when a task is run again


def _by_key(rows: DataFrame, key: list[str], path: str, name: Callable[..., str], make: Callable[[pd.DataFrame], bytes]) -> list[str]:
    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        file = f"{path.rstrip('/')}/{name(*group)}"
        _save(file, make(part))
        return pd.DataFrame([file], columns=["file"])

    return sorted(r[0] for r in rows.groupBy(*key).applyInPandas(run, "file string").collect())  # a row a file


def write_image_tree(images: DataFrame, path: str, kind: str = "float32") -> list[str]:
    """A TIFF a fov and channel at ``path``/fov/channel.tiff, from (fov, channel, y, x, value); names the files."""

    def make(rows: pd.DataFrame) -> bytes:
        image = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), kind)
        image[rows["y"].to_numpy(int), rows["x"].to_numpy(int)] = rows["value"].fillna(0)
        return encode_tiff(image)

    return _by_key(images.filter("y is not null and x is not null"), ["fov", "channel"], path, lambda f, c: f"{f}/{c}.tiff", make)


def write_masks(masks: DataFrame, path: str, ending: str) -> list[str]:
    """A TIFF of 32-bit labels a fov at ``path``/fov<ending>.tiff."""

    def make(rows: pd.DataFrame) -> bytes:
        image = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.int32)
        image[rows["y"].to_numpy(int), rows["x"].to_numpy(int)] = rows["label"].fillna(0)
        return encode_tiff(image)

    return _by_key(masks.filter("y is not null and x is not null"), ["fov"], path, lambda f: f"{f}{ending}.tiff", make)


def split_stacks(spark: SparkSession, path: str, target: str, channels: list[str]) -> list[str]:
    """Stacks as a folder a fov with a file a channel."""
    return write_image_tree(read_image_stacks(spark, path, channels).filter("error is null"), target)


def write_feather(rows: DataFrame, path: str, key: str) -> list[str]:
    """An uncompressed Feather file a value of ``key``."""

    def make(part: pd.DataFrame) -> bytes:
        from pyarrow import feather

        out = io.BytesIO()
        feather.write_feather(part.reset_index(drop=True), out, compression="uncompressed")
        return out.getvalue()

    return _by_key(rows, [key], path, lambda k: f"{k}.feather", make)


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All Feather files below ``path``; a file that cannot be read gives no row."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from pyarrow import feather

        for batch in batches:
            for data in batch["content"]:
                try:
                    yield feather.read_table(pa.BufferReader(data)).to_pandas()[names]
                except (pa.ArrowInvalid, OSError):
                    continue

    return _files(spark, path, "*.feather").select("content").mapInPandas(run, schema)


def write_csv(rows: DataFrame, path: str, by: str | None = None, compress: bool = False, name: Callable[[str], str] = str) -> list[str]:
    """A CSV with header a value of ``by`` (or one a partition), zstd-compressed on demand; names the files."""
    import zstandard

    ending = ".csv.zst" if compress else ".csv"
    pack = zstandard.compress if compress else (lambda b: b)
    make = lambda part: pack(part.to_csv(index=False).encode())
    if by is not None:
        return _by_key(rows, [by], path, lambda k: f"{name(str(k))}{ending}", make)
    part = rows.withColumn("__part", F.spark_partition_id())
    return _by_key(part, ["__part"], path, lambda k: f"part-{k:05d}{ending}", lambda p: make(p.drop(columns="__part")))


def read_csv(spark: SparkSession, path: str, schema: str, tag: str | None = None) -> DataFrame:
    """CSV files with header, plain or zstd-compressed, by column name; ``tag`` adds each row's file name without ending."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    full = schema + (f", {tag} string" if tag else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                if file.endswith(".zst"):
                    data = zstandard.ZstdDecompressor().stream_reader(data).read()
                rows = pd.read_csv(io.BytesIO(data), dtype={n: "string" for n, k in fields if k == "string"})[[n for n, _ in fields]]
                if tag:
                    rows[tag] = file.rsplit("/", 1)[1].split(".csv")[0]
                yield rows

    return _files(spark, path, "*.{csv,csv.zst}").mapInPandas(run, full)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names of plain CSV files, from a header line alone."""
    return (spark.read.text(path).first() or [""])[0].split(",")


def concatenate_csv(spark: SparkSession, path: str, schema: str, target: str, column: str = "fov") -> DataFrame:
    """All CSV files of a folder as one table, ``column`` telling each row's file, written to ``target``."""
    rows = read_csv(spark, path, schema, tag=column)
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def keep_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at ``path``, made and written first if it is not there or ``overwrite`` is set."""
    if overwrite or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` over the table at ``path`` that they may come from: by way of ``path``_temp, which stays until then."""
    spark, temp = rows.sparkSession, f"{path.rstrip('/')}_temp"
    rows.write.mode("overwrite").parquet(temp)
    held = spark.read.schema(rows.schema).parquet(temp)
    held.write.mode("overwrite").parquet(path)
    spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(temp)
    return spark.read.parquet(path)


def write_log(spark: SparkSession, values: dict, path: str) -> None:
    """One line ``name: value`` an entry."""
    rows = [(f"{k}: {v if isinstance(v, str) else json.dumps(v)}",) for k, v in values.items()]
    spark.createDataFrame(rows or [("",)], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_rows(rows: DataFrame, target: str) -> list[str]:
    """Files (path, content) written under their names below ``target``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [f"{target.rstrip('/')}/{p.rsplit('/', 1)[1]}" for p in batch["path"]]
            for file, data in zip(made, batch["content"], strict=True):
                _save(file, data)
            yield pd.DataFrame({"file": made})

    return sorted(r[0] for r in rows.mapInPandas(run, "file string").collect())  # a row a file
