"""Readers of semi-structured files: delimited, JSON, zipped, HTML state; as tables, as raw cells, as records."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, member string, sheet string, row_number int, column_number int, value string"
STATUS = "path string, bytes long, sha256 string, status string"


def inventory(spark: SparkSession, pattern: str, known: DataFrame | None = None) -> DataFrame:
    """(path, bytes, modified, sha256) of the files; those whose path and size are ``known`` are left out unread."""
    files = spark.read.format("binaryFile").load(pattern)
    listed = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    if known is None:
        return listed
    return listed.join(known.select("path", "bytes"), ["path", "bytes"], "left_anti")


def decode(data: bytes) -> str:
    """Text of a file in UTF-8 (with or without mark), else Latin-1."""
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _separator(text: str) -> str:
    head = text[:4096].split("\n", 1)[0]
    return max(",;\t|", key=head.count)


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
    else:
        yield "", data


def _grid(name: str, data: bytes) -> list[list[str | None]]:
    text = decode(data)
    if name.lower().endswith((".json", ".geojson")):
        value = json.loads(text)
        records = value if isinstance(value, list) else value.get("records") or value.get("features") or value.get("data") or [value]
        flat = [dict(flatten(r)) for r in records]
        names = list(dict.fromkeys(k for r in flat for k in r))
        return [names, *[[r.get(k) for k in names] for r in flat]]
    frame = pd.read_csv(io.StringIO(text), header=None, dtype=str, sep=_separator(text), keep_default_na=False, engine="python", on_bad_lines="skip")
    return frame.values.tolist()


def flatten(value: object, prefix: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, text) of the leaves of a JSON value, as a.b[0].c."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{prefix}[{i}]")
    else:
        yield prefix, None if value is None else value if isinstance(value, str) else json.dumps(value)


def cells(spark: SparkSession, pattern: str) -> DataFrame:
    """Every filled cell of delimited and JSON files, also inside zip archives; unreadable members give no cells (see status).

    Rows and columns are numbered from 1 as they stand; blank cells are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                out = []
                try:
                    for member, content in _members(path, bytes(data)):
                        try:
                            grid = _grid(member or path, content)
                        except Exception:
                            continue
                        out += [(path, member, "", i, j, v) for i, row in enumerate(grid, 1) for j, v in enumerate(row, 1) if v is not None and str(v).strip()]
                except zipfile.BadZipFile:
                    pass
                yield pd.DataFrame(out, columns=["path", "member", "sheet", "row_number", "column_number", "value"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, CELLS)


def read_status(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256, status): 'read', 'empty' or the error of each file; files of no bytes are not listed by the reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    found = sum(len(_grid(m or row.path, c)) for m, c in _members(row.path, bytes(row.content)))
                    status = "read" if found else "empty"
                except Exception as error:  # any unreadable file is a row, not a failed job
                    status = f"{type(error).__name__}: {error}"[:200]
                out.append((row.path, row.length, row.sha256, status))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "status"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    return files.mapInPandas(run, STATUS)


def table_cells(df: DataFrame, key: str) -> DataFrame:
    """(key, column_number, column_name, value) of the filled cells of a table with named columns."""
    names = [c for c in df.columns if c != key]
    entries = F.array(*[F.struct(F.lit(i).alias("column_number"), F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names, 1)])
    return df.select(key, F.explode(entries).alias("c")).select(key, "c.*").where("value is not null")


def json_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of the leaves of a JSON column; unreadable JSON gives none."""

    @F.udf("array<struct<path:string,value:string>>", useArrow=True)
    def leaves(value: str | None):
        try:
            return [{"path": p, "value": v} for p, v in flatten(json.loads(value))] if value else []
        except ValueError:
            return []

    return df.select(key, F.explode(leaves(text)).alias("leaf")).select(key, "leaf.*")


def json_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, record) of a JSON array of objects, each record as JSON text."""
    return df.select(key, F.posexplode(F.from_json(text, "array<map<string,string>>")).alias("position", "record")).select(key, "position", F.to_json("record").alias("record"))


def embedded_links(html: Column) -> Column:
    """Distinct absolute links in a page or text."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(https?://[^\s\"'<>]+)"), 1))


def personal_register(text: Column) -> Column:
    """Whether a line of the text heads a register of persons: name, age and address together."""
    return F.coalesce(text.rlike(r"(?im)^.*\b(?:nama|name)\b.*\b(?:umur|usia|age)\b.*\b(?:alamat|address)\b"), F.lit(False))
