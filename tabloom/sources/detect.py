"""Format detection from bytes: ods, xlsx, gnumeric, Excel 2003 XML, parquet, xml, json, in this order."""

from __future__ import annotations

import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .package import PackageError, decode, open_package

FORMATS = ("ods", "xlsx", "gnumeric", "xls_xml", "parquet", "xml", "json", "csv", "unknown")
_ODS = b"application/vnd.oasis.opendocument.spreadsheet"


def is_parquet(data: bytes) -> bool:
    return len(data) >= 12 and data[:4] == data[-4:] == b"PAR1" and int.from_bytes(data[-8:-4], "little") + 12 <= len(data)


def _is_xml(text: str) -> bool:
    return bool(re.match(r"\s*(<\?xml|<!--|<!DOCTYPE|<[A-Za-z_])", text))


def is_format(data: bytes, kind: str) -> bool:
    """One format's test; csv takes anything."""
    try:
        if kind == "csv":
            return True
        if kind == "ods":
            return data[:2] == b"PK" and open_package(data, {"mimetype"}).get("mimetype", b"").strip() == _ODS
        if kind == "xlsx":
            return data[:2] == b"PK" and b"/xl/workbook.xml" in open_package(data, {"[Content_Types].xml"}).get("[Content_Types].xml", b"")
        if kind == "gnumeric":
            head = zlib.decompressobj(31).decompress(data, 4000) if data[:2] == b"\x1f\x8b" else data[:4000]
            return b"gnumeric" in head and b"Workbook" in head
        if kind == "xls_xml":
            return b"urn:schemas-microsoft-com:office:spreadsheet" in data[:8000].replace(b"\0", b"")
        if kind == "parquet":
            return is_parquet(data)
        if kind == "xml":
            return _is_xml(decode(data[:1000] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data)[:1000])
        if kind == "json":
            json.loads(decode(data))
            return True
    except (PackageError, zipfile.BadZipFile, zlib.error, RecursionError, OSError, EOFError, ValueError):
        return False
    return False


def detect(data: bytes) -> str:
    """csv is never detected; what nothing claims is unknown."""
    return next((k for k in FORMATS[:7] if is_format(data, k)), "unknown")


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format of every file that path matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([detect(x) for x in b.column(2).to_pylist()], pa.string())], names=["path", "length", "format"])

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInArrow(run, "path string, length long, format string")
