"""Shared helpers: durable intermediate tables, vectorised word hashing, bounded text chunks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these, in every operator here.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised code works on at once; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20
#: Stands for a null identifier: a null id is larger than every other one.
NULL_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_PRIME, _WORD_PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and Spark runs in one process."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier(docs: DataFrame, id_col: str = "doc_id") -> Column:
    return docs[id_col].cast("long").alias("doc_id")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = []
        for b in (base, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            have.append(np.multiply.accumulate(out))
        if n <= 2 * CHUNK_BYTES:  # a longer text than a chunk doesn't stay in memory
            _powers[int(base)] = tuple(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


class Words:
    """The words of several texts laid end to end.

    starts, ends: byte bounds of each word; first: index of each text's first word, one more entry than texts;
    hashes: a 64-bit polynomial hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        n = len(data)
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        power, inverse = powers(_PRIME, n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[fold][data] * power[:n], out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * inverse[self.starts]
            self.hashes = mix(raw + (self.ends - self.starts).astype(np.uint64))

    def windows(self, width: int, base: np.uint64 = _WORD_PRIME) -> np.ndarray:
        """Rabin-Karp hash of the words [i, i + width) for every i at which they exist."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64)
        power, inverse = powers(base, n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.hashes * power[:n], out=total[1:])
            return mix((total[width:] - total[:-width]) * inverse[: n - width + 1] + np.uint64(width))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about limit bytes; null counts as empty.

    A text longer than the limit makes a slice of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ids_array(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


def with_null_ids(ids: list[int]) -> list[int | None]:
    return [None if i == NULL_ID else i for i in ids]


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))
