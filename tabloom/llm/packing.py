"""Packing documents into fixed-length sequences (operator 6).

A map task tokenises each text, appends the end id and cuts it at multiples of the sequence length; only lengths and
checksums leave it, never ids. Documents fall into random groups of about GROUP_DOCS by a hash of id, text and
number among their repeats, so no source or hot key decides a group's size. In a group, full pieces are sequences of their own, and the remainders are
packed first-fit decreasing: a tournament tree over the bins' free room finds the first bin that takes a piece in
logarithmic time. Groups are independent, so a lost task is packed again alone with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identifier
from .tokens import shared

LENGTH, END_ID = 2048, 1
GROUP_DOCS = 4000
#: Rows that repeat id and text are numbered so many at a time.
COPIES = 10_000


class Tournament:
    """First-fit over bins of one capacity: each node knows the largest room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the first bin with room for size; there are as many bins as pieces."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= size
        out = at - self.leaves
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return out, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    tree, out = Tournament(len(sizes), capacity), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        out[k] = tree.place(sizes[k])
    return out


_CUT = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("body", pa.int64()), ("sums", pa.list_(pa.int64()))])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _tokenise(path: str | None, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = shared(path).encode, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            tokens, bodies, sums = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "") + end
                tokens.append(len(ids) // 4)
                bodies.append(zlib.crc32(ids))
                sums.append([zlib.crc32(ids[a : a + 4 * length]) for a in range(0, len(ids), 4 * length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(bodies, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], schema=_CUT)

    return run


def _pack(length: int):
    """Rows sorted by (group, doc_id, ...); one group is in memory at a time."""

    def close(group: int, rows: list[tuple]) -> pa.RecordBatch:
        pieces = [(doc, at * length, min(length, n - at * length), crc, n) for doc, n, sums in rows for at, crc in enumerate(sums)]
        placed = first_fit_decreasing([p[2] for p in pieces], length)
        out = [(*p, (group << 32) + b, offset) for p, (b, offset) in zip(pieces, placed)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and rows:
                    yield close(group, rows)
                    rows = []
                group = g
                rows.append(row)
        if rows:
            yield close(group, rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece.

    A null or empty text is the end id alone. A document longer than a sequence is cut at multiples of length, shorter
    ones stay whole. Rows that repeat a doc_id are documents of their own, each packed once; a null doc_id stays null.
    Equal pieces are placed in order of (doc_id, start), so reruns agree. An empty table gives an empty result; other
    columns play no part.
    """
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    cut = slim.mapInArrow(_tokenise(tokenizer, length), "doc_id long, doc_tokens long, body long, sums array<long>")
    n = docs.select(F.count(F.lit(1))).first()[0]
    groups = max(1, round(n / group_docs))
    # rows that repeat id and text are counted first and numbered, so that they spread over groups as others do
    counted = cut.groupBy("doc_id", "doc_tokens", "body", "sums").agg(F.count(F.lit(1)).alias("n"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    copy = F.explode(F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1))
    keyed = counted.withColumn("run", run).withColumn("copy", copy).withColumn("group", F.pmod(F.xxhash64("doc_id", "body", "copy"), F.lit(groups)))
    placed = keyed.repartition("group").sortWithinPartitions("group", "doc_id", "doc_tokens", "body", "copy")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("group", "doc_id", "doc_tokens", "sums").mapInArrow(_pack(length), schema)
