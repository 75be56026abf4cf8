"""Removal of repeated passages by Rabin-Karp windows (operator 8).

Every window of WIDTH words gets a rolling 64-bit hash and, from a second base, 24 check bits. A map task sorts
FLUSH_WINDOWS windows at a time: of each window only the smallest document goes on to the shuffle, as one entry of a
bucket's compressed block; any other document of the flush with that window is decided on the spot. So a passage that a
third of all rows share reaches its bucket as one entry per flush. Buckets are hash ranges; their number follows the
corpus, so that each holds about BUCKET_WINDOWS windows; beyond 2 ** LEVEL_BITS buckets the blocks are split in two
levels, as a flush would break up into crumbs. Buckets report the windows that a smaller document holds; these return to
their documents as sets of hashes, and each document merges its flagged windows into maximal intervals and drops the
words inside.

Windows are compared by 88 bits: among n windows n * n / 2 ** 89 false matches are to be expected, one in ten million runs
over 30 GB, and some 0.9 in the 2.3e13 windows of 100 TB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, id_key, identifier, ids_array, parts, text_chunks

WIDTH = 50
#: Windows sorted at once in a map task; 16 bytes each, some four times over.
FLUSH_WINDOWS = 2_000_000
#: Windows that a bucket is meant to hold; bounds a reducer's memory. Buckets of one level as a power of two.
BUCKET_WINDOWS, LEVEL_BITS = 1 << 21, 12
_CHECK_BASE = np.uint64(0xA0761D6478BD642F)


def _pack(values: np.ndarray) -> bytes:
    """Sorted or small integers, by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


_BLOCK = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("checks", pa.binary()), ("places", pa.binary()), ("doc_ids", pa.binary()), ("marks", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("width", pa.int32())])
BLOCK = "bucket long, hashes binary, checks binary, places binary, doc_ids binary, marks binary, doc_id long, mark long, width int"
FLAGS = "doc_id long, mark long, hashes binary"
_FLAGS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("hashes", pa.binary())])


def _checks(data: bytes) -> np.ndarray:
    """Three little-endian bytes each."""
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view(np.uint32).ravel()


class Entries:
    """Windows sorted by hash, then by document: hash, check, place in ids and marks.

    A document is a doc_id; rows without one are told apart by a mark of their text, lest each is sent what concerns any.
    """

    def __init__(self, ids: np.ndarray, marks: np.ndarray, hashes: np.ndarray, checks: np.ndarray, places: np.ndarray):
        own, rank = np.unique(np.stack([ids, marks], 1), axis=0, return_inverse=True)
        rank = rank.ravel().astype(np.uint32)
        self.ids, self.marks = own[:, 0], own[:, 1]
        p = rank[places]
        order = np.lexsort((p, hashes))
        h, c = hashes[order], checks[order]
        if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((p, checks, hashes))
            h, c = hashes[order], checks[order]
        p = p[order]
        first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        new = first.copy()
        new[1:] |= p[1:] != p[:-1]
        start = np.flatnonzero(first)
        least = self.ids[p[start]]  # documents stand in order
        #: a smaller document holds the window
        self.later = self.ids[p] > np.repeat(least, np.diff(np.append(start, len(h))))
        self.hashes, self.checks, self.places, self.new = h, c, p, new

    def flagged(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, mark, hashes) of windows that a smaller document holds."""
        some = self.later & self.new
        places, hashes = self.places[some], self.hashes[some]
        order = np.argsort(places, kind="stable")
        places, hashes = places[order], hashes[order]
        cuts = np.flatnonzero(np.diff(places)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if b > a:
                yield int(self.ids[places[a]]), int(self.marks[places[a]]), hashes[a:b].tobytes()

    def blocks(self, bits: int) -> Iterator[pa.RecordBatch]:
        """Blocks for 2 ** bits buckets, and rows with a doc_id for what is decided already."""
        rows = [(i % (1 << bits), hs, None, None, None, None, i, m, None) for i, m, hs in self.flagged()]
        some = self.new & ~self.later
        h, c, p = self.hashes[some], self.checks[some], self.places[some]
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)]):
            if b > a:
                used, local = np.unique(p[a:b], return_inverse=True)
                small = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                ids = self.ids[used]
                rows.append((int(bucket[a]), _pack(np.diff(h[a:b], prepend=np.uint64(0))), c[a:b].view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), _pack(small), _pack(np.diff(ids, prepend=0)), self.marks[used][ids == NULL_ID].tobytes(), None, None, small.itemsize))
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows[at : at + 2000]), _BLOCK)], schema=_BLOCK)


class _Held:
    """Blocks or documents that wait to be sorted."""

    def __init__(self):
        self.ids, self.marks, self.hashes, self.checks, self.places, self.n, self.documents = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, marks: np.ndarray, hashes: np.ndarray, checks: np.ndarray, places: np.ndarray) -> None:
        self.ids.append(ids)
        self.marks.append(marks)
        self.hashes.append(hashes)
        self.checks.append(checks)
        self.places.append(places + np.uint32(self.documents))
        self.n += len(hashes)
        self.documents += len(ids)

    def entries(self) -> Entries:
        out = Entries(*(np.concatenate(x) for x in (self.ids, self.marks, self.hashes, self.checks, self.places)))
        self.__init__()
        return out


def _scan(bits: int, width: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            ids, marks = ids_array(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets)
                grams = words.windows(width)
                if not len(grams):
                    continue
                checks = (words.windows(width, _CHECK_BASE) >> np.uint64(40)).astype(np.uint32)
                count = np.diff(words.first) - width + 1
                for k in np.flatnonzero(count > 0).tolist():
                    at, n = int(words.first[k]), int(count[k])
                    for low in range(at, at + n, flush):
                        high = min(low + flush, at + n)
                        held.add(ids[a + k : a + k + 1], marks[a + k : a + k + 1], grams[low:high], checks[low:high], np.zeros(high - low, np.uint32))
                        if held.n >= flush:
                            yield from held.entries().blocks(bits)
        if held.n:
            yield from held.entries().blocks(bits)

    return run


def _over_blocks(close, flush: int | None):
    """Rows sorted by bucket: what is decided passes on; close gets the entries of a bucket, or of flush of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, _Held()
        for batch in batches:
            decided = batch.filter(batch.column(6).is_valid())
            if len(decided):
                yield close(None, decided)
            batch = batch.filter(batch.column(6).is_null())
            for b, hashes, checks, places, doc_ids, marks, width in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 8))):
                if held.n and (b != bucket or (flush and held.n >= flush)):
                    yield from close(held.entries(), None)
                bucket = b
                ids = np.cumsum(_unpack(doc_ids, np.int64))
                named = np.zeros(len(ids), np.int64)
                named[ids == NULL_ID] = np.frombuffer(marks, np.int64)
                places = _unpack(places, np.uint16 if width == 2 else np.uint32).astype(np.uint32)
                held.add(ids, named, np.cumsum(_unpack(hashes, np.uint64), dtype=np.uint64), _checks(checks), places)
        if held.n:
            yield from close(held.entries(), None)

    return run


def _split(bits: int, flush: int):
    """Blocks of coarse buckets become blocks of 2 ** bits fine ones."""
    return _over_blocks(lambda entries, decided: decided if entries is None else entries.blocks(bits), flush)


def _count():
    """Which of a bucket's documents hold a window that a smaller one holds too."""

    def flags(entries: Entries | None, decided: pa.RecordBatch | None):
        if entries is None:
            return pa.RecordBatch.from_arrays([decided.column(k) for k in (6, 7, 1)], schema=_FLAGS)
        rows = list(entries.flagged())
        return (pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows[at : at + 5000]), _FLAGS)], schema=_FLAGS) for at in range(0, len(rows), 5000))

    return _over_blocks(flags, None)


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _remove(width: int, digest: bool):
    """Columns in: doc_id, text, list of flagged hash blocks."""
    schema = _DIGEST if digest else _REMOVED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flags = batch.column(0), batch.column(2)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words, rows, grams = None, [], None
                for k in range(b - a):
                    body = data[offsets[k] : offsets[k + 1]].tobytes()
                    kept = body.split()
                    n = len(kept)
                    if n >= width and (found := flags[a + k].as_py()) is not None:
                        if words is None:
                            words = Words(data, offsets)
                            grams = words.windows(width)
                        at = int(words.first[k])
                        wanted = np.frombuffer(b"".join(found), np.uint64)  # may hold windows of other rows with this doc_id
                        hit = np.isin(grams[at : at + n - width + 1], wanted)
                        edge = np.zeros(n + 1, np.int64)
                        edge[: len(hit)] += hit
                        edge[width : width + len(hit)] -= hit
                        covered = np.cumsum(edge[:n]) > 0
                        kept = [w for w, c in zip(kept, covered.tolist()) if not c]
                    text = b" ".join(kept)
                    rows.append((n, n - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode()))
                columns = [ids.slice(a, b - a), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(schema)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digest: bool = False, flush: int = FLUSH_WINDOWS, bucket_windows: int = BUCKET_WINDOWS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (with digest: kept_sha256); one row per input row.

    A window is width consecutive words of one document; each word of it goes if the same words also start in a document
    with a smaller doc_id, judged on the input. A null or empty text has no words and comes back empty. Fewer words
    than width: nothing goes. A null doc_id is larger than any other and equal to other null ones. Rows that share a
    doc_id never remove each other's words. An empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    slim = docs.select(identifier(docs, id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    marked = slim.withColumn("mark", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    n_windows = (slim.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # a word and its blank take some six bytes
    bits = max(4, (2 * parts(spark) - 1).bit_length(), (n_windows // bucket_windows).bit_length())
    levels = [bits] if bits <= level_bits else [bits // 2, bits]
    blocks = marked.mapInArrow(_scan(levels[0], width, flush), BLOCK)
    for fine in levels[1:]:
        blocks = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_split(fine, flush), BLOCK)
    counted = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(), FLAGS)
    flags = counted.groupBy(F.col("doc_id").alias("key"), "mark").agg(F.collect_list("hashes").alias("hashes"))
    joined = marked.withColumn("key", id_key()).join(flags, ["key", "mark"], "left")
    return joined.select("doc_id", "text", "hashes").mapInArrow(_remove(width, digest), "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string"))
