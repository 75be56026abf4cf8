"""Exact duplicates by Patricia tries (operator 5).

Plan: each map task normalises its texts and folds equal ones into a small trie (pre-aggregation); the distinct texts
that are left are shuffled by (length, content hash) and sorted inside their partition, so that Spark's external sorter
holds what does not fit in memory; each partition inserts length, hash and the full bytes into one compressed radix
trie whose terminal nodes hold the smallest identifier and the number of copies. Because keys arrive in order, every
subtree left of the current path is complete; when the trie exceeds its byte budget, those subtrees are written out and
cut off. The owners then join each document's own row. A text that a third of all rows share is one row per map task
before the shuffle of texts; rows that repeat id and text are one counted row before the join, and as nothing after the
join asks for its partitioning, adaptive execution splits a partition in which many ids share one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_BYTES, id_key, identifier, ids_array

#: Bytes of text in a trie before finished subtrees leave it.
TRIE_BYTES = 16 << 20
#: Rows that repeat id and text come back so many at a time.
COPIES = 10_000


def normalise(text: str | None) -> bytes:
    """Every run of white space becomes one space; null is empty."""
    data = (text or "").encode()
    if not data:
        return data
    out = b" ".join(data.split())
    if not out:
        return b" "
    return (b" " if data[0] in SPACE_BYTES else b"") + out + (b" " if data[-1] in SPACE_BYTES else b"")


def normal_sha(text: Column) -> Column:
    """text_sha256 of a text, as an expression."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        low, n = (middle, n) if a[low:middle] == b[low:middle] else (low, middle)
    return low


class Node:
    __slots__ = ("children", "edge", "owner")

    def __init__(self, edge: bytes, owner: list | None = None):
        self.edge, self.owner, self.children = edge, owner, None


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal node holds [smallest id, copies]."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, doc_id: int, copies: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = Node(key[at:])
                self.size += len(key) - at
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child
                node, at = child, len(key)
                break
            n = _shared(child.edge, key[at : at + len(child.edge)])
            if n < len(child.edge):  # split the edge
                middle = Node(child.edge[:n])
                child.edge = child.edge[n:]
                middle.children = {child.edge[0]: child}
                node.children[key[at]] = middle
                child = middle
            node, at = child, at + n
        if node.owner is None:
            node.owner = [doc_id, copies]
        else:
            node.owner[0] = min(node.owner[0], doc_id)
            node.owner[1] += copies

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            key = before + at.edge
            if at.owner is not None:
                yield key, *at.owner
            stack += [(child, key) for child in (at.children or {}).values()]

    def spill(self, current: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Cut off and yield every subtree that does not lead to current."""
        node, at = self.root, 0
        while node is not None:
            keep = current[at] if at < len(current) else -1
            for byte in [b for b in (node.children or {}) if b != keep]:
                yield from self.items(node.children.pop(byte), current[:at])
            node = (node.children or {}).get(keep)
            if node is not None:
                at += len(node.edge)
        self.size = len(current)


LOCAL = "n_bytes long, content_hash long, body binary, doc_id long, copies long"
OWNERS = "text_sha256 string, keep_id long, group_size long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of a task, with smallest id and count."""

    def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for body, doc_id, copies in trie.items():
            rows.append((len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, doc_id, copies))
            size += len(body)
            if size > TRIE_BYTES // 4:
                yield _batch(rows, _LOCAL)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _LOCAL)

    trie = PatriciaTrie()
    for batch in batches:
        for doc_id, text in zip(ids_array(batch.column(0)).tolist(), batch.column(1)):
            trie.insert(normalise(text.as_py()), doc_id)
            if trie.size > TRIE_BYTES:
                yield from flush(trie)
                trie = PatriciaTrie()
    yield from flush(trie)


_LOCAL = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("copies", pa.int64())])
_OWNERS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_SHAS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of texts with copies; rows arrive sorted by (n_bytes, content_hash)."""
    trie, rows = PatriciaTrie(), []

    def take(found: Iterator[tuple[bytes, int, int]]) -> None:
        rows.extend((hashlib.sha256(key[16:]).hexdigest(), doc_id, copies) for key, doc_id, copies in found if copies > 1)

    for batch in batches:
        for n, h, body, doc_id, copies in zip(*(c.to_pylist() for c in batch.columns)):
            key = n.to_bytes(8, "big") + (h + (1 << 63)).to_bytes(8, "big") + body
            trie.insert(key, doc_id, copies)
            if trie.size > TRIE_BYTES:
                take(trie.spill(key[:16]))
        if len(rows) > 4096:
            yield _batch(rows, _OWNERS)
            rows.clear()
    take(trie.items())
    if rows:
        yield _batch(rows, _OWNERS)


def _shas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(normalise(text.as_py())).hexdigest() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], schema=_SHAS)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with copies: text_sha256, keep_id, group_size."""
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    local = slim.mapInArrow(_fold, LOCAL)
    keyed = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return keyed.mapInArrow(_owners, OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    A null text is an empty one. Texts are equal when they are after every run of white space became one space. The
    smallest doc_id of a group stays; a null doc_id counts as larger than any other and keep_id is null if all are.
    If rows repeat both doc_id and text, exactly one of them is kept. An empty table gives an empty result; other
    columns of docs play no part, whatever their names.
    """
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    rows = slim.mapInArrow(_shas, "doc_id long, text_sha256 string").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(owners(docs, id_col, text_col), "text_sha256", "left")
    joined = joined.withColumns({"keep_id": F.coalesce(F.col("keep_id"), id_key()), "group_size": F.coalesce("group_size", F.lit(1))})
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("copy") * COPIES, F.least(F.col("n"), (F.col("copy") + 1) * COPIES) - 1)))
    kept = (F.col("keep_id") == id_key()) & (F.col("copy") == 0)
    return each.select("doc_id", F.nullif("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
