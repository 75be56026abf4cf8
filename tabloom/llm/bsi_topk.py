"""Exact top-k inner products on a bit-sliced index (operator 4).

Vectors are quantised and cut by a hash into blocks of about BLOCK_ROWS candidates of one length. A block's index holds,
for every attribute, one bitmap over its rows for each bit of the attribute's offset value. A query adds the slices of
all attributes, each weighted by the bits of the query's own component, with carry-save adders on whole bitmaps; the
result is a bit-sliced score. The top rows are read off from the most significant slice downward; rows that tie at the
boundary are settled exactly by vec_id.

Queries travel to candidates, not candidates to queries: blocks of BLOCK_QUERIES queries go to every candidate block,
which is shuffled once for each TASK_QUERIES query blocks (its salts) and indexed once there. With n vectors of d
components the shuffle is about n * n / (20 * BLOCK_ROWS) query vectors. A task keeps at most k rows a query and block, and
a second pass merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts

SCALE, TOP_K, QUERY_EVERY = 64, 20, 20
BLOCK_ROWS, BLOCK_QUERIES, TASK_QUERIES = 1 << 16, 128, 512
#: Quantised components beyond this, either way, are taken as this; a score beyond a long as the nearest long.
LIMIT, LONG = 1 << 61, (1 << 63) - 1


class BitSlicedIndex:
    """values: rows of integers. Rows keep their order; bitmaps are uint64 words."""

    def __init__(self, values: np.ndarray):
        self.n, self.dims = values.shape
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        offset = (values - self.low).astype(np.uint64)  # at most 2 * LIMIT
        words = -(-self.n // 64)
        self.full = self._bitmap(np.ones(self.n, bool), words)
        self.slices = []
        for d in range(self.dims):
            bits = int(self.high[d] - self.low[d]).bit_length()
            self.slices.append([self._bitmap((offset[:, d] >> np.uint64(b)) & np.uint64(1) > 0, words) for b in range(bits)])

    @staticmethod
    def _bitmap(flags: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def add(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the non-negative part of sum(weight * value), low bit first, and the constant to add.

        A negative weight takes its attribute's distance from the high end: complemented slices of high - value are
        those of (2**bits - 1) - offset, so both kinds add without borrow.
        """
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, weight in enumerate(weights.tolist()):
            if not weight:
                continue
            slices, size = self.slices[d], abs(weight)
            if weight > 0:
                constant += weight * int(self.low[d])
            else:  # weight * value = weight * low - size * offset; offset = top - complement
                constant += weight * int(self.low[d]) - size * ((1 << len(slices)) - 1)
                slices = [~s for s in slices]
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b, bitmap in enumerate(slices):
                        columns.setdefault(j + b, []).append(bitmap)
        out, at = [], 0
        while columns:
            column = columns.pop(at, [])
            while len(column) > 2:  # full adders: three bitmaps of one weight become a sum and a carry
                n = len(column) // 3
                a, b, c = (np.stack(column[k : 3 * n : 3]) for k in range(3))
                either = a ^ b
                columns.setdefault(at + 1, []).extend((a & b) | (either & c))
                column = column[3 * n :] + list(either ^ c)
            if len(column) == 2:
                a, b = column
                columns.setdefault(at + 1, []).append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.full))
            at += 1
        return out, constant

    def top(self, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the k best rows, ties to smaller ones, best first, and their scores."""
        slices, constant = self.add(weights)
        tied = self.full.copy()
        if without is not None:
            tied[without >> 6] &= ~np.uint64(1 << (without & 63))
        sure = np.zeros_like(tied)
        n_sure, n_tied = 0, int(np.bitwise_count(tied).sum())
        for bitmap in reversed(slices):
            if n_sure + n_tied <= k:
                break
            high = tied & bitmap
            n = int(np.bitwise_count(high).sum())
            if n_sure + n > k:
                tied, n_tied = high, n
            else:
                sure, n_sure = sure | high, n_sure + n
                tied, n_tied = tied & ~bitmap, n_tied - n
        rows = np.concatenate([self._rows(sure), self._rows(tied)[: k - n_sure]])
        wide = len(slices) > 61 or abs(constant) >= 1 << 61  # beyond machine integers: exact ones
        score = np.full(len(rows), constant, object if wide else np.int64)
        at, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for j, bitmap in enumerate(slices):
            own = ((bitmap[at] >> bit) & np.uint64(1)).astype(np.int64)
            score += own.astype(object) * (1 << j) if wide else own << j
        order = np.argsort(-score, kind="stable")
        return rows[order], score[order]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


_BLOCK = pa.schema([("n", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("item", pa.int32())])
BLOCK = "n long, rows binary, ids binary, vectors binary, item int"
_HITS = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.string())])


def _narrow(matrix: np.ndarray) -> np.ndarray:
    most = int(np.abs(matrix).max(initial=0))
    return matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dims, block, vec_id) become one row a block: dims, block, then BLOCK."""
    key, held = None, []
    schema = pa.schema([("dims", pa.int32()), ("block", pa.int64()), *_BLOCK])

    def close() -> pa.RecordBatch:
        rows, ids = (np.concatenate([h[k] for h in held]) for k in range(2))
        matrix = _narrow(np.concatenate([h[2] for h in held]))
        return pa.RecordBatch.from_pylist([{"dims": key[0], "block": key[1], "n": len(ids), "rows": rows.tobytes(), "ids": ids.tobytes(), "vectors": matrix.tobytes(), "item": matrix.itemsize}], schema=schema)

    for batch in batches:
        dims, block, rows, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(dims)
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(dims) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if b > a:
                own = (int(dims[a]), int(block[a]))
                if held and own != key:
                    yield close()
                    held = []
                key = own
                held.append((rows[a:b], ids[a:b], flat[ends[a] - dims[a] : ends[b - 1]].reshape(b - a, -1)))
    if held:
        yield close()


def _cells(k: int):
    """Rows sorted by (dims, block, salt, is_query): dims, block, salt, is_query, then BLOCK. A block comes before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, rows, ids = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["dims"], row["block"], row["salt"])
                matrix = np.frombuffer(row["vectors"], f"i{row['item']}").astype(np.int64).reshape(row["n"], -1)
                numbers, names = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
                if not row["is_query"]:
                    key, index, rows, ids = own, BitSlicedIndex(matrix), numbers, names
                    place = dict(zip(rows.tolist(), range(len(rows))))
                    continue
                if own != key:
                    raise RuntimeError("queries arrived before their block")
                out = []
                for number, query, weights in zip(numbers.tolist(), names.tolist(), matrix):
                    best, scores = index.top(weights, k, place.get(number))
                    exact = [str(x) if abs(x) > LONG else None for x in scores.tolist()]
                    short = [min(max(x, -LONG - 1), LONG) for x in scores.tolist()]
                    out.append((np.full(len(best), number), np.full(len(best), query), ids[best], short, exact))
                columns = [pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([e for o in out for e in o[4]], pa.string())], schema=_HITS)

    return run


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, value array<long>: floor(scale * x), within LIMIT, of rows whose id and components are all present and finite."""
    slim = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = slim.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(F.exists("x", bad), F.lit(True)))
    bound = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))), F.lit(LIMIT)), F.lit(-LIMIT))
    return fine.select("vec_id", F.transform("x", lambda x: bound(x).cast("long")).alias("value"))


def bsi_topk(vectors: DataFrame, k: int = TOP_K, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, task_queries: int = TASK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by every; candidates are all rows but the query's own, also those that
    repeat its id or another's. A query row that repeats an id has results of its own. Vectors that are null, empty or
    hold null or non-finite components, and rows without an id, take no part; a vector meets those of its own length
    only. Components are taken within LIMIT; ranks follow the exact score, which is shown as the nearest long. Fewer
    than k candidates: all of them. An empty table gives an empty result; other columns play no part.
    """
    slim = quantise(vectors, id_col, vector_col).where(F.size("value") > 0).withColumn("dims", F.size("value"))
    rows = durable(slim).withColumn("row", F.monotonically_increasing_id())  # of written rows: the same each time
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    counts = rows.groupBy("dims").agg(blocks(F.count(F.lit(1)), block_rows).alias("n_blocks"), blocks(F.count_if(is_query), block_queries).alias("n_queries"))
    # salts: a candidate block's queries spread over as many tasks as bound a task's work, or as keep the cores busy
    least = F.least(F.col("n_queries"), F.ceil(F.lit(parts(vectors.sparkSession)) / F.col("n_blocks")))
    counts = counts.withColumn("salts", F.greatest(F.ceil(F.col("n_queries") / task_queries), least).cast("int"))
    spread = F.xxhash64("vec_id", "row")
    sized = rows.join(counts, "dims")

    def as_blocks(some: DataFrame, n_blocks: str) -> DataFrame:
        keyed = some.withColumn("block", F.pmod(spread, F.col(n_blocks)))
        placed = keyed.repartition("dims", "block").sortWithinPartitions("dims", "block", "vec_id", "row")
        return placed.select("dims", "block", "row", "vec_id", "value").mapInArrow(_blocks, "dims int, block long, " + BLOCK)

    candidates = as_blocks(sized, "n_blocks").join(counts, "dims").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    queries = as_blocks(sized.where(is_query), "n_queries").join(counts, "dims").withColumn("salt", F.pmod("block", F.col("salts")).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    names = ["dims", "block", "salt", "is_query", *_BLOCK.names]
    both = candidates.withColumn("is_query", F.lit(False)).select(names).unionByName(queries.withColumn("is_query", F.lit(True)).select(names))
    tasks = both.repartition("dims", "block", "salt").sortWithinPartitions("dims", "block", "salt", "is_query")
    hits = tasks.mapInArrow(_cells(k), "query_row long, query_id long, vec_id long, score long, exact string")
    exact = F.coalesce(F.col("exact").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc(exact), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
