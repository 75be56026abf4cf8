"""Near duplicates by circulant MinHash (operator 10).

Two permutations give every signature coordinate: the first permutes (hashes) the shingles onto a ring of 2 ** 32 places,
coordinate k is the smallest value of the second permutation, shifted by k places round the ring, over a document's
places. The second one is computed, not stored, so the ring is wide enough for texts of any length. Bands of ROWS coordinates propose candidates; a Jaccard similarity over full shingle sets confirms each link.

Documents with the same shingle set form one class, and only its smallest id goes on. In each band bucket every member
is compared with the bucket's smallest id, its hub (a star, not all pairs). Buckets whose members are then all in one
component, such as those of a large group of copies, are done. The members of the others are joined exactly by prefix
filtering: with shingles in order of rarity among them, two sets can be linked only if they share one of the rarest
(1 - similarity) * size + 1 of each, so texts that have but boilerplate in common never meet, and no link between the
members of a bucket is lost. A hub with many members is split into salted groups, each with its own copy of the hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Words, durable, id_key, identifier, ids_array, mix, text_chunks

#: Shingle width; percent of op10.
SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 26, 5
#: Members that are compared with one copy of a hub.
SALT_ROWS = 500
#: Hash places that tell wanted texts from others before they are shuffled; bounds a broadcast.
PLACES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than width make one shingle, none make none."""
    words = Words(data, offsets, fold=True)
    grams, out = words.windows(width), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            part = Words.__new__(Words)
            part.hashes = words.hashes[a:b]
            out.append(part.windows(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Circulant:
    """C-MinHash signatures on a ring of 2 ** 32 places."""

    def __init__(self, size: int = BANDS * ROWS):
        self.shifts = np.arange(size, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.shifts), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(places), 512):
            x = places[at : at + 512, None] + self.shifts  # round the ring
            x *= np.uint32(0x9E3779B1)  # the second permutation: odd factors and a shifted sum are bijections
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE3D)
            np.minimum(best, x.min(axis=0), out=best)
        return best


_SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circulant = Circulant()
    seeds = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for batch in batches:
        ids, marks = ids_array(batch.column(0)), batch.column(2)
        for a, b, data, offsets in text_chunks(batch.column(1)):
            sizes, keys, bands = [], [], []
            for shingles in shingle_sets(data, offsets):
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(None)
                    bands.append([])
                    continue
                keys.append(class_key(shingles))
                value = seeds.copy()
                for column in circulant.signature(shingles).reshape(BANDS, ROWS).T:
                    value = mix(value ^ column)
                bands.append(value.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), marks.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)


_CHECKED = pa.schema([("hub", pa.int64()), ("member", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])


def class_key(shingles: np.ndarray) -> int:
    """64 bits of a hash of the whole set: the class of documents that share it."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, is_member): the hub's text comes before those it is compared with.

    A row whose text is not that of its class is passed over.
    """
    group, base = None, np.zeros(0, np.uint64)
    for batch in batches:
        hubs, salts, members = (batch.column(k).to_pylist() for k in range(3))
        for a, b, data, offsets in text_chunks(batch.column(3)):
            out = []
            for k, shingles in zip(range(a, b), shingle_sets(data, offsets)):
                if class_key(shingles) != members[k]:
                    continue
                if hubs[k] == members[k]:
                    group, base = (hubs[k], salts[k]), shingles
                    continue
                if group != (hubs[k], salts[k]):
                    raise RuntimeError("a member arrived before its hub")
                total = len(np.union1d(base, shingles))
                out.append((hubs[k], members[k], len(base) + len(shingles) - total, total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], schema=_CHECKED)


def _compare(pairs: DataFrame, slim: DataFrame, leaders: DataFrame) -> DataFrame:
    """hub, member, shared, total of each distinct pair of class keys."""
    salt = F.pmod(F.xxhash64("member"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)))
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(sizes, "hub").select("hub", "member", salt.cast("int").alias("salt"))
    rows = salted.unionByName(salted.select("hub", F.col("hub").alias("member"), "salt").distinct())
    with_text = _texts(rows, slim, leaders).select("hub", "salt", "member", "text")
    placed = with_text.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("hub") != F.col("member"))
    return placed.mapInArrow(_verify, "hub long, member long, shared long, total long").distinct()


_SHINGLES = pa.schema([("key", pa.int64()), ("shingle", pa.int64())])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each class: columns in are key, text."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for a, b, data, offsets in text_chunks(batch.column(1)):
            for key, shingles in zip(keys[a:b], shingle_sets(data, offsets)):
                if class_key(shingles) == key:
                    for at in range(0, len(shingles), 1 << 16):
                        own = shingles[at : at + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key), pa.int64()), pa.array(own, pa.int64())], schema=_SHINGLES)


def _texts(keys: DataFrame, slim: DataFrame, leaders: DataFrame) -> DataFrame:
    """keys(member, ...) with the text of a document of each class; rows that repeat id and text are one here."""
    rows = keys.join(leaders.select(F.col("key").alias("member"), "doc_id", "mark"), "member")
    wanted = rows.select("doc_id", "mark").distinct()
    place = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(PLACES))
    # most other texts stay out of the shuffle; PLACES numbers are the most that this broadcast can hold
    near = slim.select(id_key().alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text").withColumn("place", place)
    near = near.join(F.broadcast(wanted.select(place.alias("place")).distinct()), "place", "left_semi").drop("place")
    texts = near.join(wanted, ["doc_id", "mark"], "left_semi")
    return rows.join(texts.dropDuplicates(["doc_id", "mark"]), ["doc_id", "mark"])


def _rest(held: DataFrame, roots: DataFrame, slim: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of buckets that several components meet in, from different components, that may be linked."""
    others = held.where("key != hub").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = others.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    open_ = durable(others.join(mixed, "bucket", "left_semi").select(F.col("key").alias("member"), "root", "n_shingles").distinct())
    spread = durable(_texts(open_, slim, leaders).select("member", "text").mapInArrow(_spread, "key long, shingle long"))
    shared = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    known = spread.join(shared, "shingle").join(open_.select(F.col("member").alias("key"), "root", "n_shingles"), "key")
    # the rarest come first: those of one set alone, then the shared ones by count
    alone = F.col("n_shingles") - F.count(F.lit(1)).over(Window.partitionBy("key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("f", "shingle"))
    least = F.floor((percent * F.col("n_shingles") + 99) / 100)  # shared shingles that a link takes at least
    prefix = durable(known.withColumn("place", alone + place).where(F.col("place") <= F.col("n_shingles") - least + 1).select("shingle", "key", "root", "n_shingles"))
    left, right = prefix.alias("l"), prefix.alias("r")
    fits = 100 * F.least("l.n_shingles", "r.n_shingles") >= percent * F.greatest("l.n_shingles", "r.n_shingles")
    both = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.key") < F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
    return left.join(right, both & fits).select(F.col("l.key").alias("hub"), F.col("r.key").alias("member")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """key, root: the smallest key reachable; edges has columns a, b. Large-star and small-star contraction."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        edges, before = durable(small), now
        now = state(edges)
        if now == before:  # the same edges, by count and checksum
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))


def text_mark(text: Column) -> Column:
    """64 bits of a hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id (null as NULL_ID), mark, n_shingles, root, component_id; one row per input row.

    root names a component, as component_id does not where texts share a doc_id; it is null without shingles.
    """
    spark = docs.sparkSession
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    marked = slim.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    signed = durable(marked.mapInArrow(_sign, "doc_id long, mark long, n_shingles long, key long, bands array<long>"))
    keyed = signed.select("doc_id", "mark", "n_shingles", "key")
    some = signed.where("key is not null")
    leaders = durable(some.groupBy("key").agg(F.min_by(F.struct("doc_id", "mark", "n_shingles", "bands"), F.struct("doc_id", "mark")).alias("s")).select("key", "s.*"))
    members = leaders.select("key", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = durable(members.join(hubs, "bucket"))
    stars = held.where("key != hub").select("hub", F.col("key").alias("member")).distinct()
    checked = durable(_compare(durable(stars), slim, leaders))
    sure = checked.where(f"100 * shared >= {percent} * total")
    roots = components(spark, sure.select(F.col("hub").alias("a"), F.col("member").alias("b")))
    rest = durable(_rest(held, roots, slim, leaders, percent))
    if not rest.isEmpty():
        more = durable(_compare(rest, slim, leaders)).where(f"100 * shared >= {percent} * total")
        edges = sure.unionByName(more).select(F.col("hub").alias("a"), F.col("member").alias("b"))
        roots = components(spark, edges)
    placed = leaders.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    owner = placed.join(smallest, "root").select("key", "root", "component_id")
    out = keyed.join(owner, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row.

    A document's set holds its distinct 5-word shingles after A-Z became lower case; with fewer words the whole
    sequence is the one shingle; a null, empty or blank text has none and is linked with nothing, so it is kept. Links
    need 100 * intersection >= percent * union of the full sets. component_id is the smallest doc_id reachable; a null
    doc_id is larger than any other. Repeated rows share set and component; each row with doc_id = component_id is
    kept. An empty table gives an empty result; other columns play no part.
    """
    null = F.lit(NULL_ID)
    out = linked(docs, id_col, text_col, percent)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component_id", null).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_owners(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id (null as NULL_ID), mark, n: the row that stays of each component, the smallest by doc_id, then by mark.

    n rows share its id and text, and one of them is to stay. Texts without shingles all stay, so their n is 1.
    """
    rows = linked(docs, percent=percent).groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark", "n")).alias("s")).select("s.*")
    return first.unionByName(rows.where("root is null").select("doc_id", "mark", F.lit(1).cast("long").alias("n")))
