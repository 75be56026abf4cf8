"""Mixing sources to target weights as a time-varying curriculum (operator 9). DataFrame functions only.

Targets: sources share all words by weight; what exceeds REPEATS times a source's size is shared again by weight
(water-filling, solved in closed form over the sorted ratios of the small table of sources).

Within a source, documents stand in the order of a keyed hash. A source may hold a third of all rows, so prefix sums
take two levels: sizes are pre-aggregated by (source, hash bucket), a window over the BUCKETS rows of a source gives
each bucket's start, and a second window runs inside one bucket only.

A source's weight over training time t in [0, 1] is 1 + slope * (2 t - 1); its integral t + slope * (t * t - t) times the
source's taken words is its cumulative demand, whose inverse at a document's place gives the training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD_RE, durable, identifier

REPEATS = 3
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _mark(text: Column) -> Column:
    """64 bits of a hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes: source_key, source_size. Adds index, weight, target."""
    ordered = sizes.withColumn("index", F.row_number().over(Window.orderBy("source_key")) - 1)
    weighted = ordered.withColumn("weight", (F.col("index") % 3 + 1).cast("long"))
    most = weighted.withColumn("most", F.lit(repeats) * F.col("source_size"))
    ratio = most.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "source_key")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - before) / left
    levels = ratio.withColumn("level", level)
    right = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    filled = levels.withColumn("level", F.coalesce(F.min(right).over(everything)["level"], F.lit(0.0)))
    return filled.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).select("source_key", "source_size", "index", "weight", "target")


def order_key(doc_id: Column) -> Column:
    """60 bits of a hash, the same on every engine with md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position; one row per input row.

    size is the number of words; a null text has none. A null source is one more source, after all others. Each row is
    taken floor(target / source_size) times, and once more while the source's running size, to the middle of the row,
    is within what is then left of the target: a source's taken words differ from its target by half a document at
    most. Rows are whole, none is taken more than three times. position is where in training, from 0 to 1, the first
    copy stands; copy j stands at position_at(...) of its own place. Rows that repeat a doc_id are rows of their own;
    equal ones may swap places. Without words every target is 0. An empty table gives an empty result; other columns
    play no part.
    """
    key = F.when(docs[source_col].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source_col].cast("string")))
    slim = docs.select(identifier(docs, id_col), word_count(docs[text_col].cast("string")).alias("size"), key.alias("source_key"), order_key(docs[id_col].cast("long")).alias("place"), _mark(docs[text_col]).alias("mark"))
    slim = durable(slim.withColumn("bucket", F.shiftright("place", 48)))  # words are counted once
    buckets = slim.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes)
    run = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)).alias("bucket_start"))
    facts = starts.join(targets, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.join(facts, ["source_key", "bucket"])
    rows = rows.withColumn("before", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole)
    more = F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("copies", F.col("whole") + F.when(more & (F.col("whole") < REPEATS), 1).otherwise(0))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("index") % len(slopes) + 1).cast("int"))
    rows = rows.withColumn("slope", slope).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.withColumn("position", position_at(F.col("before") + F.col("size") / 2, F.col("target"), F.col("slope"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "source_key", "place", "before", "slope", "mark")


def position_at(place: Column, demand: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand reaches place; inverse of t + slope * (t * t - t)."""
    u = F.least(F.lit(1.0), F.coalesce(F.try_divide(place, demand), F.lit(0.0)))
    return F.coalesce(F.try_divide(2 * u, (1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)), F.lit(0.0))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """mixture(), range-sorted by training position, then by doc_id."""
    return mixture(docs, id_col, text_col, source_col).orderBy("position", "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, all columns, range-sorted by training position.

    Rows are matched to their decision by (id, source, hash of the text), so that rows repeating an id keep their own; of
    rows equal in all three the first by the columns that have an order get what does not divide. Nulls, empty texts
    and empty tables are as in mixture(); columns may have any type. The join and the numbering of equal rows ask for
    the same partitioning, so texts are shuffled once for both and once for the sort; words are counted by mixture() alone.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    taken = mixture(docs, id_col, text_col, source_col)
    keyed = docs.toDF(*names)
    column = dict(zip(docs.columns, names))
    key = F.when(F.col(column[source_col]).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column[source_col]).cast("string")))
    known = lambda c: F.coalesce(c.cast("long"), F.lit(NULL_ID))
    keyed = keyed.withColumns({"_id": known(F.col(column[id_col])), "_source": key, "_mark": _mark(F.col(column[text_col]))})
    # rows equal in all three have one decision each; spread the copies over them as one total
    facts = [F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("size", "source_size", "target", "slope")), F.min("before").alias("before")]
    totals = taken.groupBy(known(F.col("doc_id")).alias("_id"), F.col("source_key").alias("_source"), F.col("mark").alias("_mark")).agg(*facts)
    joined = keyed.join(totals, ["_id", "_source", "_mark"])
    ordered = [n for n, field in zip(names, docs.schema) if not any(t in field.dataType.simpleString() for t in ("map<", "variant"))]
    twin = F.row_number().over(Window.partitionBy("_id", "_source", "_mark").orderBy("before", *ordered))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(F.when(F.col("rows") > 1, twin).otherwise(1) <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    repeated = joined.withColumn("own", own.cast("int")).where("own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    place = F.col("before") + F.col("size") / 2 + F.col("_copy") * F.col("source_size")
    placed = repeated.withColumn("_position", position_at(place, F.col("target"), F.col("slope")))
    return placed.orderBy("_position", "_id", "_copy").select(*names).toDF(*docs.columns)
