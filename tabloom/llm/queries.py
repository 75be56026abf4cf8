"""The operators of this subpackage as queries over the provided tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bsi_topk import bsi_topk
from .common import table
from .edit_counts import edit_counts
from .exact_dedup import exact_dedup
from .minhash import near_dedup
from .mixing import curriculum
from .packing import pack
from .pseudonyms import pseudonymise
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .weak_quality import weak_quality

PSEUDONYM_KEY = "demonstration key, replace in production"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi_topk(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a word put into its middle, ten characters cut a third in, its start replaced."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda at, delete, insert: F.struct(at.alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    edits = F.array(edit(F.floor(n / 2), 0, " inserted"), edit(F.floor(n / 3), 10, ""), edit(F.lit(0).cast("long"), 3, "A new start"))
    return edit_counts(table(spark, sf_dir, "documents"), edits)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_weak_quality, op3_pseudonyms, op4_bsi_topk, op5_exact_dedup, op6_packing, op7_edit_counts, op8_substring_dedup, op9_mixing, op10_minhash)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP4 = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.row <> b.row AND len(a.q) = len(b.q)
), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP5 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

_OP8 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM g) WHERE first_id < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS body, count(*) AS n FROM x ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP9 = f"""
WITH d AS (
    SELECT doc_id, CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents
), s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
l AS (
    SELECT *, most / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (SELECT k, source_size, (row_number() OVER (ORDER BY k) - 1) % 3 * 0.5::DOUBLE - 0.5::DOUBLE AS slope, least(CAST(most AS DOUBLE), coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0.0) * weight) AS target FROM l),
b AS (
    SELECT d.*, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY k ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM d JOIN t USING (k)
), m AS (
    SELECT *, CAST(whole + CASE WHEN whole < 3 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies,
        least(1.0::DOUBLE, CASE WHEN target = 0 THEN 0.0::DOUBLE ELSE CAST(before + size / 2 AS DOUBLE) / target END) AS u FROM b
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
    CASE WHEN 1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * u) = 0 THEN 0.0::DOUBLE ELSE 2 * u / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END AS position
FROM m
"""

_OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
g AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT u.y AS a, r.c FROM r JOIN u ON u.x = r.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_bsi_topk": _OP4, "op5_exact_dedup": _OP5, "op8_substring_dedup": _OP8, "op9_mixing": _OP9, "op10_minhash": _OP10}
