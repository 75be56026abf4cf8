"""Queries over the provided tables, one per operator, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import autotype, paths, scalars, trees
from .operators import cells, conditions, filters, pivots, totals
from .operators.filters import DateFilter, Item, ItemSet, Node
from .plans import flatten, infer
from .sinks import text as sinks
from .sources import csv as csv_source
from .sources import detect as detection

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF = date(1998, 5, 17)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _filter(name: str, table: str, columns: str, field: str, tree: Callable[[int], object], where: str) -> None:
    """A filter over the listed columns of a table; field is the filtered one."""
    names = columns.split()

    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.apply(_t(spark, d, table).select(*names), tree(names.index(field)))

    _add(name, run, f"SELECT {', '.join(names)} FROM {table} {where}")


# comparisons
for _name, _op, _sql in (("eq", "equal", "="), ("gt", "greater", ">"), ("ge", "greater_equal", ">="), ("lt", "less", "<"), ("le", "less_equal", "<=")):
    _filter(f"filter_cmp_{_name}", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity", lambda k, op=_op: Item(k, op, 25.0), f"WHERE l_quantity {_sql} 25")
_filter("filter_cmp_ne", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity", lambda k: Item(k, "not_equal", 25.0), "WHERE l_quantity IS NULL OR l_quantity <> 25")
# text
for _name, _op, _fn in (("contain", "contain", "contains"), ("begin", "begin_with", "starts_with"), ("end", "end_with", "ends_with")):
    _word = "#0000001" if _name == "contain" else "Customer#0000" if _name == "begin" else "7"
    _filter(f"filter_text_{_name}", "customer", "c_custkey c_name", "c_name", lambda k, op=_op, w=_word: Item(k, op, w), f"WHERE {_fn}(c_name, '{_word}')")
    _filter(f"filter_text_not_{_name}", "customer", "c_custkey c_name", "c_name", lambda k, op=_op, w=_word: Item(k, f"not_{op}", w), f"WHERE c_name IS NULL OR NOT {_fn}(c_name, '{_word}')")
_filter("filter_text_regex", "customer", "c_custkey c_name", "c_name", lambda k: Item(k, "equal", ".*0[0-4]", True), "WHERE regexp_full_match(c_name, '.*0[0-4]')")


def _wild(pattern: str, op: str = "equal") -> Callable[[int], Item]:
    def make(k: int) -> Item:
        new, value, regex = filters.rewrite_wildcard(op, pattern)
        return Item(k, new, value, regex)

    return make


_filter("filter_wildcard", "part", "p_partkey p_name", "p_name", _wild("*e? *r*"), "WHERE regexp_full_match(p_name, '.*e. .*r.*')")
_filter("filter_wildcard_begin", "part", "p_partkey p_name", "p_name", _wild("b*"), "WHERE starts_with(p_name, 'b')")
_filter("filter_wildcard_not_contain", "part", "p_partkey p_name", "p_name", _wild("*re*", "not_equal"), "WHERE p_name IS NULL OR NOT contains(p_name, 're')")
_filter("filter_in_set", "orders", "o_orderkey o_orderpriority", "o_orderpriority", lambda k: ItemSet(k, ("1-URGENT", "5-LOW")), "WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
_filter("filter_and_or_tree", "lineitem", "l_orderkey l_linenumber l_quantity l_discount l_returnflag", "l_quantity", lambda k: Node("and", (Node("or", (Item(k, "less", 5.0), Item(k, "greater", 45.0))), Item(k + 2, "equal", "R"), Item(k + 1, "greater_equal", 0.05))), "WHERE (l_quantity < 5 OR l_quantity > 45) AND l_returnflag = 'R' AND l_discount >= 0.05")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return docs.join(_t(spark, d, "labels").select("doc_id", "quality"), F.col("id") == F.col("doc_id"), "left").select("id", "lang", F.col("quality").cast("double").alias("quality"))


_LABELLED = "SELECT d.doc_id AS id, lang, CAST(quality AS DOUBLE) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_add("filter_blank", lambda s, d: filters.apply(_labelled(s, d), Item(2, "empty")), f"{_LABELLED} WHERE quality IS NULL")
_add("filter_nonblank", lambda s, d: filters.apply(_labelled(s, d), Item(2, "not_empty")), f"{_LABELLED} WHERE quality IS NOT NULL")
_add("filter_set_with_blank", lambda s, d: filters.apply(_labelled(s, d), ItemSet(2, (0.0,), True)), f"{_LABELLED} WHERE quality IS NULL OR quality = 0")
# ranks
for _name, _order in (("top", "DESC"), ("bottom", "ASC")):
    _filter(f"filter_{_name}_n", "customer", "c_custkey c_acctbal", "c_acctbal", lambda k, n=_name: Item(k, n, 25), f"QUALIFY rank() OVER (ORDER BY c_acctbal {_order}) <= 25")
    _filter(f"filter_{_name}_percent", "supplier", "s_suppkey s_acctbal", "s_acctbal", lambda k, n=_name: Item(k, f"{n}_percent", 15), f"QUALIFY rank() OVER (ORDER BY s_acctbal {_order}) <= ceil(count(s_acctbal) OVER () * 0.15)")
_filter("filter_top_range", "part", "p_partkey p_retailprice", "p_retailprice", lambda k: Item(k, "top_percent_range", 10), "QUALIFY p_retailprice >= max(p_retailprice) OVER () - (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 0.1")
_filter("filter_bottom_range", "part", "p_partkey p_retailprice", "p_retailprice", lambda k: Item(k, "bottom_percent_range", 10), "QUALIFY p_retailprice <= min(p_retailprice) OVER () + (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 0.1")
_filter("filter_above_avg", "orders", "o_orderkey o_totalprice", "o_totalprice", lambda k: Item(k, "above_average"), "WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_filter("filter_below_avg", "orders", "o_orderkey o_totalprice", "o_totalprice", lambda k: Item(k, "below_average"), "WHERE o_totalprice < (SELECT avg(o_totalprice) FROM orders)")
_filter("filter_ranked_tree", "supplier", "s_suppkey s_acctbal", "s_acctbal", lambda k: Node("or", (Item(k, "top", 5), Item(k, "bottom", 5))), "QUALIFY rank() OVER (ORDER BY s_acctbal DESC) <= 5 OR rank() OVER (ORDER BY s_acctbal) <= 5")
# dynamic dates
for _name in ("today", "yesterday", "tomorrow", "this_week", "last_week", "next_week", "this_month", "last_month", "next_month", "this_quarter", "last_quarter", "next_quarter", "this_year", "last_year", "next_year", "year_to_date"):
    _a, _b = filters.period(_name, AS_OF)
    _filter(f"filter_date_{_name}", "orders", "o_orderkey o_orderdate", "o_orderdate", lambda k, n=_name: DateFilter(k, n, AS_OF), f"WHERE CAST(o_orderdate AS DATE) >= DATE '{_a}' AND CAST(o_orderdate AS DATE) < DATE '{_b}'")
_filter("filter_date_q3", "orders", "o_orderkey o_orderdate", "o_orderdate", lambda k: DateFilter(k, "Q3"), "WHERE quarter(o_orderdate) = 3")
_filter("filter_date_m11", "orders", "o_orderkey o_orderdate", "o_orderdate", lambda k: DateFilter(k, "M11"), "WHERE month(o_orderdate) = 11")
_add("page_filter", lambda s, d: pivots.page_filter(_t(s, d, "orders"), "o_orderstatus", "F").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
_add("hidden_items", lambda s, d: pivots.hide_items(_t(s, d, "orders"), "o_orderpriority", ["5-LOW"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")

# conditional rules
_part = lambda s, d: _t(s, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_type")
for _rule, _sql in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    _add(f"cond_{_rule}", lambda s, d, r=_rule: _part(s, d).select("p_partkey", conditions.simple_rule(F.col("p_size"), r, 25).alias("flag")), f"SELECT p_partkey, p_size {_sql} 25 AS flag FROM part")
_add("cond_between", lambda s, d: _part(s, d).select("p_partkey", conditions.between(F.col("p_size"), 10, 20).alias("flag")), "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS flag FROM part")
_add("cond_not_between", lambda s, d: _part(s, d).select("p_partkey", conditions.between(F.col("p_size"), 10, 20, True).alias("flag")), "SELECT p_partkey, NOT p_size BETWEEN 10 AND 20 AS flag FROM part")
_add("cond_duplicate", lambda s, d: conditions.duplicate(_part(s, d).select("p_partkey", "p_retailprice"), "p_retailprice"), "SELECT p_partkey, p_retailprice, count(*) OVER (PARTITION BY p_retailprice) > 1 AS flag FROM part")
_add("cond_unique", lambda s, d: conditions.duplicate(_part(s, d).select("p_partkey", "p_retailprice"), "p_retailprice", unique=True), "SELECT p_partkey, p_retailprice, count(*) OVER (PARTITION BY p_retailprice) = 1 AS flag FROM part")
for _low, _name in ((False, "top"), (True, "bottom")):
    _order = "" if _low else "DESC"
    _add(f"cond_{_name}_n", lambda s, d, b=_low: conditions.top_bottom(_part(s, d).select("p_partkey", "p_retailprice"), "p_retailprice", 10, b), f"SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice {_order}) <= 10 AS flag FROM part")
    _add(f"cond_{_name}_percent", lambda s, d, b=_low: conditions.top_bottom(_part(s, d).select("p_partkey", "p_retailprice"), "p_retailprice", 10, b, True), f"SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice {_order}) <= ceil(count(*) OVER () * 0.1) AS flag FROM part")
for _name, _above, _equal, _sql in (("above_avg", True, False, ">"), ("below_avg", False, False, "<"), ("above_equal_avg", True, True, ">="), ("below_equal_avg", False, True, "<=")):
    _add(f"cond_{_name}", lambda s, d, a=_above, e=_equal: conditions.average(_part(s, d).select("p_partkey", "p_size"), "p_size", a, e), f"SELECT p_partkey, p_size, p_size {_sql} avg(p_size) OVER () AS flag FROM part")
_add("cond_above_stddev", lambda s, d: conditions.average(_part(s, d).select("p_partkey", "p_size"), "p_size", True, False, 1.0), "SELECT p_partkey, p_size, p_size > avg(p_size) OVER () + stddev_pop(p_size) OVER () AS flag FROM part")
for _rule, _fn, _w in (("begins_with", "starts_with", "b"), ("ends_with", "ends_with", "e"), ("contains", "contains", "re")):
    _add(f"cond_{_rule}", lambda s, d, r=_rule, w=_w: _part(s, d).select("p_partkey", conditions.simple_rule(F.col("p_name"), r, w, False).alias("flag")), f"SELECT p_partkey, {_fn}(p_name, '{_w}') AS flag FROM part")
_add("cond_not_contains", lambda s, d: _part(s, d).select("p_partkey", conditions.simple_rule(F.col("p_name"), "not_contains", "re", False).alias("flag")), "SELECT p_partkey, NOT contains(p_name, 're') AS flag FROM part")
_add("cond_contains_blanks", lambda s, d: _labelled(s, d).select("id", conditions.simple_rule(F.col("quality"), "contains_blanks").alias("flag")), "SELECT d.doc_id AS id, quality IS NULL AS flag FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("cond_contains_error", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", conditions.contains_error(F.when(F.col("l_discount") == 0, "#DIV/0!")).alias("flag")), "SELECT l_orderkey, l_linenumber, l_discount = 0 AS flag FROM lineitem")
_add("cond_contains_no_error", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", conditions.contains_error(F.when(F.col("l_discount") == 0, "#DIV/0!"), True).alias("flag")), "SELECT l_orderkey, l_linenumber, l_discount <> 0 AS flag FROM lineitem")
_add("cond_expression", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", conditions.expression("l_quantity * l_discount > 2").alias("flag")), "SELECT l_orderkey, l_linenumber, l_quantity * l_discount > 2 AS flag FROM lineitem")
for _rule in conditions.DATE_RULES:
    _a, _b = filters.period(_rule, AS_OF)
    _add(f"cond_date_{_rule}", lambda s, d, r=_rule: _t(s, d, "orders").select("o_orderkey", conditions.date_rule(F.col("o_orderdate"), r, AS_OF).alias("flag")), f"SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '{_a}' AND CAST(o_orderdate AS DATE) < DATE '{_b}' AS flag FROM orders")
_add(
    "cond_colorscale",
    lambda s, d: conditions.colour_scale(_part(s, d).select("p_partkey", "p_size"), "p_size", [("min", None), ("max", None)], [(255, 0, 0), (0, 0, 255)]),
    "WITH x AS (SELECT p_partkey, p_size, (CAST(p_size AS DOUBLE) - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS k FROM part) "
    "SELECT p_partkey, p_size, printf('%02x', CAST(floor(255 - 255 * k + 0.5) AS INT)) || '00' || printf('%02x', CAST(floor(255 * k + 0.5) AS INT)) AS colour FROM x",
)
_add("cond_databar", lambda s, d: conditions.data_bar(_part(s, d).select("p_partkey", "p_size"), "p_size").withColumn("bar", F.round("bar", 6)), "SELECT p_partkey, p_size, round(10 + 80 * (CAST(p_size AS DOUBLE) - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS bar FROM part")
_add("cond_iconset", lambda s, d: conditions.icon_set(_part(s, d).select("p_partkey", "p_size"), "p_size", [("percent", 0), ("percent", 33), ("percent", 67)]), "WITH x AS (SELECT *, min(p_size) OVER () AS a, max(p_size) OVER () AS b FROM part) SELECT p_partkey, p_size, CAST(1 + CAST(p_size >= a + (b - a) * (33 / 100) AS INT) + CAST(p_size >= a + (b - a) * (67 / 100) AS INT) AS INT) AS icon FROM x")

# totals and pivots
_SQL_AGG = {"sum": "sum({})", "min": "min({})", "minimum": "min({})", "max": "max({})", "maximum": "max({})", "average": "avg({})", "count": "count({})", "count_numbers": "count({})", "standard_deviation": "stddev_samp({})", "stddev": "stddev_samp({})", "stddevp": "stddev_pop({})", "variance": "var_samp({})", "var": "var_samp({})", "varp": "var_pop({})", "product": "product({})"}
for _fn in ("sum", "minimum", "maximum", "average", "count", "count_numbers", "standard_deviation", "variance"):
    _add(f"totals_{_fn}", lambda s, d, f=_fn: _t(s, d, "lineitem").agg(F.round(totals.aggregate(f, "l_quantity"), 4).alias("total") if f not in ("count", "count_numbers") else totals.aggregate(f, "l_quantity").alias("total")), f"SELECT {'round(' + _SQL_AGG[_fn].format('l_quantity') + ', 4)' if not _fn.startswith('count') else _SQL_AGG[_fn].format('l_quantity')} AS total FROM lineitem")
_add("totals_none_label", lambda s, d: totals.totals(_t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_regionkey": "sum", "n_nationkey": "none"}, {"n_name": "Total"}), "SELECT CAST(NULL AS INT) AS n_nationkey, 'Total' AS n_name, CAST(sum(n_regionkey) AS BIGINT) AS n_regionkey FROM nation")
_add("totals_custom", lambda s, d: totals.totals(_t(s, d, "nation").select("n_name", "n_regionkey"), {"n_regionkey": F.count_distinct("n_regionkey")}), "SELECT CAST(NULL AS VARCHAR) AS n_name, count(DISTINCT n_regionkey) AS n_regionkey FROM nation")
_add("totals_row", lambda s, d: totals.with_totals(_t(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {"s_acctbal": "sum", "s_suppkey": "count"}, {"s_name": "Total"}).withColumn("s_acctbal", F.round("s_acctbal", 2)), "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, false AS is_total FROM supplier UNION ALL SELECT count(s_suppkey), 'Total', round(sum(s_acctbal), 2), true FROM supplier")
for _fn in ("average", "count", "count_numbers", "max", "min", "stddev", "stddevp", "sum", "var", "varp"):
    _q = _SQL_AGG[_fn].format("l_quantity")
    _add(f"pivot_{_fn}", lambda s, d, f=_fn: pivots.evaluate(_t(s, d, "lineitem"), pivots.Pivot(("l_returnflag",), (), (pivots.DataField("l_quantity", f, "v"),))).withColumn("v", F.round("v", 4)), f"SELECT l_returnflag, round({_q}, 4) AS v FROM lineitem GROUP BY 1" if not _fn.startswith("count") else f"SELECT l_returnflag, {_q} AS v FROM lineitem GROUP BY 1")
_add("pivot_product", lambda s, d: pivots.evaluate(_t(s, d, "lineitem").withColumn("f", 1 + F.col("l_discount")), pivots.Pivot(("l_orderkey",), (), (pivots.DataField("f", "product", "v"),))).withColumn("v", F.round("v", 6)), "SELECT l_orderkey, round(product(1 + l_discount), 6) AS v FROM lineitem GROUP BY 1")
_add("pivot_row_col", lambda s, d: pivots.evaluate(_t(s, d, "lineitem"), pivots.Pivot(("l_returnflag",), ("l_linestatus",), (pivots.DataField("l_quantity", "sum"),)), ["F", "O"]), "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
_add("pivot_two_data_fields", lambda s, d: pivots.evaluate(_t(s, d, "lineitem"), pivots.Pivot(("l_returnflag",), ("l_linestatus",), (pivots.DataField("l_quantity", "sum", "q"), pivots.DataField("l_quantity", "count", "n"))), ["F", "O"]), "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F_q\", count(l_quantity) FILTER (l_linestatus = 'F') AS \"F_n\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O_q\", count(l_quantity) FILTER (l_linestatus = 'O') AS \"O_n\" FROM lineitem GROUP BY 1")


def _geo(s: SparkSession, d: str) -> DataFrame:
    n = F.broadcast(_t(s, d, "nation").join(F.broadcast(_t(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows at any scale
    return _t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


_add("pivot_subtotals", lambda s, d: pivots.subtotals(_geo(s, d), ["r_name", "n_name", "c_mktsegment"], [pivots.DataField("c_acctbal", "sum", "total")]).withColumn("total", F.round("total", 2)), "SELECT r_name, n_name, c_mktsegment, round(sum(c_acctbal), 2) AS total, CAST(bit_count(GROUPING(r_name, n_name, c_mktsegment)) AS INT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
_add("pivot_range_group", lambda s, d: _t(s, d, "orders").groupBy(pivots.range_group(F.col("o_totalprice"), 50000, 250000, 25000).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN o_totalprice < 50000 THEN '<50000.0' WHEN o_totalprice >= 250000 THEN '>=250000.0' ELSE CAST(CAST(50000 + floor((o_totalprice - 50000) / 25000) * 25000 AS DOUBLE) AS VARCHAR) END AS bucket, count(*) AS n FROM orders GROUP BY 1")
for _name, _sql in (("seconds", "second"), ("minutes", "minute"), ("hours", "hour"), ("days", "dayofyear"), ("months", "month"), ("quarters", "quarter"), ("years", "year")):
    _add(f"pivot_date_group_{_name}", lambda s, d, n=_name: _t(s, d, "events").groupBy(pivots.date_group(F.col("ts"), n).alias("part")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CAST({_sql}(ts) AS INT) AS part, count(*) AS n FROM events GROUP BY 1")
_add("pivot_discrete_group", lambda s, d: _t(s, d, "orders").groupBy(pivots.discrete_group(F.col("o_orderpriority"), {"high": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]}).alias("grp")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS grp, count(*) AS n FROM orders GROUP BY 1")
_add("pivot_cache_items", lambda s, d: pivots.cache_items(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]), " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS item, count(*) AS n, {'true' if c == 'l_linenumber' else 'false'} AS is_number FROM lineitem GROUP BY 2" for c in ("l_returnflag", "l_linestatus", "l_linenumber")))


def _years(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.sum("o_totalprice").alias("v"))


_YEARS = "WITH t AS (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT y, p, round(v, 2) AS v, round({}, 6) AS shown FROM t"
for _kind, _name, _sql, _base in (
    ("normal", "normal", "v", None), ("percent_of_total", "pct_total", "v / sum(v) OVER ()", None), ("percent_of_row", "pct_row", "v / sum(v) OVER (PARTITION BY y)", None), ("percent_of_col", "pct_col", "v / sum(v) OVER (PARTITION BY p)", None),
    ("run_total", "run_total", "sum(v) OVER (PARTITION BY p ORDER BY y ROWS UNBOUNDED PRECEDING)", None), ("difference", "difference", "v - max(CASE WHEN y = 1996 THEN v END) OVER (PARTITION BY p)", 1996), ("difference", "difference_previous", "v - lag(v) OVER (PARTITION BY p ORDER BY y)", "previous"),
    ("percent", "percent", "v / max(CASE WHEN y = 1996 THEN v END) OVER (PARTITION BY p)", 1996), ("percent_diff", "pct_diff", "(v - max(CASE WHEN y = 1996 THEN v END) OVER (PARTITION BY p)) / max(CASE WHEN y = 1996 THEN v END) OVER (PARTITION BY p)", 1996),
    ("index", "index", "v * sum(v) OVER () / (sum(v) OVER (PARTITION BY y) * sum(v) OVER (PARTITION BY p))", None),
):
    _digits = 2 if _kind in ("normal", "run_total", "difference") else 6
    _add(f"show_{_name}", lambda s, d, k=_kind, b=_base, g=_digits: pivots.show_as(_years(s, d), "v", k, "y", "p", b).withColumn("v", F.round("v", 2)).withColumn("shown", F.round("shown", g)), _YEARS.format(_sql).replace(", 6) AS shown", f", {_digits}) AS shown"))

# cells
_nation = lambda s, d: _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), "n_name", "n_regionkey")
_CELLS = "SELECT 'nation' AS sheet, CAST(n_nationkey AS BIGINT) AS row, 0 AS col, 'string' AS type, n_name AS value FROM nation UNION ALL SELECT 'nation', n_nationkey, 1, 'numeric', CAST(n_regionkey AS VARCHAR) FROM nation"
_add("cells_unpivot", lambda s, d: cells.to_cells(_nation(s, d), "row", "nation"), _CELLS)
_add("cells_pivot", lambda s, d: cells.to_wide(cells.to_cells(_nation(s, d), "row", "nation"), 2, "nation"), "SELECT CAST(n_nationkey AS BIGINT) AS row, n_name AS c0, CAST(n_regionkey AS VARCHAR) AS c1 FROM nation")
_add("row_window", lambda s, d: cells.to_wide(cells.to_cells(_nation(s, d).where("row % 3 = 0"), "row", "nation"), 2, "nation"), "SELECT r AS row, n_name AS c0, CAST(n_regionkey AS VARCHAR) AS c1 FROM range(0, 25) t(r) LEFT JOIN nation ON n_nationkey = r AND r % 3 = 0")
_add("used_range", lambda s, d: cells.used_range(cells.to_cells(_nation(s, d), "row", "nation")), "SELECT 'nation' AS sheet, CAST(max(n_nationkey) AS BIGINT) AS last_row, 1 AS last_col FROM nation")
_add("place_range", lambda s, d: cells.place(cells.to_cells(_nation(s, d), "row", "nation"), 5, 2), f"SELECT sheet, row + 5 AS row, col + 2 AS col, type, value FROM ({_CELLS})")
_add("check_lines", lambda s, d: sinks.check(cells.to_cells(_nation(s, d), "row", "nation")), f"SELECT sheet, row, col, sheet || '/' || row || '/' || col || ':' || type || ':' || CASE WHEN type = 'string' THEN '\"' || value || '\"' ELSE value END AS line FROM ({_CELLS})")
_add("fill_down", lambda s, d: cells.fill_down(_t(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v")), "v", "event_id", ["user_id"]), "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
_add("shared_strings", lambda s, d: cells.shared_strings(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]), "SELECT text, row_number() OVER (ORDER BY text) - 1 AS sid FROM (SELECT l_returnflag AS text FROM lineitem UNION SELECT l_linestatus FROM lineitem)")


def _string_join(s: SparkSession, d: str) -> DataFrame:
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    pool = cells.shared_strings(lines, ["l_returnflag"])
    return lines.join(pool, lines["l_returnflag"] == pool["text"]).select("l_orderkey", "l_linenumber", "sid")


_add("shared_string_lookup", _string_join, "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS sid FROM lineitem")
_parts = lambda s, d: _t(s, d, "part").select((F.col("p_partkey") - F.lit(1)).cast("long").alias("row"), "p_name", "p_size")
_PART = "SELECT CAST(p_partkey - 1 AS BIGINT) AS row, {} FROM part WHERE p_partkey - 1 {}"
_add("tableref_headers", lambda s, d: cells.table_area(_parts(s, d), "row", "headers", 100, 1, 1, ["p_name"]), _PART.format("p_name", "= 0"))
_add("tableref_data", lambda s, d: cells.table_area(_parts(s, d), "row", "data", 100, 1, 1, cells.column_span(["p_name", "p_size"], "p_name", "p_size")), _PART.format("p_name, p_size", "BETWEEN 1 AND 98"))
_add("tableref_totals", lambda s, d: cells.table_area(_parts(s, d), "row", "totals", 100, 1, 1, ["p_size"]), _PART.format("p_size", "= 99"))
_runs = lambda s: s.createDataFrame([("nation", 0, 4, 10.0), ("nation", 5, 9, 12.5)], "sheet string, first long, last long, height double")
_add("row_heights", lambda s, d: cells.in_intervals(cells.to_cells(_nation(s, d), "row", "nation"), _runs(s), "row", "height", 15.0), f"SELECT *, CASE WHEN row <= 4 THEN 10.0::DOUBLE WHEN row <= 9 THEN 12.5::DOUBLE ELSE 15.0::DOUBLE END AS height FROM ({_CELLS})")


def _formats(s: SparkSession, d: str) -> DataFrame:
    own = cells.to_cells(_nation(s, d), "row", "nation").withColumn("xf", F.when(F.col("row") == 0, 9))
    rows = s.createDataFrame([("nation", 0, 3, 2)], "sheet string, first long, last long, xf int")
    columns = s.createDataFrame([("nation", 1, 1, 3)], "sheet string, first long, last long, xf int")
    return cells.effective_format(own, rows, columns).select("row", "col", "effective_xf")


_add("effective_format", _formats, f"SELECT row, col, CASE WHEN row = 0 THEN 9 WHEN row <= 3 THEN 2 WHEN col = 1 THEN 3 ELSE 0 END AS effective_xf FROM ({_CELLS})")
_add("merged_cells", lambda s, d: cells.merged_over(cells.to_cells(_nation(s, d), "row", "nation"), s.createDataFrame([("nation", 2, 0, 4, 1)], "sheet string, first_row long, first_col int, last_row long, last_col int")).select("row", "col", "covered"), f"SELECT row, col, row BETWEEN 2 AND 4 AND NOT (row = 2 AND col = 0) AS covered FROM ({_CELLS})")

# typing and scalars
_props = lambda s, d: _t(s, d, "events").select("event_id", F.explode(F.split(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"), F.lit(".5 5. 007 +1e3 1e NaN -")), " ")).alias("tok"))
_add("autotype_strings", lambda s, d: _props(s, d).select("event_id", "tok", autotype.auto_type(F.col("tok")).alias("kind"), autotype.auto_number(F.col("tok")).alias("num")), "WITH t AS (SELECT event_id, unnest(string_split(concat_ws(' ', event_type, json_extract_string(props, '$.k'), '.5 5. 007 +1e3 1e NaN -'), ' ')) AS tok FROM events) SELECT event_id, tok, CASE WHEN tok = '' THEN 'empty' WHEN regexp_full_match(tok, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'numeric' ELSE 'string' END AS kind, CASE WHEN regexp_full_match(tok, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(ltrim(tok, '+') AS DOUBLE) END AS num FROM t")
_add("autotype_documents", lambda s, d: _t(s, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("tok")).groupBy("doc_id").agg(F.count_if(autotype.is_number(F.col("tok"))).alias("numbers"), F.count(F.lit(1)).alias("tokens")), "WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok FROM documents) SELECT doc_id, count(*) FILTER (regexp_full_match(tok, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS numbers, count(*) AS tokens FROM t GROUP BY 1")
_add("date_serial", lambda s, d: _t(s, d, "events").select("event_id", F.round(scalars.date_serial(F.col("ts")), 8).alias("serial")), "SELECT event_id, round(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400, 8) AS serial FROM events")
_add("serial_date", lambda s, d: _t(s, d, "orders").select("o_orderkey", scalars.serial_date(F.lit(35000) + F.col("o_orderkey") % 1000 + F.lit(0.25)).alias("at")), "SELECT o_orderkey, TIMESTAMP '1899-12-30 06:00:00' + to_days(CAST(35000 + o_orderkey % 1000 AS INT)) AS at FROM orders")
_add("unit_convert", lambda s, d: _t(s, d, "part").select("p_partkey", *(F.round(scalars.convert(F.col("p_size").cast("double"), a, b), 6).alias(f"{a}_{b}") for a, b in (("in", "cm"), ("pt", "in"), ("mm", "twip")))), "SELECT p_partkey, round(p_size * 2.54::DOUBLE, 6) AS in_cm, round(p_size / 72::DOUBLE, 6) AS pt_in, round(p_size / 25.4::DOUBLE * 1440, 6) AS mm_twip FROM part")
_add("to_bool", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.to_bool(F.when(F.col("l_linenumber") == 1, "true").when(F.col("l_linenumber") == 2, "0").otherwise("nope")).alias("b")), "SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS b FROM lineitem")
_add("trim_text", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.trim(F.concat(F.lit(" \t"), "p_name", F.lit("\r\n "))).alias("v")), "SELECT p_partkey, p_name AS v FROM part")
_add("base64_round", lambda s, d: _t(s, d, "nation").select("n_nationkey", F.base64("n_name").alias("b"), F.decode(F.unbase64(F.base64("n_name")), "UTF-8").alias("v")), "SELECT n_nationkey, base64(encode(n_name)) AS b, n_name AS v FROM nation")
_add("xml_escape", lambda s, d: _t(s, d, "pages").select("page_id", F.md5(scalars.xml_escape(F.col("html"))).alias("h")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS h FROM pages")
_add("column_letters", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.column_letters((F.col("p_partkey") % 702).cast("int")).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey % 702 < 26 THEN chr(CAST(65 + p_partkey % 702 AS INT)) ELSE chr(CAST(64 + (p_partkey % 702) // 26 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT)) END AS v FROM part")
_add("a1_address", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.a1_address(F.concat(F.lit("$AB$"), F.col("p_partkey").cast("string"))).alias("a")).select("p_partkey", "a.row", "a.col"), "SELECT p_partkey, CAST(p_partkey - 1 AS INT) AS row, 27 AS col FROM part")
_add("prefix_number", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.parse_prefix_number(F.concat(F.col("p_size").cast("string"), F.lit(".5cm"))).alias("v"), scalars.to_long(F.concat(F.col("p_size").cast("string"), F.lit("px"))).alias("n")), "SELECT p_partkey, p_size + 0.5::DOUBLE AS v, CAST(p_size AS BIGINT) AS n FROM part")
_add("colour_parts", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.colour(F.when(F.col("p_size") % 2 == 0, "#00ff10").otherwise("navy")).alias("c")).select("p_partkey", "c.*"), "SELECT p_partkey, 255 AS a, 0 AS r, CASE WHEN p_size % 2 = 0 THEN 255 ELSE 0 END AS g, CASE WHEN p_size % 2 = 0 THEN 16 ELSE 128 END AS b FROM part")
_add("error_codes", lambda s, d: _t(s, d, "part").select("p_partkey", scalars.error_code(F.when(F.col("p_size") > 25, "#REF!").otherwise("x")).cast("double").alias("e")), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 4.0::DOUBLE END AS e FROM part")
_add("text_lengths", lambda s, d: _t(s, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.char_length("text").alias("chars")), "SELECT doc_id, CAST(strlen(text) AS INT) AS bytes, CAST(length(text) AS INT) AS chars FROM documents")

# nested
_add("json_path_project", lambda s, d: _t(s, d, "events").select("event_id", paths.json_value(F.col("props"), "$['k']", "int").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")


def _variant(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), F.schema_of_variant(F.try_parse_json("props")).alias("shape"))


_add("json_variant", _variant, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'OBJECT<k: BIGINT>' AS shape FROM events")


def _nested_orders(s: SparkSession, d: str) -> DataFrame:
    lines = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("n"), F.col("l_quantity").alias("q")))).alias("lines"))
    return _t(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.struct("lines").alias("doc"))


def _flat(s: SparkSession, d: str) -> DataFrame:
    spec = infer.RangeSpec(["$['lines'][*]['n']", "$['lines'][*]['q']"], ["$['lines']"])
    return flatten.flatten(_nested_orders(s, d), "doc", spec, ["o_orderkey"]).select("o_orderkey", "n", "q")


_add("nest_flatten_outer", _flat, "SELECT o_orderkey, CAST(l_linenumber AS DOUBLE) AS n, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")


def _siblings(s: SparkSession, d: str) -> DataFrame:
    n = _t(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name"))).alias("nations"))
    r = _t(s, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    doc = r.select("r_regionkey", F.struct("nations", F.array(F.struct(F.col("r_name").alias("tag")), F.struct(F.upper("r_name").alias("tag"))).alias("tags")).alias("doc"))
    spec = infer.RangeSpec(["$['nations'][*]['n_name']", "$['tags'][*]['tag']"], ["$['nations']", "$['tags']"])
    return flatten.flatten(doc, "doc", spec, ["r_regionkey"]).select("r_regionkey", "n_name", "tag")


_add("nest_siblings_stack", _siblings, "SELECT r_regionkey, n_name, NULL AS tag FROM region LEFT JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, NULL, r_name FROM region UNION ALL SELECT r_regionkey, NULL, upper(r_name) FROM region")


def _levels(s: SparkSession, d: str) -> DataFrame:
    turns = _t(s, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("turns"))
    conv = turns.groupBy("conv_id").agg(F.struct(F.array_sort(F.collect_list(F.struct("role", "turns"))).alias("roles")).alias("doc"))
    spec = infer.RangeSpec(["$['roles'][*]['role']", "$['roles'][*]['turns'][*]['turn']"], ["$['roles']", "$['roles'][*]['turns']"])
    return flatten.flatten(conv, "doc", spec, ["conv_id"]).select("conv_id", "role", "turn")


_add("nest_three_levels", _levels, "SELECT conv_id, role, turn FROM conversations")
_add("nest_scalar_array", lambda s, d: _t(s, d, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(3))), "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings")


def _ranges(s: SparkSession, d: str) -> DataFrame:
    document = {"data": [{"category": "A", "records": [{"id": 1, "ref": "x"}, {"id": 2, "ref": "y"}]}, {"category": "B", "records": []}]}
    rows = [(k, p, g) for k, spec in enumerate(infer.json_ranges(document)) for p in spec.paths for g in spec.row_groups]
    return s.createDataFrame(rows, "range int, path string, row_group string")


_add("infer_ranges", _ranges, "SELECT 0 AS range, p AS path, g AS row_group FROM (VALUES ('$[''data''][*][''category'']'), ('$[''data''][*][''records''][*][''id'']'), ('$[''data''][*][''records''][*][''ref'']')) a(p), (VALUES ('$[''data'']'), ('$[''data''][*][''records'']')) b(g)")


def _xml(s: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("<nation id='"), F.col("n_nationkey").cast("string"), F.lit("'><name>"), scalars.xml_escape(F.col("n_name")), F.lit("</name></nation>"))
    return _t(s, d, "nation").select(x.alias("x")).select(F.xpath_int("x", F.lit("/nation/@id")).alias("id"), F.xpath_string("x", F.lit("/nation/name")).alias("name"))


_add("xml_extract", _xml, "SELECT n_nationkey AS id, n_name AS name FROM nation")

# sinks and csv
_add("csv_render", lambda s, d: _t(s, d, "customer").select("c_custkey", sinks.csv_field(F.concat("c_name", F.lit(', "'), "c_mktsegment")).alias("f")), "SELECT c_custkey, '\"' || replace(c_name || ', \"' || c_mktsegment, '\"', '\"\"') || '\"' AS f FROM customer")
_add("csv_lines", lambda s, d: _t(s, d, "nation").select("n_nationkey", sinks.csv_line(["n_nationkey", "n_name", "n_regionkey"]).alias("line")), "SELECT n_nationkey, n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")


def _csv_round(s: SparkSession, d: str) -> DataFrame:
    """Lines written as csv and read again by the exact tokenizer, cell by cell."""
    lines = _t(s, d, "customer").select("c_custkey", sinks.csv_line(["c_name", "c_mktsegment"]).alias("line"))

    def run(batches):
        for pdf in batches:
            pdf["cells"] = [next(csv_source.tokenize(x), []) for x in pdf["line"]]
            yield pdf[["c_custkey", "cells"]]

    return lines.mapInPandas(run, "c_custkey long, cells array<string>").select("c_custkey", F.col("cells")[0].alias("c_name"), F.col("cells")[1].alias("c_mktsegment"))


_add("csv_roundtrip", _csv_round, "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_rows = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("row"), "c_name")
_CUSTOMER = "SELECT CAST(c_custkey AS BIGINT) AS row, c_name FROM customer"
_add("csv_split", lambda s, d: cells.split_sheets(_rows(s, d), "row", 500), f"SELECT row, c_name, row % 500 AS row_in_sheet, CASE WHEN row < 500 THEN 'data' ELSE 'data_' || (row // 500) END AS sheet FROM ({_CUSTOMER})")
_add("csv_truncate", lambda s, d: cells.split_sheets(_rows(s, d), "row", 500, split=False), f"SELECT row, c_name, row % 500 AS row_in_sheet, 'data' AS sheet FROM ({_CUSTOMER}) WHERE row < 500")
_add("csv_split_header", lambda s, d: cells.split_sheets(_rows(s, d), "row", 501, 1), f"WITH t AS ({_CUSTOMER}), n AS (SELECT max((row - 1) // 500) AS last FROM t) SELECT row, c_name, 1 + (row - 1) % 500 AS row_in_sheet, CASE WHEN (row - 1) // 500 = 0 THEN 'data' ELSE 'data_' || ((row - 1) // 500) END AS sheet FROM t WHERE row > 0 UNION ALL SELECT row, c_name, 0, CASE WHEN k = 0 THEN 'data' ELSE 'data_' || k END FROM t, (SELECT unnest(range(0, last + 1)) AS k FROM n) WHERE row = 0")
_add("json_rows", lambda s, d: _t(s, d, "nation").select("n_nationkey", sinks.json_line(["n_nationkey", "n_name", "n_regionkey"]).alias("line")), "SELECT n_nationkey, '{\"A\":' || n_nationkey || ',\"B\":\"' || n_name || '\",\"C\":' || n_regionkey || '}' AS line FROM nation")
_add("html_rows", lambda s, d: _t(s, d, "nation").select("n_nationkey", sinks.html_row(["n_nationkey", "n_name"]).alias("line")), "SELECT n_nationkey, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS line FROM nation")
_add("flat_cells", lambda s, d: cells.to_cells(_nation(s, d), "row", "nation").select("row", "col", sinks.flat_cell(F.col("type"), F.col("value")).alias("v")), f"SELECT row, col, CASE WHEN type = 'numeric' THEN value || ' [v]' ELSE value END AS v FROM ({_CELLS})")
_add("detect_format", lambda s, d: detection.detect_files(s, f"{d}/nation.parquet").select("format"), "SELECT 'parquet' AS format")
_add("row_limit", lambda s, d: _rows(s, d).where("row < 100"), f"{_CUSTOMER} WHERE c_custkey < 100")
_add("tree_dump_xml", lambda s, d: s.createDataFrame([(trees.dump_xml({"a": [1, True, None, "x"]}),)], "v string"), "SELECT '<object><item name=\"a\"><array><item><number value=\"1\"/></item><item><true/></item><item><null/></item><item><string value=\"x\"/></item></array></item></object>' AS v")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parse props, project a key, filter by it and put a totals row below the detail."""
    rows = _t(spark, d, "events").select("event_id", "event_type", paths.json_value(F.col("props"), "$['k']", "double").alias("k"), "value")
    kept = filters.apply(rows, Item(2, "greater", 50.0))
    return totals.with_totals(kept, {"value": "sum", "event_id": "count"}, {"event_type": "Total"}).withColumn("value", F.round("value", 4))


_add("flagship", flagship, "WITH t AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events), f AS (SELECT * FROM t WHERE k > 50) SELECT event_id, event_type, k, round(value, 4) AS value, false AS is_total FROM f UNION ALL SELECT count(event_id), 'Total', NULL, round(sum(value), 4), true FROM f")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

