"""Every query of the engine against its SQL, value by value, and the plans that scale asks for."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tabloom import catalogue, catalogue_files
from tabloom.operators import filters, pivots, totals
from tabloom.operators.filters import DateFilter, Item, ItemSet, Node

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries() | catalogue_files.queries()
SQL = catalogue.oracle_sql() | catalogue_files.oracle_sql()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return out


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return 0, ""
    if isinstance(v, bool):
        return 2, v
    if isinstance(v, (int, float)):
        return 1, round(float(v), 5)
    return 3, str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in SQL
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize(
    ("table", "tree", "pushed"),
    [
        ("lineitem", Item(4, "greater", 25.0), "GreaterThan(l_quantity,25.0)"),
        ("lineitem", Item(3, "less_equal", 2), "LessThanOrEqual(l_linenumber,2)"),
        ("customer", Item(1, "begin_with", "C"), "StringStartsWith(c_name,C)"),
        ("customer", Item(1, "not_contain", "C"), "Not(StringContains(c_name,C))"),
        ("orders", ItemSet(5, ("1-URGENT", "5-LOW")), "In(o_orderpriority"),
        ("part", ItemSet(4, (2.0, 3)), "In(p_size"),
        ("orders", DateFilter(4, "this_year", __import__("datetime").date(1998, 5, 17)), "GreaterThanOrEqual(o_orderdate"),
        ("lineitem", Node("and", (Node("or", (Item(4, "less", 5.0), Item(4, "greater", 45.0))), Item(8, "equal", "R"))), "EqualTo(l_returnflag,R)"),
    ],
)
def test_filters_reach_the_scan(spark, table, tree, pushed):
    df = filters.apply(spark.read.parquet(f"{SF}/{table}.parquet"), tree)
    assert pushed in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["filter_ranked_tree", "cond_top_n", "cond_bottom_percent", "filter_top_n", "cond_above_avg", "cond_colorscale"])
def test_ranks_need_no_window_over_all_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Window" not in main and "SinglePartition" not in main and "NestedLoop" not in plan


def test_filters_on_odd_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, "a"), (2, nan, ""), (3, None, None), (4, 3.0, "b"), (5, 3.0, "2")], "edge int, x double, s string")
    ids = lambda tree: sorted(r.edge for r in filters.apply(df, tree).collect())
    assert ids(Item(1, "greater", 1.0)) == [4, 5] and ids(Item(1, "above_average")) == [4, 5] and ids(Item(1, "below_average")) == [1]
    assert ids(Item(1, "top", 1)) == [4, 5] and ids(Item(1, "top", 3)) == [1, 4, 5] and ids(Item(1, "top", 0)) == [] and ids(Item(1, "bottom_percent", 34)) == [1, 4, 5] and ids(Item(1, "bottom_percent", 33)) == [1]
    assert ids(Item(2, "empty")) == [2, 3] and ids(Item(2, "not_equal", "a")) == [2, 3, 4, 5] and ids(Item(2, "greater", 1)) == [5] and ids(Item(1, "not_equal", 3.0)) == [1, 2, 3]
    assert ids(ItemSet(0, (2.0, "5", "x"))) == [2, 5] and ids(ItemSet(2, ("a",), True)) == [1, 2, 3] and ids(Node("or", ())) == [] and ids(Node("and", ())) == [1, 2, 3, 4, 5]
    empty = df.limit(0)
    assert filters.apply(empty, Node("and", (Item(1, "top_percent", 10), Item(1, "top", 3)))).count() == 0
    ties = spark.range(100).select((F.col("id") % 7).cast("double").alias("v"))
    for op, percent in (("top_percent", 20), ("bottom_percent", 55), ("top_percent", 100)):
        order = "DESC" if op.startswith("top") else "ASC"
        want = duckdb.sql(f"SELECT count(*) FROM (SELECT (i % 7)::DOUBLE AS v FROM range(100) t(i) QUALIFY rank() OVER (ORDER BY v {order}) <= ceil(count(*) OVER () * {percent} / 100))").fetchall()[0][0]
        assert filters.apply(ties, Item(0, op, percent)).count() == want


def test_imported_trees():
    tree = filters.from_plain(["and", [["or", [["item", "xlsx", 0, "greaterThan", "5"], ["item", "xlsx", 0, "equal", "a*"]]], ["date", 1, "aboveAverage"], ["item", "odf", 2, "All", None], ["item", "odf", 2, "<", "text"], ["set", 3, ["x"], True]]])
    assert tree == Node("and", (Node("or", (Item(0, "greater", 5.0), Item(0, "begin_with", "a"))), Item(1, "above_average"), ItemSet(3, ("x",), True)))
    assert filters.from_plain(["and", []]) is None


def test_axes_do_not_collide(spark):
    df = spark.createDataFrame([("r", "a", "b|c", 1), ("r", "a|b", "c", 2), ("r", None, "c", 4), ("r", "\\N", "c", 8)], "k string, x string, y string, v int")
    out = pivots.evaluate(df, pivots.Pivot(("k",), ("x", "y"), (pivots.DataField("v", "sum"),))).first().asDict()
    assert sorted(v for k, v in out.items() if k != "k") == [1, 2, 4, 8]


def test_totals_of_mixed_columns_skip_text(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("2",), (None,)], "v string")
    assert totals.totals(df, {"v": "sum"}).first().v == 3.5 and totals.totals(df, {"v": "count"}).first().v == 3
