"""Work that must not grow faster than the input: what is done once a shape, once a link, once a value."""

import math
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tabloom.operators import filters
from tabloom.plans import execute, infer, mapdef
from tabloom.plans.mapdef import RangeLink


def xml_text(lines: int, p: str = "", declared: str = "") -> str:
    return f"<{p}a{declared}><{p}b id='7'>" + "".join(f"<{p}c n='{k}'> {k}.0 </{p}c>" for k in range(lines)) + f"</{p}b><{p}b id='-'/></{p}a>"


def test_xml_ranges_are_inferred_once_a_shape(monkeypatch):
    calls = []
    shapes = infer.Shapes(infer.xml_shape, lambda root: calls.append(1) or mapdef.detect_xml_map(ET.tostring(root, "unicode")))
    for k in range(2, 40):  # repeats beyond the second add no structure
        root = ET.fromstring(xml_text(k))
        assert shapes.of(root) == mapdef.detect_xml_map(xml_text(k))
    assert len(calls) == 1
    for other in ("<a><b id='7'/></a>", "<a><b id='7'/>t<b/></a>", "<a><b><c/><c/></b><b><d>x</d></b></a>", "<a><b><d>x</d></b><b><c/><c/></b></a>"):
        assert shapes.of(ET.fromstring(other)) == mapdef.detect_xml_map(other)
    assert len(calls) == 5
    monkeypatch.setattr(infer, "REMEMBERED", 0)
    shapes.of(ET.fromstring(xml_text(3)))
    assert len(shapes._known) == 1


def test_xml_sheets_leave_cells_in_the_worker(spark):
    rows = [(k, xml_text(k % 4)) for k in range(12)] + [(3, xml_text(5)), (12, "<a"), (13, None), (14, "<a/>")]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = execute.auto_xml_sheets(df, "doc", ["id"])
    want = execute.auto_xml_cells(df, "doc", ["id"]).groupBy("id", "sheet").agg(F.max("row").alias("last_row"), F.count_if(F.col("type") == "numeric").alias("numbers"))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 13


def percent_rows(spark, values, percent, low):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    item = filters.Item(0, "bottom_percent" if low else "top_percent", percent)
    return sorted(r.x for r in filters.apply(df, item).collect())


def test_percent_threshold_reads_few_values(spark, monkeypatch):
    rng = random.Random(3)
    lists = [[], [2.0] * 50, [rng.choice([0.0, 1.0, rng.random()]) for _ in range(700)] + [float("nan"), None]]
    for accuracy in (10_000, 3):  # coarse quantiles may miss the rank, which the counts find
        monkeypatch.setattr(filters, "ACCURACY", accuracy)
        for values in lists:
            numbers = sorted(v for v in values if v is not None and v == v)
            for percent, low in ((3, False), (50, True), (100, True), (0, False)):
                rank = math.ceil(len(numbers) * (percent / 100))
                edge = (numbers if low else numbers[::-1])[rank - 1] if rank else None
                assert percent_rows(spark, values, percent, low) == [v for v in numbers if rank and (v <= edge if low else v >= edge)], (accuracy, percent, low)
    df = spark.range(1000).selectExpr("CAST(id AS double) AS x")
    plan = filters.apply(df, filters.Item(0, "top_percent", 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan  # no row is compared with an array of cuts


def test_json_rows_need_no_window(spark):
    text = '{"n": "x", "d": [{"p": 1, "r": [{"i": 1}, {"i": 2}], "s": [{"j": 3}]}, {"p": 2, "r": [], "s": null}]}'
    link = RangeLink("s", 0, 0, [("$['n']", None), ("$['d'][*]['p']", None), ("$['d'][*]['r'][*]['i']", None), ("$['d'][*]['s'][*]['j']", None)], ["$['d']", "$['d'][*]['r']", "$['d'][*]['s']"])
    df = spark.createDataFrame([(1, text), (2, '{"d": []}'), (3, "{bad"), (4, None)], "id int, doc string")
    rows = execute.json_rows(df, "doc", link, ["id"])
    got = {(r.id, r.row): tuple(v and v.toPython() for v in r[2:]) for r in rows.collect()}
    own = [("x", 1, 1, None), ("x", 1, 2, None), ("x", 1, None, 3), ("x", 2, None, None), ("x", 2, None, None)]
    none = {(k, row): (None,) * 4 for k in (2, 3, 4) for row in (0, 1)}
    assert got == {(1, k): v for k, v in enumerate(own)} | none
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_xml_links_are_compiled_once_and_values_typed_once():
    link = RangeLink("s", 0, 0, [("/o:a/o:b/@id", None), ("/o:a/o:b/o:c", None)], ["/o:a/o:b", "/o:a/o:b/o:c"])
    root, typed = ET.fromstring(xml_text(3, "x:", " xmlns:x='urn:o'")), []
    before = execute._xml_places.cache_info().misses
    for _ in range(3):
        rows = list(execute.xml_tree_rows(root, link, {"o": "urn:o"}, lambda x: typed.append(x) or x))
        assert rows == [["7", "0.0"], ["7", "1.0"], ["7", "2.0"], ["-", None]]
    assert execute._xml_places.cache_info().misses == before + 1 and typed.count("7") == 3


def test_xml_maps_without_namespaces_match_local_names():
    link = RangeLink("s", 0, 0, [("/a/b/@id", None), ("/a/b/c", None)], ["/a/b", "/a/b/c"])
    runs = list(execute.xml_document_runs(ET.fromstring(xml_text(2, "x:", " xmlns:x='urn:o'")), mapdef.MapDefinition(["s"], [], [link])))
    assert runs == [("s", 0, 0, [("string", "id"), ("string", "c")]), ("s", 1, 0, [("numeric", "7"), ("numeric", "0")]), ("s", 2, 0, [("numeric", "7"), ("numeric", "1")]), ("s", 3, 0, [("string", "-"), None])]


def test_json_ranges_are_inferred_once_a_shape():
    calls = []
    shapes = infer.Shapes(infer.json_shape, lambda x: calls.append(1) or mapdef.detect_json_map(x))
    for k in range(50):
        document = {"d": [{"i": k, "t": str(k)}, {"i": None, "t": True}], "n": k}
        assert shapes.of(document) == mapdef.detect_json_map(document)
    assert len(calls) == 1
    for other in ({"d": [[1], [2]]}, {"d": [[1, {}], [2]]}, {"d": [[{}], [2, 3]]}, {"d": [{"e": [{"f": 1}]}]}, {"d": [{"e": [{"f": 1}]}, {"e": [{"f": 1}]}]}):
        assert shapes.of(other) == mapdef.detect_json_map(other)
