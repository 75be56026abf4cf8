"""The engine beside SQL: wildcards, periods, inference, flattening, CSV, workbooks, detection, trees, queries."""

import gzip
import io
import json
import zipfile
from datetime import date

import duckdb
import pytest

import __spark_entry__ as entry
from tabloom.functions import paths, trees
from tabloom.operators import filters
from tabloom.plans import flatten, infer, mapdef
from tabloom.sources import csv, detect, package, workbooks
from tabloom.sources import css as css_source
from tabloom.sources import yaml as yaml_source

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "op,pattern,want",
    [
        ("equal", "abc", ("equal", "abc", False)), ("equal", "abc*", ("begin_with", "abc", False)), ("equal", "*abc", ("end_with", "abc", False)), ("equal", "*abc*", ("contain", "abc", False)),
        ("not_equal", "abc*", ("not_begin_with", "abc", False)), ("not_equal", "*abc*", ("not_contain", "abc", False)), ("equal", "*", ("equal", ".*", True)), ("equal", "a*c", ("equal", "a.*c", True)),
        ("equal", "a?c", ("equal", "a.c", True)), ("equal", "~*x", ("equal", "*x", False)), ("equal", "a.c*", ("begin_with", "a.c", False)), ("greater", "5*", ("greater", "5*", False)), ("equal", "a.?", ("equal", "a\\..", True)),
    ],
)
def test_wildcards(op, pattern, want):
    assert filters.rewrite_wildcard(op, pattern) == want


def test_periods():
    day = date(1998, 5, 17)
    assert filters.period("this_quarter", day) == (date(1998, 4, 1), date(1998, 7, 1))
    assert filters.period("last_month", date(1998, 1, 3)) == (date(1997, 12, 1), date(1998, 1, 1))
    assert filters.period("this_week", day) == (date(1998, 5, 17), date(1998, 5, 24))


def test_json_inference_and_flattening(spark):
    document = {"data": [{"category": "A", "records": [{"id": 1, "ref": "x"}, {"id": 2, "ref": "y"}]}, {"category": "B", "records": [{"id": 3, "ref": "z"}]}, {"category": "E", "records": []}]}
    (spec,) = infer.json_ranges(document)
    assert spec.row_groups == ["$['data']", "$['data'][*]['records']"]
    assert mapdef.read_json_map(mapdef.write_json_map(mapdef.detect_json_map(document))).ranges[0].spec == spec
    df = spark.createDataFrame([(json.dumps(document),)], "t string")
    got = flatten.flatten_json(df, "t", "data array<struct<category:string, records:array<struct<id:int, ref:string>>>>", spec)
    assert [tuple(r[:3]) for r in got.orderBy("_p0", "_p1").collect()] == [("A", 1, "x"), ("A", 2, "y"), ("B", 3, "z"), ("E", None, None)]
    assert not infer.has_range({"a": [1, 2], "b": {"c": 1}})


def test_xml_inference():
    import xml.etree.ElementTree as ET

    (spec,) = infer.xml_ranges(ET.fromstring("<osm><way id='1'><nd ref='5'/><nd ref='6'/></way><way id='2'><nd ref='7'/></way></osm>"))
    assert spec.row_groups == ["/osm/way", "/osm/way/nd"] and spec.paths == ["/osm/way/@id", "/osm/way/nd/@ref"]


def test_paths():
    assert paths.parse_jsonpath("$.a['b c'][3][*][]") == ["a", "b c", 3, "*", "*"]
    assert paths.subtree({"a": [{"b": 1}, {"b": 2}]}, "$.a[*].b") == [1, 2]
    for bad in ("a", "$[-1]", "$['']", "$.", "$!x"):
        with pytest.raises(paths.PathError):
            paths.parse_jsonpath(bad)
    assert paths.parse_xpath("/a/n:b/@c") == (["a", "n:b"], "c")
    with pytest.raises(paths.PathError):
        paths.parse_xpath("//a")


def test_csv_tokenizer():
    t = lambda s, **k: list(csv.tokenize(s, csv.CsvConfig(**k)))
    assert t('a,"b ""q"" c",3\n\n5') == [["a", 'b "q" c', "3"], [], ["5"]]
    assert t("﻿a;b,c", delimiters=",;") == [["a", "b", "c"]]
    assert t('"x\ny",z\n') == [["x\ny", "z"]]
    assert t("a,b\r\n") == [["a", "b\r"]]
    assert t("a,b,") == [["a", "b"]]
    assert t(" a , b ", trim=True) == [["a", "b"]]
    for bad in ('"a"x', '"a""b'):
        with pytest.raises(csv.CsvError):
            t(bad)


def make_xlsx():
    parts = {
        "[Content_Types].xml": '<Types><Override PartName="/xl/workbook.xml"/></Types>',
        "_rels/.rels": '<R><Relationship Id="r1" Type="x/officeDocument" Target="xl/workbook.xml"/></R>',
        "xl/workbook.xml": '<workbook xmlns:r="q"><sheets><sheet name="S" r:id="r1"/></sheets><definedNames><definedName name="N">S!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="x/sharedStrings" Target="ss.xml"/></R>',
        "xl/ss.xml": "<sst><si><t>hello</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c><v>2.5</v></c><c r="D1" t="b"><v>1</v></c></row><row r="3"><c r="A3"><f>A1*2</f><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData><autoFilter ref="A1:B3"><filterColumn colId="1"><top10 val="3" top="0"/></filterColumn></autoFilter><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    data = make_xlsx()
    book = workbooks.parse_xlsx(data)
    assert [(c.row, c.col, c.type, c.value) for c in book.cells] == [(0, 0, "string", "ab"), (0, 1, "numeric", "2.5"), (0, 3, "boolean", "true"), (2, 0, "formula", "5"), (2, 1, "string", "in")]
    assert book.filters[0]["items"] == [{"field": 1, "op": "bottom", "value": 3.0}] and book.names[0]["name"] == "N" and book.merges[0]["last_row"] == 1
    (tmp_path / "a.xlsx").write_bytes(data)
    assert workbooks.read_workbooks(spark, str(tmp_path), "xlsx").count() == 5
    assert detect.detect(data) == "xlsx"


def test_other_workbooks():
    ods = io.BytesIO()
    with zipfile.ZipFile(ods, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell o:value-type="float" o:value="3" t:number-columns-repeated="2"/><t:table-cell o:value-type="string"><x:p>hi</x:p></t:table-cell></t:table-row></t:table></d>')
    assert [(c.col, c.value) for c in workbooks.parse_ods(ods.getvalue()).cells] == [(0, "3"), (1, "3"), (2, "hi")]
    assert detect.detect(ods.getvalue()) == "ods"
    gnu = gzip.compress(b'<g:Workbook xmlns:g="gnumeric"><g:Sheet><g:Name>S</g:Name><g:Cells><g:Cell Row="1" Col="2" ValueType="40">1.5</g:Cell><g:Cell Row="2" Col="0">=A1</g:Cell></g:Cells></g:Sheet></g:Workbook>')
    assert [(c.row, c.type, c.formula) for c in workbooks.parse_gnumeric(gnu).cells] == [(1, "numeric", None), (2, "formula", "=A1")]
    assert detect.detect(gnu) == "gnumeric"
    xml = b'<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row ss:Index="3"><Cell ss:Index="2"><Data ss:Type="Number">4</Data></Cell></Row></Table></Worksheet></Workbook>'
    assert [(c.row, c.col, c.value) for c in workbooks.parse_xls_xml(xml).cells] == [(2, 1, "4")]
    assert [detect.detect(x) for x in (xml, b"<a/>", b'{"a": 1}', b"a,b\n")] == ["xls_xml", "xml", "json", "unknown"]


def test_unsafe_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../x", "1")
    with pytest.raises(package.PackageError):
        package.open_package(out.getvalue())


def test_yaml_and_css():
    assert yaml_source.parse("a: 1\nb:\n  - x\n  - k: yes\n    z: ~\nc: |\n  l1\n  l2\nd: [1, {k: v}]\n---\n- 2\n") == [{"a": 1.0, "b": ["x", {"k": True, "z": None}], "c": "l1\nl2\n", "d": [1.0, {"k": "v"}]}, [2.0]]
    rules = css_source.parse("a > b:hover, .c { color: rgb(1, 2, 3); font: x y }")
    assert rules[0]["chain"] == [("", "a", ""), (">", "b", "hover")] and css_source.properties(rules, ".c") == {"color": [(1, 2, 3, 1.0)], "font": ["x", "y"]}
    document = {"a": [1, {"b": None}], "c": "yes"}
    assert yaml_source.parse(trees.dump_yaml(document)) == [document]


def test_entry_and_queries(spark):
    assert entry.entry(spark).count() > 1
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in ("filter_and_or_tree", "filter_top_n", "cond_duplicate", "totals_row", "pivot_subtotals", "show_run_total", "nest_siblings_stack", "csv_split_header", "autotype_strings"):
        got = queries[name](spark, SF)
        want = con.execute(oracle[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and got.count() == len(want), name
