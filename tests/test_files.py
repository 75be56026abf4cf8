"""Sources, maps, documents and the command line on small hand-made files."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tabloom import __main__ as cli
from tabloom import document
from tabloom.functions import formulas, trees
from tabloom.plans import execute, infer, mapdef
from tabloom.plans.mapdef import CellLink, MapDefinition, RangeLink
from tabloom.sources import css, csv, detect, workbooks, yaml
from tabloom.streaming import arrivals

ACCEPTED = ['0', '-0', '1e5', '1E+2', '-1.5e-3', '""', '"\\u00e9"', '"\\ud83d\\ude00"', '[]', '[ ]', '{}', '[[],[{}]]', 'true', 'null', ' [1 ] ', '{"a":1,"a":2}', '{"":0}', '[1,2 ,3]', '"/\\/"', '"\x7f"', '[0.1]', '\t\r\n 1', '[1e-999]', "\ufeff[1]", "[" * 200 + "]" * 200]
REJECTED = ['', ' ', '01', '-', '+1', '.5', '5.', '1e', '1e+', '0x1', 'NaN', '-Infinity', '[NaN]', 'Infinity', "'a'", '"a', '"\\x00"', '"\\u12"', '"a\tb"', '"\n"', '[1,]', '[,1]', '[1 2]', '[', ']', '[1', '{', '{"a"}', '{"a":}', '{"a":1,}', '{a:1}', '{1:1}', '{"a" 1}', '{"a":1 "b":2}', '[1]x', '1 2', 'tru', 'TRUE', 'nul', '[1}', '//c\n1', '/**/1', '[1]//', "\x0c1", "\u00a01", "[" * 100_000]


@pytest.mark.parametrize("text", ACCEPTED)
def test_json_accepts(text):
    execute.strict_json(text)


@pytest.mark.parametrize("text", REJECTED)
def test_json_rejects(text):
    with pytest.raises(ValueError):
        execute.strict_json(text)


def test_yaml():
    text = 'a: one\n  two\n\n  three\nb: &x [1, {k: v}]\nc: *x\nd: >\n  f1\n  f2\n\n  g\n    deep\n  h\ne: "x\n  y\\n\\u00e9"\nf: |+\n  l\n\ng: &m\n  k: 1\nh: *m\n'
    assert yaml.parse(text) == [{"a": "one two\nthree", "b": [1.0, {"k": "v"}], "c": [1.0, {"k": "v"}], "d": "f1 f2\ng\n  deep\nh\n", "e": "x y\né", "f": "l\n\n", "g": {"k": 1.0}, "h": {"k": 1.0}}]
    for bad in ("a: b\n c: d", "a: !t 1", "- 1\nb: 2", "a: *q", "x: 'abc", "<<: 1\n", "a:\n\tb: 1", '"\\q"'):
        with pytest.raises(yaml.YamlError):
            yaml.parse(bad)


def test_css_at_rules():
    rules = css.parse("@charset 'utf-8'; @import url(x.css); a {b: c} @font-face {d: e} @media print { a {b: q} } z {y: x}")
    assert [(r["selector"], r.get("at")) for r in rules] == [("a", None), ("a", "@media print"), ("z", None)] and css.properties(rules, "a") == {"b": ["c"]}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1;h2\n1,"x ""y"""\n\n2.5,z\n3,\n')
    (tmp_path / "bad.csv").write_bytes(b'1,2\n"a"b,c\n')
    (tmp_path / "enc.csv").write_bytes(b"1,\xff\n")
    (tmp_path / "utf16.csv").write_bytes("é,1\n".encode("utf-16"))
    config = csv.CsvConfig(",;", header_rows=1, sheet_rows=3, split=True)
    got = {(r.path.rpartition("/")[2], r.sheet, r.row, r.col, r.type, r.str if r.num is None else r.num) for r in csv.read_csv(spark, str(tmp_path), config).collect()}
    own = {x[1:] for x in got if x[0] == "a.csv"}
    assert own == {("data", 0, 0, "string", "h1"), ("data", 0, 1, "string", "h2"), ("data", 1, 0, "numeric", 1.0), ("data", 1, 1, "string", 'x "y"'), ("data_1", 0, 0, "string", "h1"), ("data_1", 0, 1, "string", "h2"), ("data_1", 1, 0, "numeric", 2.5), ("data_1", 1, 1, "string", "z"), ("data_1", 2, 0, "numeric", 3.0)}
    assert {x for x in got if x[0] == "utf16.csv"} == {("utf16.csv", "data", 0, 0, "string", "é"), ("utf16.csv", "data", 0, 1, "numeric", 1.0)}
    errors = csv.csv_errors(spark.read.format("binaryFile").load(str(tmp_path)), config).collect()
    assert sorted(r.path.rpartition("/")[2] for r in errors) == ["bad.csv", "enc.csv"]
    doc = document.load(str(tmp_path / "a.csv"), "csv", config)
    assert [s.name for s in doc.sheets] == ["a", "a_1"] and doc.sheet("a_1").cell(1, 0).value == 2.5


def cells_of(found):
    return {(s, r, c): v for s, r, c, _, v in found}


def test_xml_maps():
    text = '<?xml version="1.0"?><r xmlns:n="urn:n"><g id=" 7 "><v>a</v><w>1.50</w><w>x</w></g><g id="8"><n:k>z</n:k></g><late>end</late></r>'
    link = RangeLink("s", 0, 0, [("/r/g/@id", None), ("/r/g/w", "value"), ("/r/g/v", None)], ["/r/g", "/r/g/w"])
    got = cells_of(execute.xml_document_cells(ET.fromstring(text), MapDefinition(["s"], [CellLink("t", 1, 1, "/r/late")], [link])))
    assert got == {("s", 0, 0): "id", ("s", 0, 1): "value", ("s", 0, 2): "v", ("s", 1, 0): "7", ("s", 1, 1): "1.5", ("s", 1, 2): "a", ("s", 2, 0): "7", ("s", 2, 1): "x", ("s", 2, 2): "a", ("s", 3, 0): "8", ("t", 1, 1): "end"}
    one = MapDefinition([], [CellLink("t", 0, 0, "/r/g/m:k")], [], {"m": "urn:n"})
    assert cells_of(execute.xml_document_cells(ET.fromstring(text), one)) == {("t", 0, 0): "z"}
    assert infer.xml_ranges(ET.fromstring("<a><b/></a>")) == []
    back = mapdef.read_xml_map(mapdef.write_xml_map(one))
    assert back.cells == one.cells and back.namespaces == one.namespaces
    auto = mapdef.detect_xml_map("<a><b c='1'/><b c='2'/></a>")
    assert cells_of(execute.xml_document_cells(ET.fromstring("<a><b c='1'/><b c='2'/></a>"), auto)) == {("range-0", 0, 0): "c", ("range-0", 1, 0): "1", ("range-0", 2, 0): "2"}


def test_json_maps(spark):
    text = json.dumps({"n": "note", "d": [{"p": 1, "r": [{"i": 1.5, "t": "1"}, {"i": None, "t": True}], "z": "last"}, {"p": 2, "r": []}]})
    link = RangeLink("s", 1, 1, [("$['d'][*]['p']", None), ("$['d'][*]['r'][*]['i']", None), ("$['d'][*]['r'][*]['t']", "T"), ("$['d'][*]['z']", None)], ["$['d']", "$['d'][*]['r']"])
    m = MapDefinition(["s"], [CellLink("s", 0, 0, "$['n']"), CellLink("s", 0, 3, "$['d'][1]['p']")], [link])
    want = {("s", 0, 0): "note", ("s", 0, 3): "2", ("s", 1, 1): "p", ("s", 1, 2): "i", ("s", 1, 3): "T", ("s", 1, 4): "z", ("s", 2, 1): "1", ("s", 2, 2): "1.5", ("s", 2, 3): "1", ("s", 2, 4): "last", ("s", 3, 1): "1", ("s", 3, 3): "true", ("s", 3, 4): "last", ("s", 4, 1): "2"}
    assert cells_of(execute.json_document_cells(json.loads(text), m)) == want
    df = spark.createDataFrame([(1, text), (2, "{bad"), (3, None)], "id int, doc string")
    got = execute.json_cells(df, "doc", m, ["id"]).where("id = 1").collect()
    assert {(r.sheet, r.row, r.col): r.value for r in got} == want
    types = {(r.row, r.col): r.type for r in got}
    assert types[2, 3] == "string" and types[3, 3] == "boolean" and types[2, 2] == "numeric"
    errors = execute.auto_json_cells(df, "doc", ["id"]).where("type = 'error'").collect()
    assert [r.id for r in errors] == [2]
    assert {r.id: r.n_ranges for r in execute.n_ranges(df, "doc", "json", ["id"]).collect()} == {1: 1, 2: None, 3: None}
    arrays = mapdef.detect_json_map([["a", 1], ["b", 2]])
    assert cells_of(execute.json_document_cells([["a", 1], ["b", 2]], arrays))[("range-0", 2, 1)] == "2"


def test_trees(tmp_path):
    document_ = {"a": [1, 2], "b": 1}
    assert trees.with_value(document_, "$['a'][2]", 5) == {"a": [1, 2, 5], "b": 1} and trees.with_value({}, "$['x'][0]['y']", 1) == {"x": [{"y": 1}]}
    assert trees.without(document_, "$['a'][0]") == {"a": [2], "b": 1} and document_ == {"a": [1, 2], "b": 1}
    assert trees.keys(document_) == ["a", "b"] and trees.child(document_, "a") == [1, 2]
    for bad in (lambda: trees.child(document_, "c"), lambda: trees.keys([]), lambda: trees.without(document_, "$"), lambda: trees.with_value(document_, "$['a'][9]", 1)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "a.json").write_text('{"$ref": "b.json"}')
    (tmp_path / "b.json").write_text('{"$ref": "a.json"}')
    with pytest.raises(ValueError, match="itself"):
        trees.load_json('{"x": {"$ref": "a.json"}}', str(tmp_path))
    assert trees.canonical_xml("<a z='2' b='1'>t<c/>u</a>") == ["/a", '/a@b="1"', '/a@z="2"', '/a"t"', "/a/c", '/a"u"']
    assert trees.write_back("<a><b>1</b><b>2</b></a>", {"/a/b[2]": "<&>"}) == "<a><b>1</b><b>&lt;&amp;&gt;</b></a>"


def test_shared_formulas_move():
    assert workbooks.shift_formula("A1+$B2*C$3+SUM(D4:E5)&\"A1\"&Sheet1!F6", 1, 2) == "C2+$B3*E$3+SUM(F5:G6)&\"A1\"&Sheet1!H7" and workbooks.shift_formula("A1", -1, 0) == "#REF!"


def test_formula_errors(spark):
    for bad in ("=1+", "=FOO(1)", "=A3", "=Z2", "=(1", "=1 2", "=ABS(1,2)", "=[x]"):
        with pytest.raises(formulas.FormulaError):
            formulas.formula(bad, ["a"])
    df = spark.createDataFrame([(2.0, "x")], "a double, s string")
    value = lambda t: df.select(formulas.formula(t, ["a", "s"]).alias("v")).first().v
    assert value("=-A2^2") == 4 and value("=2^3^2") == 64 and value('="a"&1&B2') == "a1x" and value("=1/0") is None and value("=B2+1") is None and value('=B2="X"') is True and value("=ROUND(-2.5)") == -3 and value('=SUM(A2:B2)*50%') == 1


def test_document_and_command_line(tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x, ""q"""\n')
    doc = document.load(str(path), "csv")
    assert doc.sheets[0].data_size == (2, 2) and [[c.value for c in row] for row in doc.sheets[0].get_rows()] == [["a", "b"], [1.0, 'x, "q"']]
    assert doc.sheets[0].dump("csv") == path.read_text() and doc.check().splitlines()[2] == "x/1/0:numeric:1"
    assert [p.rpartition("/")[2] for p in doc.dump(str(tmp_path / "out"), "html")] == ["x.html"] and len(doc.dump_state(str(tmp_path / "state"))) == len(workbooks.TABLES)
    (tmp_path / "x.json").write_text('{"d": [{"k": 1}, {"k": "2"}]}')
    (tmp_path / "x.xml").write_text("<a><b c='1'/><b c='2'/></a>")
    (tmp_path / "x.yaml").write_text("a: [1, yes]\n")
    (tmp_path / "x.css").write_text("a { b: c }")

    def run(*arguments):
        code = cli.main([str(a) for a in arguments])
        return code, capsys.readouterr().out

    assert run("csv", path, "-f", "check")[1].startswith('data/0/0:string:"a"')
    assert run("json", tmp_path / "x.json", "--mode", "map", "-f", "check")[1].splitlines() == ['range-0/0/0:string:"k"', "range-0/1/0:numeric:1", 'range-0/2/0:string:"2"']
    assert '"range-0"' in run("json", tmp_path / "x.json", "--mode", "map-gen")[1] and "value" in run("json", tmp_path / "x.json", "--mode", "structure")[1] and "<object>" in run("json", tmp_path / "x.json", "--to", "xml")[1]
    assert run("json", tmp_path / "x.json", "--mode", "subtree", "--path", "$['d'][1]['k']")[1].strip() == '"2"'
    assert run("xml", tmp_path / "x.xml", "-f", "csv")[1] == "c\n1\n2\n" and "/a/b[*]/@c" in run("xml", tmp_path / "x.xml", "--mode", "structure")[1] and "row-group" in run("xml", tmp_path / "x.xml", "--mode", "map-gen")[1] and "/a" in run("xml", tmp_path / "x.xml", "--mode", "dump")[1]
    assert json.loads(run("yaml", tmp_path / "x.yaml", "--to", "json")[1]) == {"a": [1.0, True]} and run("detect", tmp_path / "x.xml")[1] == "xml\n" and '"selector": "a"' in run("css", tmp_path / "x.css")[1]
    assert run("zip", path)[0] == 1 and run("sheet", tmp_path / "missing")[0] == 1


def test_workbook_errors_and_trees():
    assert detect.detect("<?xml version='1.0'?><a/>".encode("utf-16")) == "xml"
    book = workbooks.parse_gnumeric(b'<g:Workbook xmlns:g="gnumeric"><g:Sheet><g:Name>S</g:Name><g:Filters><g:Filter Area="A1:C9"><g:Field Index="1" Type="bucket" top="0" items="0" count="20"/><g:Field Index="2" Type="nonblanks"/></g:Filter></g:Filters></g:Sheet></g:Workbook>')
    assert book.filters[0]["tree"] == ["and", [["item", "own", 1, "bottom_percent", 20.0], ["item", "gnumeric", 2, "nonblanks", None]]]
    t = workbooks._ods_tree(ET.fromstring('<filter xmlns:t="t"><filter-or><filter-condition t:field-number="1" t:operator="&gt;" t:value="3"/><filter-condition t:field-number="0" t:operator="="><filter-set-item t:value="x"/><filter-set-item t:value=""/></filter-condition></filter-or></filter>'))
    assert t == ["and", [["or", [["item", "odf", 1, ">", "3"], ["set", 0, ["x", ""], True]]]]]


def test_stream_of_files(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 03:00:00', 'b', 5.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    from pyspark.sql.types import StructType

    stream = arrivals.arrivals(spark, str(tmp_path / "in"), StructType.fromDDL(schema))
    make = lambda s: arrivals.windowed_totals(s, "ts", "k", "v")
    arrivals.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"), make)
    spark.sql("SELECT timestamp'2024-01-01 09:00:00' AS ts, 'c' AS k, 1.0D AS v").write.mode("append").parquet(str(tmp_path / "in"))
    arrivals.run_available(arrivals.arrivals(spark, str(tmp_path / "in"), StructType.fromDDL(schema)), str(tmp_path / "out"), str(tmp_path / "check"), make)
    got = {(r.k, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("k"), "n", "total").collect()}
    assert got == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_structure_walker():
    w = infer.Walker(infer.json_structure({"a": [{"k": 1}, {"k": 2}]}))
    assert w.kind == "object" and w.children == ["a"] and w.descend("a").kind == "array" and w.descend("object").repeat and w.path == ["a", "object"] and w.ascend().kind == "array"
    with pytest.raises(ValueError):
        w.root().ascend()
    x = infer.Walker(infer.xml_structure(ET.fromstring("<a><b c='1'/><b/></a>")))
    assert x.descend("b").repeat and x.attributes == ["c"]


def test_parts_what_if_and_formula_order():
    sheet = b'<worksheet><sheetData><row r="1"><c r="A1"><f>B1+C2</f></c><c r="B1"><f>SUM(C1:C3)</f></c><c r="C1" s="2"><v>1</v></c></row><row r="2"><c r="C2" s="2"><f t="dataTable" ref="C2:D3" dt2D="1" dtr="1" r1="A9" r2="B9"/><v>2</v></c><c r="D2" s="2"><v>3</v></c></row></sheetData></worksheet>'
    book = workbooks.parse_part("sheet", sheet)
    assert [c.formula for c in workbooks.formula_order(book.cells)] == ["SUM(C1:C3)", "B1+C2"]
    assert list(workbooks.TABLES["what_if"][1](book)) == [("sheet", 1, 2, 2, 3, "A9", "B9")]
    assert list(workbooks.TABLES["formats"][1](book)) == [("sheet", 0, 2, 0, 2, 2), ("sheet", 1, 2, 1, 3, 2)]
    with pytest.raises(ValueError, match="circle"):
        workbooks.formula_order([workbooks.Cell("s", 0, 0, "formula", None, "B1"), workbooks.Cell("s", 0, 1, "formula", None, "A1")])
    assert workbooks.parse_part("strings", b"<sst><si><t>a</t></si></sst>").strings == ["a"]
    log = workbooks._xlsx_revisions(ET.fromstring('<headers xmlns:r="r"><header userName="u" dateTime="d" r:id="x"/></headers>'), {"x": ET.fromstring('<revisions><rcc rId="1" sId="2"><oc r="A1"><v>1</v></oc><nc r="A1" t="inlineStr"><is><t>new</t></is></nc></rcc></revisions>')})
    assert log == [{"user": "u", "at": "d", "number": "1", "kind": "rcc", "sheet_id": "2", "ref": "A1", "old": "1", "new": "new"}]


def test_styles_of_other_formats():
    gnumeric = workbooks.parse_gnumeric(b'<g:Workbook xmlns:g="gnumeric"><g:Sheet><g:Name>S</g:Name><g:Styles><g:StyleRegion startCol="0" startRow="0" endCol="1" endRow="4"><g:Style HAlign="8" Back="FFFF:0:0" Format="0.00" Locked="1"><g:Font Bold="1">Sans</g:Font><g:StyleBorder><g:Top Style="1"/></g:StyleBorder><g:Condition Operator="3"><g:Expression0>5</g:Expression0></g:Condition></g:Style></g:StyleRegion></g:Styles></g:Sheet></g:Workbook>')
    assert gnumeric.styles[0]["font"] == {"Bold": "1", "name": "Sans"} and gnumeric.styles[0]["border"] == {"Top": "1"} and gnumeric.conditions[0]["ref"] == "A1:B5" and list(workbooks.TABLES["formats"][1](gnumeric)) == [("S", 0, 0, 4, 1, 0)]
    xml = workbooks.parse_xls_xml(b'<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Styles><Style ss:ID="s1"><Font ss:Bold="1"/><Interior ss:Color="#FF0000"/><Borders><Border ss:Position="Left" ss:LineStyle="Continuous"/></Borders><NumberFormat ss:Format="0%"/></Style></Styles></Workbook>')
    assert xml.styles[0]["style"] == "s1" and xml.styles[0]["number_format"] == "0%" and xml.styles[0]["border"] == {"Left": "Continuous"} and xml.styles[0]["fill"] == {"Color": "#FF0000"}
