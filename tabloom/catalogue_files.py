"""Queries over documents and workbooks that are made of the provided tables, each with the SQL that says the same."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formulas, scalars
from .functions.scalars import xml_escape
from .operators import cells, conditions, filters, pivots
from .plans import execute
from .plans.mapdef import CellLink, MapDefinition, RangeLink
from .sources import csv as csv_source
from .sources import workbooks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _order_lines(s: SparkSession, d: str) -> DataFrame:
    """o_orderkey, o_orderstatus, lines: the lines of an order in order, empty where there are none."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))
    lines = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = _t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.array().cast("array<struct<n:int,q:double,flag:string>>")).alias("lines"))


def _json_docs(s: SparkSession, d: str) -> DataFrame:
    doc = F.struct(F.array(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "lines")).alias("orders"), F.lit("made").alias("note"))
    return _order_lines(s, d).select("o_orderkey", F.to_json(doc).alias("doc"))


def _xml_docs(s: SparkSession, d: str, prefix: str = "", declared: str = "") -> DataFrame:
    """<orders><order id=...><status>...</status><line n=...><q>...</q></line>...</order></orders>"""
    p = prefix
    text = lambda x: x.cast("string")
    line = lambda x: F.concat(F.lit(f'<{p}line n="'), text(x["n"]), F.lit(f'"><{p}q> '), text(x["q"]), F.lit(f" </{p}q><{p}flag>"), x["flag"], F.lit(f"</{p}flag></{p}line>"))
    order = F.concat(F.lit(f'<{p}order id="'), text(F.col("o_orderkey")), F.lit(f'"><{p}status>'), xml_escape(F.col("o_orderstatus")), F.lit(f"</{p}status>"), F.array_join(F.transform("lines", line), "\n"), F.lit(f"</{p}order>"))
    closing = F.lit(f'<{p}order id="-"/></{p}orders>')  # a second order, so that orders repeat
    return _order_lines(s, d).select("o_orderkey", F.concat(F.lit(f"<?xml version='1.0'?><{p}orders{declared}>"), order, closing).alias("doc"))


_JSON_FIELDS = [("$['orders'][*]['id']", "order"), ("$['orders'][*]['status']", None), ("$['orders'][*]['lines'][*]['n']", None), ("$['orders'][*]['lines'][*]['q']", "quantity")]
_JSON_MAP = MapDefinition(["data"], [CellLink("data", 0, 7, "$['note']"), CellLink("info", 1, 1, "$['orders'][0]['id']")], [RangeLink("data", 2, 1, _JSON_FIELDS, ["$['orders']", "$['orders'][*]['lines']"])])
_ROWS = """
WITH r AS (
    SELECT o_orderkey, o_orderstatus, l_linenumber AS n, l_quantity AS q, l_returnflag AS flag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS k
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
), num AS (SELECT *, CASE WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS qt FROM r)
"""
_add(
    "json_map_cells", lambda s, d: execute.json_cells(_json_docs(s, d), "doc", MapDefinition(_JSON_MAP.sheets, [], _JSON_MAP.ranges), ["o_orderkey"]),
    _ROWS + """
    SELECT o_orderkey, 'data' AS sheet, 3 + k AS row, 1 AS col, 'numeric' AS type, CAST(o_orderkey AS VARCHAR) AS value FROM num
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 2, 'string', o_orderstatus FROM num
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 3, 'numeric', CAST(n AS VARCHAR) FROM num WHERE n IS NOT NULL
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 4, 'numeric', qt FROM num WHERE q IS NOT NULL
    UNION ALL SELECT o_orderkey, 'data', 2, c, 'string', v FROM orders, (VALUES (1, 'order'), (2, 'status'), (3, 'n'), (4, 'quantity')) h(c, v)
    """,
)
_add(
    "json_cell_link", lambda s, d: execute.json_cells(_json_docs(s, d), "doc", MapDefinition([], _JSON_MAP.cells, []), ["o_orderkey"]),
    "SELECT o_orderkey, 'data' AS sheet, 0 AS row, 7 AS col, 'string' AS type, 'made' AS value FROM orders UNION ALL SELECT o_orderkey, 'info', 1, 1, 'numeric', CAST(o_orderkey AS VARCHAR) FROM orders",
)
_AUTO = _ROWS + """
    , m AS (SELECT *, count(n) OVER (PARTITION BY o_orderkey) AS size FROM num)
    SELECT o_orderkey, 'range-0' AS sheet, 1 + k AS row, c AS col, CASE c WHEN 0 THEN 'string' ELSE 'numeric' END AS type, CASE c WHEN 0 THEN flag WHEN 1 THEN CAST(n AS VARCHAR) ELSE qt END AS value
    FROM m, (VALUES (0), (1), (2)) h(c) WHERE size > 1
    UNION ALL SELECT DISTINCT o_orderkey, 'range-0', 0, c, 'string', v FROM m, (VALUES (0, 'flag'), (1, 'n'), (2, 'q')) h(c, v) WHERE size > 1
"""
_add("json_auto_cells", lambda s, d: execute.auto_json_cells(_json_docs(s, d), "doc", ["o_orderkey"]), _AUTO)
_add("json_has_range", lambda s, d: execute.n_ranges(_json_docs(s, d), "doc", "json", ["o_orderkey"]), "SELECT o_orderkey, CAST(count(l_orderkey) > 1 AS INT) AS n_ranges FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

_XML_FIELDS = [("/orders/order/@id", "order"), ("/orders/order/status", None), ("/orders/order/line/@n", None), ("/orders/order/line/q", "quantity")]


def _xml_map(prefix: str = "") -> MapDefinition:
    add = lambda p: "/".join(prefix + x if x and not x.startswith("@") else x for x in p.split("/"))
    link = RangeLink("data", 2, 1, [(add(p), label) for p, label in _XML_FIELDS], [add("/orders/order"), add("/orders/order/line")])
    return MapDefinition(["data"], [], [link], {"o": "urn:orders"} if prefix else {})


_XML_SQL = _ROWS + """
    SELECT o_orderkey, 'data' AS sheet, 3 + k AS row, 1 AS col, 'numeric' AS type, CAST(o_orderkey AS VARCHAR) AS value FROM num
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 2, 'string', o_orderstatus FROM num
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 3, 'numeric', CAST(n AS VARCHAR) FROM num WHERE n IS NOT NULL
    UNION ALL SELECT o_orderkey, 'data', 3 + k, 4, 'numeric', qt FROM num WHERE q IS NOT NULL
    UNION ALL SELECT o_orderkey, 'data', 3 + count(*), 1, 'string', '-' FROM num GROUP BY o_orderkey
    UNION ALL SELECT o_orderkey, 'data', 2, c, 'string', v FROM orders, (VALUES (1, 'order'), (2, {status}), (3, 'n'), (4, 'quantity')) h(c, v)
"""
_add("xml_map_rows", lambda s, d: execute.xml_cells(_xml_docs(s, d), "doc", _xml_map(), ["o_orderkey"]), _XML_SQL.format(status="'status'"))
_add("xml_map_namespaces", lambda s, d: execute.xml_cells(_xml_docs(s, d, "x:", ' xmlns:x="urn:orders"'), "doc", _xml_map("o:"), ["o_orderkey"]), _XML_SQL.format(status="'o:status'"))
_add("xml_cell_link", lambda s, d: execute.xml_cells(_xml_docs(s, d), "doc", MapDefinition([], [CellLink("one", 4, 2, "/orders/order/status")], []), ["o_orderkey"]), "SELECT o_orderkey, 'one' AS sheet, 4 AS row, 2 AS col, 'string' AS type, o_orderstatus AS value FROM orders")
_add(
    "xml_auto_rows", lambda s, d: execute.auto_xml_sheets(_xml_docs(s, d), "doc", ["o_orderkey"]),
    "SELECT o_orderkey, 'range-0' AS sheet, greatest(count(l_orderkey), 1) + 1 AS last_row, greatest(count(l_orderkey), 1) + 2 * count(l_orderkey) AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
_add("xml_has_range", lambda s, d: execute.n_ranges(_xml_docs(s, d), "doc", "xml", ["o_orderkey"]), "SELECT o_orderkey, 1 AS n_ranges FROM orders")


# workbooks: one for every region, with its nations

_TAG = "</{}>"


def _nations(s: SparkSession, d: str) -> DataFrame:
    """path, nations: the nations of each region in order."""
    n = _t(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("path"), "nations")


def _joined(of: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform("nations", of), "")


def _xls_xml(s: SparkSession, d: str) -> DataFrame:
    row = lambda x, k: F.concat(F.lit('<Row><Cell><Data ss:Type="Number">'), x["n_nationkey"].cast("string"), F.lit('</Data></Cell><Cell><Data ss:Type="String">'), xml_escape(x["n_name"]), F.lit("</Data></Cell></Row>"))
    head = (
        '<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet" xmlns:x="urn:schemas-microsoft-com:office:excel">'
        '<Names><NamedRange ss:Name="keys" ss:RefersTo="=Nations!R2C1:R9C1"/></Names><Worksheet ss:Name="Nations"><Table>'
        '<Row><Cell><Data ss:Type="String">key</Data></Cell><Cell ss:MergeAcross="1"><Data ss:Type="String">name</Data></Cell></Row>'
    )
    tail = (
        '</Table><AutoFilter xmlns="urn:schemas-microsoft-com:office:excel" x:Range="R1C1:R9C2"><AutoFilterColumn x:Type="Custom"><AutoFilterOr><AutoFilterCondition x:Operator="LessThan" x:Value="5"/>'
        '<AutoFilterCondition x:Operator="GreaterThanOrEqual" x:Value="20"/></AutoFilterOr></AutoFilterColumn><AutoFilterColumn x:Index="2" x:Type="Custom"><AutoFilterCondition x:Operator="DoesNotEqual" x:Value="*1"/></AutoFilterColumn></AutoFilter></Worksheet></Workbook>'
    )
    return _nations(s, d).select("path", F.encode(F.concat(F.lit(head), _joined(row), F.lit(tail)), "UTF-8").alias("content"))


def _gnumeric(s: SparkSession, d: str) -> DataFrame:
    def row(x: Column, k: Column) -> Column:
        at = (k + 1).cast("string")
        return F.concat(F.lit('<gnm:Cell Row="'), at, F.lit('" Col="0" ValueType="40">'), x["n_nationkey"].cast("string"), F.lit('</gnm:Cell><gnm:Cell Row="'), at, F.lit('" Col="1" ValueType="60">'), xml_escape(x["n_name"]), F.lit("</gnm:Cell>"))

    head = (
        '<?xml version="1.0"?><gnm:Workbook xmlns:gnm="http://www.gnumeric.org/v10.dtd"><gnm:Names><gnm:Name><gnm:name>limit</gnm:name><gnm:value>20</gnm:value></gnm:Name></gnm:Names><gnm:Sheets><gnm:Sheet><gnm:Name>Nations</gnm:Name>'
        '<gnm:Filters><gnm:Filter Area="A1:B9"><gnm:Field Index="0" Type="expr" Op0="gte" Value0="3" ValueType0="40" Op1="lt" Value1="21" ValueType1="40" IsAnd="1"/></gnm:Filter></gnm:Filters><gnm:MergedRegions><gnm:Merge>B1:C1</gnm:Merge></gnm:MergedRegions><gnm:Cells>'
        '<gnm:Cell Row="0" Col="0" ValueType="60">key</gnm:Cell><gnm:Cell Row="0" Col="1" ValueType="60">name</gnm:Cell>'
    )
    return _nations(s, d).select("path", F.encode(F.concat(F.lit(head), _joined(row), F.lit("</gnm:Cells></gnm:Sheet></gnm:Sheets></gnm:Workbook>")), "UTF-8").alias("content"))


_XLSX = {
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Nations" sheetId="1" r:id="s1"/></sheets><definedNames><definedName name="keys">Nations!$A$2:$A$9</definedName><definedName name="here" localSheetId="0">Nations!$B$1</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="s1" Type="x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="s2" Type="x/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="s3" Type="x/styles" Target="styles.xml"/><Relationship Id="s4" Type="x/pivotCacheDefinition" Target="pivotCache/cache1.xml"/></Relationships>',
    "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="t1" Type="x/table" Target="../tables/table1.xml"/><Relationship Id="t2" Type="x/pivotTable" Target="../pivotTables/pivot1.xml"/></Relationships>',
    "xl/tables/table1.xml": '<table name="Nations" displayName="Nations" ref="A1:B9" totalsRowCount="1"><autoFilter ref="A1:B8"><filterColumn colId="0"><top10 val="2"/></filterColumn></autoFilter><tableColumns><tableColumn name="key" totalsRowFunction="sum"/><tableColumn name="name" totalsRowLabel="Total"/></tableColumns></table>',
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="0.000"/></numFmts><fonts><font><b/><name val="Sans"/></font></fonts><fills><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><borders><border><left style="thin"/><right/></border></borders><cellXfs><xf numFmtId="170" fontId="0" fillId="0" borderId="0" xfId="0"><alignment horizontal="center"/><protection locked="0"/></xf></cellXfs><cellStyles><cellStyle name="Normal" xfId="0"/></cellStyles></styleSheet>',
    "xl/pivotTables/pivot1.xml": '<pivotTableDefinition name="P" cacheId="1"><rowFields><field x="1"/></rowFields><dataFields><dataField name="Sum" fld="0" subtotal="max" showDataAs="percentOfTotal"/></dataFields><pageFields><pageField fld="1" item="0"/></pageFields></pivotTableDefinition>',
    "xl/pivotCache/_rels/cache1.xml.rels": '<Relationships><Relationship Id="c1" Type="x/pivotCacheRecords" Target="records1.xml"/></Relationships>',
}


_PLACES = {"sheet": "xl/worksheets/sheet1.xml", "strings": "xl/sharedStrings.xml", "cache": "xl/pivotCache/cache1.xml", "records": "xl/pivotCache/records1.xml"}


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rest in zip(*(c.to_pylist() for c in b.columns[1:])):
            target = io.BytesIO()
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in _XLSX.items():
                    z.writestr(name, body)
                for name, body in zip(b.schema.names[1:], rest):
                    z.writestr(_PLACES[name], body)
            out.append(target.getvalue())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])


def _xlsx(s: SparkSession, d: str) -> DataFrame:
    number = lambda k: k.cast("string")
    strings = F.concat(F.lit("<sst><si><t>key</t></si><si><t>na</t></si>"), _joined(lambda x, k: F.concat(F.lit("<si><r><t>"), xml_escape(x["n_name"]), F.lit("</t></r></si>"))), F.lit("</sst>"))
    row = lambda x, k: F.concat(F.lit('<row r="'), number(k + 2), F.lit('"><c r="A'), number(k + 2), F.lit('" s="0"><v>'), number(x["n_nationkey"]), F.lit('</v></c><c t="s"><v>'), number(k + 2), F.lit("</v></c></row>"))
    sheet = F.concat(
        F.lit('<worksheet><sheetViews><sheetView><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols><col min="2" max="3" width="20" hidden="1"/></cols><sheetData><row r="1" ht="30"><c r="A1" t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'), _joined(row),
        F.lit('</sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells><conditionalFormatting sqref="A2:A9"><cfRule type="cellIs" operator="greaterThan" priority="1"><formula>20</formula></cfRule></conditionalFormatting></worksheet>'),
    )
    field = lambda name, items: F.concat(F.lit(f'<cacheField name="{name}"><sharedItems>'), items, F.lit("</sharedItems></cacheField>"))
    cache = F.concat(F.lit('<pivotCacheDefinition><cacheSource type="worksheet"><worksheetSource ref="A1:B9" sheet="Nations"/></cacheSource><cacheFields>'), field("key", F.lit("")), field("name", _joined(lambda x, k: F.concat(F.lit('<s v="'), xml_escape(x["n_name"]), F.lit('"/>')))), F.lit("</cacheFields></pivotCacheDefinition>"))
    records = F.concat(F.lit("<pivotCacheRecords>"), _joined(lambda x, k: F.concat(F.lit('<r><n v="'), number(x["n_nationkey"]), F.lit('"/><x v="'), number(k), F.lit('"/></r>'))), F.lit("</pivotCacheRecords>"))
    parts = _nations(s, d).select("path", sheet.alias("sheet"), strings.alias("strings"), cache.alias("cache"), records.alias("records"))
    return parts.mapInArrow(_zipped, "path string, content binary")


_BOOK = "WITH n AS (SELECT 'region-' || n_regionkey AS path, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation), r AS (SELECT DISTINCT path FROM n) "
_BOOK_CELLS = _BOOK + """
SELECT path, 'Nations' AS sheet, k AS row, 0 AS col, 'numeric' AS type, CAST(n_nationkey AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS formula, {xf} AS xf FROM n
UNION ALL SELECT path, 'Nations', k, 1, 'string', n_name, NULL, NULL FROM n
UNION ALL SELECT path, 'Nations', 0, c, 'string', v, NULL, NULL FROM r, (VALUES (0, 'key'), (1, '{name}')) h(c, v)
"""
_book = lambda make, kind, table: lambda s, d: workbooks.workbook_table(make(s, d), kind, table)
_each = lambda columns: f"{_BOOK} SELECT path, {columns} FROM r"
_add("xls_xml_cells", _book(_xls_xml, "xls_xml", "cells"), _BOOK_CELLS.format(xf="CAST(NULL AS INT)", name="name"))
_add("xls_xml_names", _book(_xls_xml, "xls_xml", "names"), _each("'keys' AS name, '=Nations!R2C1:R9C1' AS expression, CAST(NULL AS VARCHAR) AS sheet"))
_add("xls_xml_merges", _book(_xls_xml, "xls_xml", "merges"), _each("'Nations' AS sheet, 0 AS first_row, 1 AS first_col, 0 AS last_row, 2 AS last_col"))
_add("gnumeric_cells", _book(_gnumeric, "gnumeric", "cells"), _BOOK_CELLS.format(xf="CAST(NULL AS INT)", name="name"))
_add("gnumeric_names", _book(_gnumeric, "gnumeric", "names"), _each("'limit' AS name, '20' AS expression, CAST(NULL AS VARCHAR) AS sheet"))
_add("xlsx_cells", _book(_xlsx, "xlsx", "cells"), _BOOK_CELLS.format(xf="0", name="na"))
_add("xlsx_sheets", _book(_xlsx, "xlsx", "sheets"), _each("'Nations' AS sheet, 0 AS position"))
_add("xlsx_strings", _book(_xlsx, "xlsx", "strings"), _BOOK + "SELECT path, CAST(k + 1 AS INT) AS position, n_name AS text FROM n UNION ALL SELECT path, p, t FROM r, (VALUES (0, 'key'), (1, 'na')) h(p, t)")
_add("xlsx_names", _book(_xlsx, "xlsx", "names"), _each("'keys' AS name, 'Nations!$A$2:$A$9' AS expression, CAST(NULL AS VARCHAR) AS sheet") + " UNION ALL SELECT path, 'here', 'Nations!$B$1', 'Nations' FROM r")
_add("xlsx_merges", _book(_xlsx, "xlsx", "merges"), _each("'Nations' AS sheet, 0 AS first_row, 1 AS first_col, 0 AS last_row, 2 AS last_col"))
_add("xlsx_sizes", _book(_xlsx, "xlsx", "sizes"), _each("'Nations' AS sheet, 'row' AS axis, 0 AS first, 0 AS last, 30.0::DOUBLE AS size, false AS hidden") + " UNION ALL SELECT path, 'Nations', 'col', 1, 2, 20.0, true FROM r")
_add("xlsx_tables", _book(_xlsx, "xlsx", "tables"), _each("'Nations' AS sheet, 'Nations' AS name, 0 AS first_row, 0 AS first_col, 8 AS last_row, 1 AS last_col, 1 AS totals_rows, 0 AS position, 'key' AS \"column\", NULL AS label, 'sum' AS \"function\"") + " UNION ALL SELECT path, 'Nations', 'Nations', 0, 0, 8, 1, 1, 1, 'name', 'Total', 'none' FROM r")
_add("xlsx_conditions", _book(_xlsx, "xlsx", "conditions"), _each("'Nations' AS sheet, 'A2:A9' AS ref, 'cellIs' AS type, 'greaterThan' AS operator, 1 AS priority, ['20'] AS formulas, '{}' AS detail"))
_add("xlsx_styles", _book(_xlsx, "xlsx", "styles"), _each("""0 AS xf, '0.000' AS number_format, '{"b": "1", "name": "Sans"}' AS font, '{"fgColor": "FFFF0000", "pattern": "solid"}' AS fill, '{"left": "thin"}' AS border, 'Normal' AS style, '{"horizontal": "center"}' AS alignment, '{"locked": "0"}' AS protection"""))
_add("xlsx_views", _book(_xlsx, "xlsx", "views"), _each("""'Nations' AS sheet, '{"state": "frozen", "topLeftCell": "A2", "ySplit": "1"}' AS detail"""))
_add("xlsx_settings", _book(_xlsx, "xlsx", "settings"), _each("'1899-12-30' AS origin, 1 AS n_sheets"))
_add("xlsx_pivot_tables", _book(_xlsx, "xlsx", "pivot_tables"), _each("'Nations' AS sheet, 'P' AS name, '1' AS cache, 'rows' AS axis, 0 AS position, 1 AS field, NULL AS \"function\", NULL AS show_as") + " UNION ALL SELECT path, 'Nations', 'P', '1', 'data', 0, 0, 'max', 'percentOfTotal' FROM r UNION ALL SELECT path, 'Nations', 'P', '1', 'page', 0, 1, NULL, '0' FROM r")
_add("workbook_errors", lambda s, d: workbooks.workbook_errors(_xls_xml(s, d).withColumn("content", F.when(F.col("path") == "region-2", F.substring("content", 1, 200)).otherwise(F.col("content"))), "xls_xml").select("path", F.col("error").startswith("ParseError").alias("parse_error")), "SELECT 'region-2' AS path, true AS parse_error")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Pivot records with the field items that they point to, and those of the base field in groups."""
    books = _xlsx(s, d)
    records, fields = workbooks.workbook_table(books, "xlsx", "pivot_records"), workbooks.workbook_table(books, "xlsx", "pivot_fields").where("item IS NOT NULL")
    one = lambda t: t.withColumn("field", F.concat("path", F.lit("#"), F.col("field").cast("string")))
    found = pivots.record_items(one(records).withColumn("record", F.struct("path", "record")), one(fields).select("field", F.col("position").alias("index"), "item"))
    return found.select("record.path", "record.record", F.substring_index("field", "#", -1).cast("int").alias("field"), "item")


_add("pivot_records", _records, _BOOK + "SELECT path, k - 1 AS record, 0 AS field, CAST(n_nationkey AS VARCHAR) AS item FROM n UNION ALL SELECT path, k - 1, 1, n_name FROM n")


def _grouped_records(s: SparkSession, d: str) -> DataFrame:
    records = _t(s, d, "orders").select(F.col("o_orderkey").alias("record"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("item"))
    groups = s.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high")], "base string, group_item string")
    return pivots.group_items(records, groups, "priority").groupBy("group_item").agg(F.count(F.lit(1)).alias("n"))


_add("pivot_group_items", _grouped_records, "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE o_orderpriority END AS group_item, count(*) AS n FROM orders GROUP BY 1")


def _filtered(make: Callable[[SparkSession, str], DataFrame], kind: str, at: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of the table nation that the filter declared in the workbooks lets through."""

    def run(s: SparkSession, d: str) -> DataFrame:
        declared = workbooks.workbook_table(make(s, d), kind, "filters").select("tree").distinct().orderBy("tree").first()  # one definition
        return filters.apply(_t(s, d, "nation").select("n_nationkey", "n_name"), filters.from_plain(json.loads(declared.tree)))

    return run


_add("xls_xml_filter", _filtered(_xls_xml, "xls_xml"), "SELECT n_nationkey, n_name FROM nation WHERE (n_nationkey < 5 OR n_nationkey >= 20) AND NOT ends_with(n_name, '1')")
_add("gnumeric_filter", _filtered(_gnumeric, "gnumeric"), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 21")
_add("xlsx_filter", _filtered(_xlsx, "xlsx"), "SELECT n_nationkey, n_name FROM nation QUALIFY rank() OVER (ORDER BY n_nationkey DESC) <= 2")
_add("hidden_rows", lambda s, d: filters.hidden_rows(_t(s, d, "nation").select("n_nationkey", "n_name"), filters.Item(0, "less", 7.0)), "SELECT n_nationkey, n_name, n_nationkey >= 7 AS hidden FROM nation")
_add("filter_set_numbers", lambda s, d: filters.apply(_t(s, d, "part").select("p_partkey", "p_size"), filters.ItemSet(1, (2.0, "7", "x"))), "SELECT p_partkey, p_size FROM part WHERE p_size IN (2, 7)")
_add("filter_top_percent_tree", lambda s, d: filters.apply(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), filters.Node("and", (filters.Item(2, "top_percent", 3), filters.Item(3, "less", 40.0)))), "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM (SELECT * FROM lineitem QUALIFY rank() OVER (ORDER BY l_extendedprice DESC) <= ceil(count(*) OVER () * 0.03)) WHERE l_quantity < 40")

# pivots and sheets
_add(
    "pivot_two_columns", lambda s, d: pivots.evaluate(_t(s, d, "lineitem"), pivots.Pivot(("l_returnflag",), ("l_linestatus", "l_linenumber"), (pivots.DataField("l_quantity", "sum"),)), ["F|1", "O|2"]),
    "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F' AND l_linenumber = 1) AS \"F|1\", sum(l_quantity) FILTER (l_linestatus = 'O' AND l_linenumber = 2) AS \"O|2\" FROM lineitem GROUP BY 1",
)
_add(
    "pivot_cache_stats", lambda s, d: pivots.cache_fields(_t(s, d, "orders").withColumn("mixed_", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))), ["o_custkey", "o_orderdate", "o_orderpriority", "mixed_"]),
    """SELECT 'o_custkey' AS field, count(DISTINCT o_custkey) AS n_items, CAST(min(o_custkey) AS DOUBLE) AS min_number, CAST(max(o_custkey) AS DOUBLE) AS max_number, CAST(NULL AS DATE) AS min_date, CAST(NULL AS DATE) AS max_date, false AS has_blank, true AS has_number, false AS has_date, false AS has_text, false AS mixed FROM orders
    UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), NULL, NULL, min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), false, false, true, false, false FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), NULL, NULL, NULL, NULL, false, false, false, true, false FROM orders
    UNION ALL SELECT 'mixed_', count(DISTINCT v) + 1, min(TRY_CAST(v AS DOUBLE)), max(TRY_CAST(v AS DOUBLE)), NULL, NULL, true, true, false, true, true FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS v FROM orders)""",
)
_add("pivot_auto_range", lambda s, d: pivots.auto_range_group(_t(s, d, "part"), "p_size", 10).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(CAST(m + floor((p_size - m) / 10) * 10 AS DOUBLE) AS VARCHAR) AS bucket, count(*) AS n FROM (SELECT p_size, min(p_size) OVER () AS m FROM part) GROUP BY 1")
_add("pivot_item_order", lambda s, d: _t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "numeric").when(F.col("o_orderkey") % 3 == 1, "blank").otherwise("character").alias("kind")).select("o_orderkey", pivots.item_order(F.col("kind"), F.col("o_orderkey"))[0].cast("int").alias("place")), "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 4 END AS place FROM orders")
_add("sheet_catalogue", lambda s, d: cells.sheets(workbooks.workbook_table(_xls_xml(s, d), "xls_xml").withColumn("sheet", F.concat("path", F.lit("/"), "sheet"))), _BOOK + "SELECT path || '/Nations' AS sheet, 2 * count(*) + 2 AS n_cells, count(*) + 1 AS n_rows, 2 AS n_cols FROM n GROUP BY 1")
_add("find_table", lambda s, d: cells.find_table(workbooks.workbook_table(_xlsx(s, d), "xlsx", "tables"), "Nations", 3, 1).select("path", "name").distinct(), _each("'Nations' AS name"))
_add("cell_render", lambda s, d: _t(s, d, "part").select("p_partkey", cells.render(F.when(F.col("p_size") % 3 == 0, "formula").when(F.col("p_size") % 3 == 1, "boolean").otherwise("string"), F.when(F.col("p_size") % 3 == 1, "TRUE").when(F.col("p_size") % 3 == 2, F.col("p_name")), F.when(F.col("p_size") == 5, "#REF!")).alias("v")), "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '#RES!' WHEN p_size = 5 THEN '#ERR!' WHEN p_size % 3 = 1 THEN 'true' ELSE p_name END AS v FROM part")
_add("cond_average_nan", lambda s, d: conditions.average(_t(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("v")), "v").select("p_partkey", "flag"), "SELECT p_partkey, p_partkey % 100 <> 0 AND p_size > (SELECT avg(p_size) FROM part WHERE p_partkey % 100 <> 0) AS flag FROM part")

# csv files: one for every customer segment and nation


def _csv_files(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))
    line = lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(';"'), x["c_name"], F.lit(' ""q"""'), F.lit(","), x["c_mktsegment"], F.lit("\n"))
    text = F.concat(F.lit("key;name,segment\n\n"), F.array_join(F.transform("rows", line), ""))
    return rows.select(F.col("c_nationkey").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


_CSV = """
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS path, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name, c_mktsegment) - 1 AS k FROM customer),
p AS (SELECT path, CAST(max(k) // 19 AS BIGINT) AS last FROM (SELECT path, k + 1 AS k FROM c) GROUP BY 1),
x AS (SELECT path, (k + 1) // 19 AS number, 1 + (k + 1) % 19 AS row, c_custkey, c_name, c_mktsegment FROM c)
SELECT path, CASE WHEN number = 0 THEN 'data' ELSE 'data_' || number END AS sheet, row, 0 AS col, 'numeric' AS type, CAST(c_custkey AS DOUBLE) AS num, NULL AS str FROM x
UNION ALL SELECT path, CASE WHEN number = 0 THEN 'data' ELSE 'data_' || number END, row, 1, 'string', NULL, c_name || ' "q"' FROM x
UNION ALL SELECT path, CASE WHEN number = 0 THEN 'data' ELSE 'data_' || number END, row, 2, 'string', NULL, c_mktsegment FROM x
UNION ALL SELECT path, CASE WHEN n = 0 THEN 'data' ELSE 'data_' || n END, 0, c, 'string', NULL, v FROM (SELECT path, unnest(range(0, last + 1)) AS n FROM p), (VALUES (0, 'key'), (1, 'name'), (2, 'segment')) h(c, v)
"""
_CONFIG = csv_source.CsvConfig(";,", header_rows=1, sheet_rows=20, split=True)
_add("csv_read", lambda s, d: csv_source.on_sheets(csv_source.csv_cells(_csv_files(s, d), _CONFIG), _CONFIG), _CSV)
_add("csv_read_truncated", lambda s, d: csv_source.on_sheets(csv_source.csv_cells(_csv_files(s, d), _CONFIG), csv_source.CsvConfig(";,", header_rows=1, sheet_rows=20)), f"SELECT * FROM ({_CSV}) WHERE sheet = 'data'")
_add("csv_errors", lambda s, d: csv_source.csv_errors(_csv_files(s, d).withColumn("content", F.when(F.col("path") == "3", F.encode(F.lit('a,"b"x'), "UTF-8")).otherwise(F.col("content"))), _CONFIG), "SELECT '3' AS path, 'expected a delimiter, not ' || chr(39) || 'x' || chr(39) AS error")


# formulas
_line = lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
_add("formula_arithmetic", lambda s, d: _line(s, d).select("l_orderkey", "l_linenumber", formulas.formula("=D2*(1-E2)*(1+[l_tax])+2^2-10%", _COLUMNS).alias("v")), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) + 4::DOUBLE - 0.1::DOUBLE AS v FROM lineitem")
_add("formula_functions", lambda s, d: _line(s, d).select("l_orderkey", "l_linenumber", formulas.formula('=IF(AND(C2>10,G2="r"),"big "&LOWER(G2)&C2,IF(MOD(B2,2)=0,LEFT("even",2),""))', _COLUMNS).alias("v"), formulas.formula("=SUM(B2:C2)+MAX(B2,C2)", _COLUMNS).alias("n"), formulas.formula("=IFERROR(1/(B2-1),-1)", _COLUMNS).alias("e")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 AND l_returnflag = 'R' THEN 'big r' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN l_linenumber % 2 = 0 THEN 'ev' ELSE '' END AS v, l_linenumber + l_quantity + greatest(l_linenumber, l_quantity) AS n, CASE WHEN l_linenumber = 1 THEN -1.0::DOUBLE ELSE 1 / (l_linenumber - 1)::DOUBLE END AS e FROM lineitem")
_add("cond_formula", lambda s, d: _line(s, d).select("l_orderkey", "l_linenumber", conditions.expression("=OR([l_quantity]<5, AND(E2>=0.05, NOT(ISBLANK(G2)), LEN(G2)=1))", _COLUMNS).alias("flag")), "SELECT l_orderkey, l_linenumber, l_quantity < 5 OR l_discount >= 0.05 AS flag FROM lineitem")


# scalars
_part = lambda s, d: _t(s, d, "part")
_add("length_parts", lambda s, d: _part(s, d).select("p_partkey", scalars.to_length(F.concat(F.col("p_size").cast("string"), F.lit(".5cm"))).alias("x")).select("p_partkey", "x.*"), "SELECT p_partkey, 'cm' AS unit, p_size + 0.5::DOUBLE AS value FROM part")
_add("date_time_text", lambda s, d: _t(s, d, "orders").select("o_orderkey", scalars.to_date_time(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("12:30:00")).alias("at")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders")
_add("enum_codes", lambda s, d: _t(s, d, "orders").select("o_orderkey", scalars.enum_code(F.col("o_orderstatus"), ["F", "O"]).cast("int").alias("code")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code FROM orders")
_add("range_clamp", lambda s, d: _part(s, d).select("p_partkey", scalars.clamp_range(F.col("p_size") - 10, F.col("p_size") + 20, 40)[0].alias("a"), scalars.clamp_range(F.col("p_size") - 10, F.col("p_size") + 20, 40)[1].alias("b"), scalars.is_valid_range(F.col("p_size") - 10, F.lit(0), F.col("p_size"), F.lit(3)).alias("ok")), "SELECT p_partkey, least(greatest(p_size - 10, 0), 39) AS a, least(p_size + 20, 39) AS b, p_size >= 10 AS ok FROM part")
_add("json_escape", lambda s, d: _part(s, d).select("p_partkey", scalars.json_escape(F.concat("p_name", F.lit('"\\\n'))).alias("v")), """SELECT p_partkey, p_name || '\\"\\\\\\n' AS v FROM part""")
_add("unquote_text", lambda s, d: _part(s, d).select("p_partkey", scalars.unquote(F.concat(F.lit('"'), "p_name", F.lit('\\t\\"x"'))).alias("v")), """SELECT p_partkey, p_name || chr(9) || '"x' AS v FROM part""")
_add("blank_text", lambda s, d: _part(s, d).select("p_partkey", scalars.is_blank(F.when(F.col("p_size") % 2 == 0, " \t\n").otherwise(F.col("p_name"))).alias("b")), "SELECT p_partkey, p_size % 2 = 0 AS b FROM part")
_add("xml_names", lambda s, d: _part(s, d).select("p_partkey", scalars.is_xml_name(F.when(F.col("p_size") % 2 == 0, F.lit("é:a-1")).otherwise(F.lit("1a"))).alias("ok")), "SELECT p_partkey, p_size % 2 = 0 AS ok FROM part")
_add("r1c1_address", lambda s, d: _part(s, d).select("p_partkey", scalars.r1c1_address(F.concat(F.lit("R"), F.col("p_partkey").cast("string"), F.lit("C7"))).alias("a")).select("p_partkey", "a.*"), "SELECT p_partkey, CAST(p_partkey - 1 AS INT) AS row, 6 AS col FROM part")
_add("odf_address", lambda s, d: _part(s, d).select("p_partkey", scalars.odf_address(F.concat(F.lit("$'My sheet'.$C$"), F.col("p_partkey").cast("string"))).alias("a")).select("p_partkey", "a.*"), "SELECT p_partkey, 'My sheet' AS sheet, CAST(p_partkey - 1 AS INT) AS row, 2 AS col FROM part")
_add("error_locator", lambda s, d: _t(s, d, "documents").select("doc_id", scalars.locate(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("x")).select("doc_id", "x.*"), "SELECT doc_id, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS INT) AS line, CAST(length(t) - length(t) + length(list_last(string_split(t, chr(10)))) + 1 AS INT) AS \"column\" FROM (SELECT doc_id, left(text, CAST(length(text) // 2 AS BIGINT)) AS t FROM documents)")
_add("uuid_shape", lambda s, d: _part(s, d).select("p_partkey", scalars.uuid4().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("ok")), "SELECT p_partkey, true AS ok FROM part")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
