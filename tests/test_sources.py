"""XML, XSD, configuration, files, the HTTP service and streams."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from nestql.catalog import Catalog, result_rows
from nestql.plans.planner import Options
from nestql.server import serve
from nestql.sources.config import Config, load_config, parse_config
from nestql.sources.xml import coerce, parse_xml, parse_xml_many
from nestql.sources.xsd import Hints, merge_hints, parse_xsd, strip_root
from nestql.streaming.aggregate import aggregate_stream

from helpers import agg


@pytest.mark.parametrize(
    ("xml", "value"),
    [
        ("<bakery><Loaves>36</Loaves><Baker>Ines</Baker></bakery>", {"Loaves": 36.0, "Baker": "Ines"}),
        ("<tram><Remark/><stops>14</stops></tram>", {"Remark": None, "stops": 14.0}),
        ("<oven><Lit>TRUE</Lit><Locked>false</Locked></oven>", {"Lit": True, "Locked": False}),
        ('<ship><hull paint="teal">88017</hull></ship>', {"hull": {"@paint": "teal", "#text": 88017.0}}),
        ('<lamp><Bulb dimmed="true"/></lamp>', {"Bulb": {"@dimmed": True}}),
        ("<song><Verse><bars>8</bars></Verse></song>", {"Verse": {"bars": 8.0}}),
        ("<shelf><Slot>03</Slot><Slot>07</Slot></shelf>", {"Slot": ["03", "07"]}),
        ('<Almanac edition="6.5"><Season>spring</Season></Almanac>', {"@edition": 6.5, "Season": "spring"}),
        ('<m xmlns:k="urn:kiln"><k:heat>960</k:heat><!-- skip --><?skip me?></m>', {"heat": 960.0}),
        ("<p> wet <depth>2</depth> sand </p>", {"#text": "wetsand", "depth": 2.0}),
    ],
)
def test_xml_values(xml, value):
    assert parse_xml(xml) == [value]


def test_xml_documents():
    assert parse_xml("") == [] and parse_xml("<a/>") == []
    assert parse_xml_many("<R><x><i>1</i></x><x><i>2</i></x></R>") == [{"i": 1.0}, {"i": 2.0}]
    assert parse_xml_many("<R><x><i>1</i></x></R>") == [{"x": {"i": 1.0}}]
    texts = ["007", "00", "0", "0.5", "123456789012345", "1234567890123456", "-12", "1e5", "inf", "nan", "99999999999999999999", "", "1_0"]
    assert [coerce(t) for t in texts] == ["007", "00", 0.0, 0.5, 123456789012345.0, "1234567890123456", -12.0, 1e5, "inf", "nan", "99999999999999999999", "", "1_0"]


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="Orchard"><xs:complexType><xs:sequence>
<xs:element name="Row" maxOccurs="40"><xs:complexType><xs:sequence>
<xs:element name="Plot" type="xs:STRING"/><xs:element name="Pears" type="xs:decimal"/><xs:element name="Seen" type="xs:QName"/><xs:element ref="o:Soil" maxOccurs="1"/>
</xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def test_xsd_hints(spark):
    raw = parse_xsd(XSD)
    assert raw == Hints(frozenset({"Orchard.Row.Plot"}), frozenset({"Orchard.Row"}))
    hints = strip_root(raw)
    assert hints == Hints(frozenset({"Row.Plot"}), frozenset({"Row"}))
    assert strip_root(Hints(frozenset({"Alone"}))) == Hints()
    assert merge_hints(hints, Hints(frozenset({"a"}))).text_paths == {"a", "Row.Plot"}
    xml = "<Orchard><Row><Plot>5120</Plot><Pears>61</Pears></Row></Orchard>"
    assert parse_xml(xml, hints) == [{"Row": [{"Plot": "5120", "Pears": 61.0}]}]
    c = Catalog(spark)
    c.register_xml("t", xml, xsd=XSD)
    assert result_rows(c.aggregate({"dataset": "t", "groupBy": ["Row.Plot"], "aggregations": [agg("Row.Pears", "sum", "s")]})) == [{"Row.Plot": "5120", "s": 61.0}]


@pytest.mark.parametrize("bad", ["<a><b></a>", "<a", "no xml"])
def test_bad_xml_raises(bad):
    with pytest.raises(SyntaxError):
        parse_xml(bad)


SURVEY = """<Survey river="Wend"><Length>212</Length><Gauges>
<Gauge><Depth>4.5</Depth><Built>1998-03-10</Built><Reading><Day>2021-02-03</Day><Flow>11</Flow></Reading><Reading><Day>2021-02-18</Day><Flow>40</Flow></Reading><Reading><Day>2021-03-05</Day><Flow>7</Flow></Reading></Gauge>
<Gauge><Depth>2.5</Depth><Built>2020-09-01</Built><Reading><Day>2021-03-01</Day><Flow>19</Flow></Reading><Reading><Day>2021-03-20</Day><Flow>23</Flow></Reading></Gauge>
<Gauge><Depth>6</Depth><Built>2021-01-15</Built><Reading><Day>2021-01-30</Day><Flow>90</Flow></Reading></Gauge>
</Gauges></Survey>"""


def test_a_survey_in_xml_is_aggregated(spark):
    c = Catalog(spark)
    c.register_xml("r", SURVEY)
    # of the readings, three lie in the twenty days up to the tenth of March: 40, 7 and 19
    lately = {"n": 20, "unit": "day", "date_field": "Day", "ref_date": "2021-03-10"}
    request = [
        agg("Length", "max", "length"),
        agg("Gauges.Gauge.Depth", "sum", "depth"),
        agg("Gauges.Gauge.Reading.Flow", "max", "most"),
        agg("Gauges.Gauge.Reading.Flow", "max", "most_lately", **lately),
        agg("Gauges.Gauge.Reading.Flow", "sum", "sum_lately", **lately),
        agg("Gauges.Gauge.Reading.Flow", "count_rows", "readings"),
        agg("Gauges.Gauge.Built", "count_date_last_n", "new", n=1, unit="year", ref_date="2021-03-10"),
    ]
    got = result_rows(c.aggregate({"dataset": "r", "aggregations": request}))
    assert got == [{"length": 212.0, "depth": 13.0, "most": 90.0, "most_lately": 40.0, "sum_lately": 66.0, "readings": 6.0, "new": 2.0}]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"v": 1}, {"v": 2}]')
    (tmp_path / "b.json").write_text('{"v": 5}')
    (tmp_path / "x").mkdir()
    for i in range(3):
        (tmp_path / "x" / f"{i}.xml").write_text("<R><L>" + f"<T><b>{i}</b></T>" * (i + 1) + "</L></R>")
    c = Catalog(spark)
    c.register_file("a", str(tmp_path / "a.json"))
    c.register_file("b", str(tmp_path / "b.json"))
    c.register_xml("x", str(tmp_path / "x"), is_path=True)
    total = {"aggregations": [agg("v", "sum", "s")]}
    assert [result_rows(c.aggregate({"dataset": d, **total})) for d in "ab"] == [[{"s": 3.0}], [{"s": 5.0}]]
    # one document has a single child where the others have several
    assert result_rows(c.aggregate({"dataset": "x", "aggregations": [agg("L.T.b", "sum", "s"), agg("L.T.b", "count", "n")]})) == [{"s": 8.0, "n": 6.0}]
    c.register_json("mixed", [{"x": {"v": 1}}, {"x": [{"v": 2}, {"v": 3}]}, {"x": None}, {"y": 1}])
    assert result_rows(c.aggregate({"dataset": "mixed", "aggregations": [agg("x.v", "sum", "s"), agg("x.v", "count", "n")]})) == [{"s": 6.0, "n": 3.0}]
    c.register_json("empty", "[]")
    assert result_rows(c.aggregate({"dataset": "empty", **total})) == []


def test_parquet_reads_only_named_leaves(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).selectExpr("id", "'x' other", "array(named_struct('a', id, 'b', 'y', 'in', array(named_struct('v', id + 1, 'w', 'z')))) arr").write.parquet(path)
    c = Catalog(spark)
    c.register_parquet("p", path, "id")
    df = c.aggregate({"dataset": "p", "where": {"id": {"$lt": 2}}, "aggregations": [agg("arr.in.v", "sum", "s")]})
    assert result_rows(df) == [{"s": 3.0}]
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "arr:array<struct<in:array<struct<v:bigint>>>>" in plan and "other:string" not in plan and "LessThan(id,2)" in plan


def test_config(tmp_path):
    text = 'port: "9000" # here\nlog_requests: true\nother: 1\ndatasets:\n# a comment\n  - name: a\n    file: /data/a#1.json\n  - file: b.xml\n    xsd_file: b.xsd\n    name: "b # b"\n  - file: nameless\n'
    c = parse_config(text)
    assert (c.port, c.log_requests, c.enable_samples) == ("9000", True, True)
    assert [(d.name, d.file, d.xsd_file) for d in c.datasets] == [("a", "/data/a#1.json", ""), ("b # b", "b.xml", "b.xsd")]
    assert load_config(str(tmp_path / "none.yaml")) == Config()


def test_server(spark, tmp_path):
    (tmp_path / "index.html").write_text("hello")
    server = serve(spark, Config(port="0", static_dir=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, kind="application/json"):
        with urllib.request.urlopen(urllib.request.Request(base + path, body, {"Content-Type": kind})) as r:
            return r.read().decode(), r.headers

    try:
        assert json.loads(call("/api/datasets")[0]) == ["employees"]
        assert {"path": "age", "type": "number"} in json.loads(call("/api/schema?dataset=employees")[0])
        assert len(json.loads(call("/api/data?dataset=employees")[0])) == 9
        body, headers = call("/api/aggregate", json.dumps({"dataset": "employees", "aggregations": [agg("salary", "sum", "s")]}).encode())
        assert json.loads(body) == [{"s": 229e6}] and headers["Access-Control-Allow-Origin"] == "*"
        assert json.loads(call("/api/upload?dataset=x", b"<r><v>4</v></r>", "text/xml")[0]) == {"dataset": "x", "records": 1}
        assert json.loads(call("/api/upload", b'[{"v": 1}]')[0])["dataset"].startswith("uploaded_")
        assert json.loads(call("/api/upload/xsd?dataset=y", XSD.encode())[0])["arrayPaths"] == ["Row"]
        assert json.loads(call("/api/xsd/info?dataset=y")[0])["stringPaths"] == ["Row.Plot"]
        assert call("/")[0] == "hello"
        for path, body, status in [("/api/aggregate", None, 405), ("/api/aggregate", b"{", 400), ("/api/aggregate", b'{"dataset": "no"}', 400), ("/none", None, 404), ("/../secret", None, 404)]:
            with pytest.raises(urllib.error.HTTPError) as e:
                call(path, body)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", [(1.0,), (2.0,)]), (2, "b", []), (3, "a", [(4.0,)])], "id long, g string, x array<struct<v: double>>").write.parquet(str(source))
    stream = spark.readStream.schema("id long, g string, x array<struct<v: double>>").parquet(str(source))
    for name, request, want in [
        ("s1", {"groupBy": ["g"], "aggregations": [agg("x.v", "sum", "s"), agg("x.v", "avg", "m"), agg("id", "count", "n")]}, [("a", 7.0, 7 / 3, 2.0), ("b", 0.0, None, 1.0)]),
        ("s2", {"groupBy": ["x.v"], "aggregations": [agg("x.v", "count", "n")]}, [(1.0, 1.0), (2.0, 1.0), (4.0, 1.0), (None, 0.0)]),
    ]:
        query = aggregate_stream(stream, request, "id").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="not a stream"):
        aggregate_stream(spark.range(1).toDF("id"), {"aggregations": [agg("id", "sum")]})


def test_json_lines_and_mixed_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1, "x": {"w": 2}}\n{"v": 4, "x": [{"w": 3}, {"w": 5}]}\n\n')
    (tmp_path / "b.json").write_text('[{"x": {"w": 7}}, 5, {"x": [{"w": 1}]}, {"y": null}]')
    c = Catalog(spark)
    c.register_json("plain", str(tmp_path / "a.jsonl"), is_path=True)
    assert result_rows(c.aggregate({"dataset": "plain", "aggregations": [agg("v", "sum", "s")]})) == [{"s": 5.0}]
    for name, want in (("a.jsonl", (10.0, 3.0)), ("b.json", (8.0, 2.0))):
        c.register_json("m", str(tmp_path / name), is_path=True, mixed=True)
        got = result_rows(c.aggregate({"dataset": "m", "aggregations": [agg("x.w", "sum", "s"), agg("x.w", "count", "n")]}))
        assert got == [{"s": want[0], "n": want[1]}]


def test_xml_files_are_read_by_element(spark, tmp_path):
    head = '<?xml version="1.0"?><fleet xmlns:k="urn:keel"><boats>'
    boats = "".join(f'<boat k:no="{i}"><crew>{i % 3}</crew>' + "<oar>1</oar>" * (i % 4) + "</boat>\n" for i in range(40))
    (tmp_path / "fleet.xml").write_text(head + boats + '<boat k:no="40"/></boats><boater>9</boater></fleet>')
    c = Catalog(spark)
    c.register_xml("f", str(tmp_path / "fleet.xml"), row_tag="boat")
    request = [agg("crew", "sum", "crew"), agg("@no", "max", "last"), agg("@no", "count", "n")]
    assert result_rows(c.aggregate({"dataset": "f", "aggregations": request})) == [{"crew": 39.0, "last": 40.0, "n": 41.0}]


def test_datasets_are_views(spark):
    c = Catalog(spark)
    c.register_json("plums", [{"v": 2}, {"v": 3}])
    assert spark.sql("SELECT sum(v) AS s FROM plums").first().s == 5 and spark.table("plums").columns == ["v"]
    c.register_json("not a name", [{"v": 2}])
    c.register_json("plums", [{"v": 9}])
    assert spark.sql("SELECT sum(v) AS s FROM plums").first().s == 9
    with pytest.raises(ValueError, match="ordered"):
        c.register_dynamic("d", [{"v": 1}])
        c.aggregate({"dataset": "d", "aggregations": [agg("v", "sum", "s")]}, options=Options(nested_filter=True))


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans_have_no_nested_loops_nor_sorted_aggregates(spark):
    c = Catalog(spark)
    c.register_json("p", [{"g": "a", "v": 1, "x": [{"k": "u", "w": 2}]}, {"g": "b", "v": 3, "x": []}])
    for request in (
        {"where": {"v": {"$gt": 2}}, "aggregations": [agg("v", "sum", "s"), agg("x.w", "avg", "m")]},
        {"groupBy": ["g", "x.k"], "aggregations": [agg("x.w", "sum", "s"), agg("v", "sum", "p")]},
    ):
        for options in (Options(), Options(parent_dedup="record")):
            plan = plan_of(c.aggregate({"dataset": "p", **request}, options=options))
            assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortAggregate" not in plan


def test_global_aggregates_of_nothing(spark):
    c = Catalog(spark)
    c.register_json("p", [{"v": 1}, {"v": 3}])
    none = {"where": {"v": {"$gt": 9}}, "aggregations": [agg("v", "sum", "s"), agg("v", "max", "m")]}
    assert result_rows(c.aggregate({"dataset": "p", **none})) == [{"s": 0.0, "m": None}]
    c.register_df("q", spark.createDataFrame([], "v double"))
    assert result_rows(c.aggregate({"dataset": "q", **none})) == []
    assert result_rows(c.aggregate({"dataset": "q", "aggregations": none["aggregations"]})) == []
