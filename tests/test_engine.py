import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def same(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    try:
        return round(float(value), 6) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def names():
    from tambon.plans import SQL

    return sorted(SQL)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_against_sql(spark, duck, name):
    from tambon.plans import QUERIES, SQL

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(SQL[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert got == sorted(repr([same(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_engine_matches_kernel_and_runs_on_streams(spark, tmp_path):
    from tambon.operators.engine import AddressEngine
    from tambon.plans.messages import gazetteer, messages

    engine = AddressEngine(gazetteer(spark, SF))
    rows = messages(spark, SF, clean=False).select("id", "raw")
    batch = {r.id: (r.name, r.phone, r.zipcode) for r in engine.parse(rows).collect()}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = engine.parse(stream).writeStream.format("memory").queryName("parsed").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {r.id: (r.name, r.phone, r.zipcode) for r in spark.table("parsed").collect()} == batch
    finally:
        q.stop()


def test_ranges_and_numbers_on_columns(spark):
    from pyspark.sql import functions as F

    from tambon.functions import thai_text as t

    df = spark.createDataFrame([("a 12345 b 123456 ๑๒๓๔๕",), ("",), (None,)], "x string")
    got = [[tuple(r) for r in row[0]] if row[0] is not None else None for row in df.select(t.ranges(F.col("x"), t.POSTCODE)).collect()]
    assert got == [[(2, 7), (17, 22)], [], None]
    assert spark.range(1).select(t.phone_column(F.lit("+66 81 234 5678"))).first()[0] == "0812345678" == t.phone("+66 81 234 5678")
    assert t.phone("12") is None and t.postcode(" ๑๐๓๓๐ ") == "10330"


def test_records_are_checked(spark):
    from tambon.sources import readers

    good = '{"id":"1","raw":"ab","caseType":"c","difficulty":"d","spans":[{"label":"NAME","text":"a","start":0,"end":1,"codePointStart":0,"codePointEnd":1}],"expected":{"name":"z"},"seedLocation":{"subdistrict":"a","district":"b","province":"c","zipcode":"1"}}'
    lines = [good, "  ", good.replace('"text":"a"', '"text":"b"'), good.replace("NAME", "X"), good.replace('"zipcode":"1"', '"zipcode":""')]
    rows = readers.surface_gold(readers.parsed_records(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert [r.problem for r in rows] == [None, "a span's text is not at its offsets", "a span has a wrong label or range", "the location has an empty part"]
    assert rows[0].expected.name == "a" and rows[0].normalization_expected.name == "z"


RECORD = '{"id":"%s","raw":"ab","caseType":"c","difficulty":"d","spans":[{"label":"NAME","text":"a","start":0,"end":1,"codePointStart":0,"codePointEnd":1}],"expected":{"name":"z"},"seedLocation":{"subdistrict":"a","district":"b","province":"c","zipcode":"1"}}'


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from tambon.sources import readers

    for name, n in (("a", 3000), ("b", 1), ("c", 500)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i + 1}\n" + "\n" * (i % 7 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = readers.numbered_lines(spark, *(str(tmp_path / f"{x}.txt") for x in "abc")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(x, i + 1, line) for x in "abc" for i, line in enumerate((tmp_path / f"{x}.txt").read_text().split("\n")[:-1])}
    assert {(r.file[-5], r.line, r.value) for r in got} == want and len(got) == len(want)


def test_reading_records_names_lines_and_refuses_repeated_ids(spark, tmp_path):
    from tambon.sources import readers

    def read(**files):
        for name, lines in files.items():
            (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
        return readers.read_records(spark, *(str(tmp_path / f"{name}.jsonl") for name in files))

    good = [RECORD % i for i in range(4)]
    got = read(one=[good[0], "", good[1]], two=good[2:]).collect()
    assert sorted((r.id, r.family, r.expected.name) for r in got) == [("0", "one", "a"), ("1", "one", "a"), ("2", "two", "a"), ("3", "two", "a")]
    with pytest.raises(ValueError, match="line 3: duplicate id 0"):
        read(one=[good[0], "", good[0]])
    with pytest.raises(ValueError, match="duplicate id 1"):
        read(one=good[:2], two=[good[1]])
    for bad, said in ((good[1].replace('"c","difficulty"', '"c","hard"'), "line 3: 1: a required text is missing"), ("{", "line 3: .: a required text is missing")):
        with pytest.raises(Exception, match=said):
            read(one=[good[0], "", bad]).select("family").collect()
    with pytest.raises(ValueError, match="at least one"):
        readers.read_records(spark)


def test_funnel_by_spans_and_by_canonical_forms(spark):
    from tambon.operators import metrics

    fields = {f: None for f in metrics.FIELDS}
    hit = lambda label, start, end, canonical, outcome: (label, start, end, canonical, outcome)
    rows = [
        # The span " ann " without its white space is where a candidate stands, whose canonical form is another.
        ([("NAME", " ann ", 0, 5)], [hit("NAME", 1, 4, "Ann", "accepted"), hit("PHONE", 6, 9, "081", "pruned")], {"name": "ann", "phone": "081"}, {"name": "Ann", "phone": "081"}),
        # A candidate of the right form elsewhere counts for the form only.
        ([("NAME", "bob", 0, 3)], [hit("NAME", 4, 7, "bob", "abstained")], {"name": "bob"}, {"name": "bob"}),
        # Without a span the form decides; without an expected value nothing counts.
        ([("NAME", "   ", 0, 3)], [hit("NAME", 4, 7, "c", "accepted"), hit("PHONE", 8, 9, "1", "abstained")], {"phone": "1"}, {"name": "c", "phone": "1"}),
    ]
    flat = [(spans, trace, *(fields | gold).values(), *(fields | normal).values()) for spans, trace, gold, normal in rows]
    kinds = "spans array<struct<label:string,text:string,start:int,end:int>>, trace array<struct<label:string,start:int,end:int,canonical:string,outcome:string>>, " + ", ".join(f"{p}{f} string" for p in ("gold_", "form_") for f in fields)
    df = spark.createDataFrame(flat, kinds)
    got = {r.field: (r.expected, r.reachable, r.normalization_reachable, r.selected, r.accepted) for r in metrics.funnel(df, normal="form_", spans="spans").collect()}
    assert got == {"name": (2, 1, 2, 1, 1), "phone": (2, 2, 2, 1, 0)}
    plain = {r.field: (r.expected, r.reachable, r.normalization_reachable) for r in metrics.funnel(df).collect()}
    assert plain == {"name": (2, 1, 1), "phone": (2, 2, 2)}


def test_recipient_blocks(spark):
    from tambon.sources import readers

    text = "ชื่อผู้รับ: ก\r\nเบอร์โทร: 0812345678\r\nที่อยู่: 1 ถนน แขวงข เขตค กรุงเทพมหานคร 10330\r\n---\r\nmessy\n"
    blocks = readers.recipient_blocks(spark.createDataFrame([(text,)], "value string"))
    assert blocks.count() == 2
    row = readers.recipient_records(blocks).first()
    assert (row.id, row.style, row.address, row.zipcode) == ("recipient-list-0001", "bangkok", "1 ถนน", "10330")


def test_llm_is_optional(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert "parse_messages" in entry.queries() and not any(n.startswith("op") for n in entry.queries())


def test_pairwise_query_has_the_epochs_of_the_build(spark, monkeypatch):
    from tambon.plans import queries as m

    asked = {}
    monkeypatch.setattr(m, "_training", lambda *x: (None, []))
    monkeypatch.setattr(m, "_directions", lambda spark, found: found)
    monkeypatch.setattr(m, "fit_pairwise", lambda *x, **options: asked.update(options) or {})
    m.pairwise_directions(spark, "")
    assert asked["epochs"] == 4


def test_offsets_are_checked_in_both_units(spark):
    from tambon.sources import readers

    good = '{"id":"1","raw":"😀ab","caseType":"c","difficulty":"d","spans":[{"label":"NAME","text":"a","start":2,"end":3,"codePointStart":1,"codePointEnd":2}],"expected":{"name":"z"},"seedLocation":{"subdistrict":"a","district":"b","province":"c","zipcode":"1"}}'
    lines = [good, good.replace('"start":2', '"start":1'), good.replace('"end":3', '"end":4'), good.replace('"codePointEnd":2', '"codePointEnd":3')]
    said = [r.problem for r in readers.parsed_records(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert said == [None, *["a span's text is not at its offsets"] * 3]


def test_offsets_of_a_parse_are_utf16_units():
    from tambon.operators.kernel import Gazetteer, Options, Parser

    places = Gazetteer([dict(subdistrict="นาดี", district="บ้านสุข", province="ลำธาร", zipcode="61110")])
    raw = "คุณมาลัย 😀😀\n0899990001\nบ้านเลขที่ 3 ต.นาดี อ.บ้านสุข จ.ลำธาร 61110"
    units = raw.encode("utf-16-le")
    out = Parser(places, Options(diagnostics="full")).parse(raw)
    for x in [*out["spans"], *out["trace"]]:
        assert units[2 * x["start"] : 2 * x["end"]].decode("utf-16-le") == x["text"]
    points = Parser(places, Options(offsets="code-point")).parse(raw)["spans"]
    assert all(raw[x["start"] : x["end"]] == x["text"] for x in points) and points[-1]["start"] == out["spans"][-1]["start"] - 2
    with pytest.raises(ValueError):
        Options(offsets="bytes")


def test_a_split_with_an_empty_side_fails(spark):
    from tambon.operators import split

    rows = spark.createDataFrame([(k, "a", "b", "c", "1") for k in range(5)], "id long, subdistrict string, district string, province string, zipcode string")
    with pytest.raises(ValueError, match="no record"):
        split.complete(split.for_training(rows, "s"))


def test_artifacts_are_saved_gated_and_loaded(spark, tmp_path):
    import numpy as np

    from tambon.operators import provenance
    from tambon.operators.engine import AddressEngine
    from tambon.operators.scoring import Resources, load, save

    places = spark.createDataFrame([("นาดี", "บ้านสุข", "ลำธาร", "61110", 0)], "subdistrict string, district string, province string, zipcode string, location_id int")
    made = Resources("v1", 64, by_label={"NAME": 1.0}, directions={"NAME": (np.linspace(-1, 1, 64), 0.25)})
    save(made, places, f"file://{tmp_path}/a", gate={"enforced": True, "passed": True}, split={"seed": "s"})
    again, gazetteer = load(spark, f"file://{tmp_path}/a")
    assert again.kind == made.kind == "sparse-residual" and (again.directions["NAME"][0] == made.directions["NAME"][0]).all()
    text = spark.read.text(f"file://{tmp_path}/a/artifact").selectExpr("'a' as path", "value")
    assert provenance.artifact_gate(text).first().failures == []
    raw = spark.createDataFrame([("คุณมาลัย\n0899990001\nบ้านเลขที่ 3 ต.นาดี อ.บ้านสุข จ.ลำธาร 61110",)], "raw string")
    assert AddressEngine(gazetteer, again).parse(raw).first().confidence == AddressEngine(places, made).parse(raw).first().confidence
    save(made, places, f"file://{tmp_path}/b")
    places.withColumn("zipcode", places.zipcode.substr(1, 4)).write.mode("overwrite").parquet(f"file://{tmp_path}/b/gazetteer")
    with pytest.raises(ValueError, match="changed"):
        load(spark, f"file://{tmp_path}/b")


def test_supplements_reports_and_other_parsers(spark, tmp_path):
    from pyspark.sql import functions as F

    from tambon.sources import readers

    blocks = spark.createDataFrame([(1, "ชื่อผู้รับ: ก\nเบอร์โทร: 0899990001\nที่อยู่: 1 ถนน ตำบลข อำเภอค จังหวัดง 61110"), (2, "messy")], "number int, raw string")
    extra = spark.createDataFrame([("messy", "ก")], "raw string, name string")
    assert [(r.number, r.name) for r in readers.supplemented(blocks, extra).collect()] == [(2, "ก")]
    with pytest.raises(Exception, match="no annotation of block 2"):
        readers.supplemented(blocks, extra.where("false")).collect()
    readers.write_report(extra, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first().name == "ก"
    got = readers.external(blocks, lambda rows: rows.withColumns({"name": F.lit(""), "phone": F.lit("1")}), ["name", "phone"]).first()
    assert got.name is None and got.phone == "1"


def test_parsing_streams_to_parquet(spark, tmp_path):
    from tambon.operators.engine import AddressEngine
    from tambon.streaming import parse_stream

    places = spark.createDataFrame([("นาดี", "บ้านสุข", "ลำธาร", "61110", 0)], "subdistrict string, district string, province string, zipcode string, location_id int")
    rows = spark.createDataFrame([("คุณมาลัย\n0899990001\nต.นาดี อ.บ้านสุข จ.ลำธาร 61110",)], "raw string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    parse_stream(AddressEngine(places), stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").first().phone == "0899990001"


def test_core_queries_survive_an_llm_that_cannot_be_imported(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "parse_messages" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
