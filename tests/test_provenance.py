import hashlib
import json

from tambon.operators import provenance
from tambon.operators.structured import structured_tuples

PLACES = [(0, "ก", "ข", "ค", "10001"), (1, "ง", "ข", "ค", "10001"), (2, "จ", "ช", "ค", "10001")]


def test_structured_tuples_fall_back_by_steps(spark):
    places = spark.createDataFrame(PLACES, "location_id int, subdistrict string, district string, province string, zipcode string")
    text = "x ตำบล{} อำเภอ{} จังหวัดค {}"
    rows = [(1, text.format("ก", "ข", "10001")), (2, text.format("ฮ", "ข", "10001")), (3, text.format("ฮ", "ฮ", "10001")), (4, text.format("ก", "ข", "99999")), (5, None), (6, ""), (7, text.format("ก", "ข", "10001") + "5")]
    got = structured_tuples(spark.createDataFrame(rows, "id int, raw string"), places).collect()
    ids = {}
    for r in got:
        assert rows[r.id - 1][1][r.start : r.end] == r.canonical
        if r.label == "PROVINCE":
            ids.setdefault(r.id, set()).add(r.location_id)
    assert ids == {1: {0}, 2: {0, 1}, 3: {0, 1, 2}, 4: {None}}


def test_set_checksum_ignores_order(spark):
    rows = [("a", "2"), ("a", "1"), ("b", None)]
    got = {r.k: r for r in provenance.set_checksum(spark.createDataFrame(rows, "k string, checksum string"), ["k"]).collect()}
    assert got["a"].checksum == hashlib.sha256(b"1\0002").hexdigest() and (got["b"].members, got["b"].checksum) == (0, hashlib.sha256(b"").hexdigest())


def test_evaluation_drift(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "z")], "id string, raw string")
    kept = [{"id": "a", "raw": "y"}, {"id": "b", "raw": "x"}]
    checksum = hashlib.sha256(json.dumps(kept, separators=(",", ":")).encode()).hexdigest()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    problem = lambda i, c: provenance.evaluation_drift(rows, i, ["id", "raw"], c).first().problem
    assert problem(ids("a", "b"), checksum) is None
    assert problem(ids("a", "b", "q"), checksum) == "records are missing or repeated"
    assert problem(ids("a", "b"), "0") == "records differ"


def test_references_of_a_source_tree(spark, tmp_path):
    for name, text in {"a.ts": 'x "resources/generated/one.json"', "deep/b.tsx": "resources/generated/one.json resources/generated/t-2.json", "node_modules/c.ts": "resources/generated/no.json", "d.md": "resources/generated/no.json"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = provenance.references(provenance.source_texts(spark, str(tmp_path)), "value")
    assert sorted(r.reference for r in found.collect()) == ["resources/generated/one.json", "resources/generated/t-2.json"]


def test_artifact_gate(spark):
    good = {"promotionGate": {"enforced": True, "passed": True, "ablationApplicable": False}}
    scaled = good | {"resources": {"scoringConfig": {"residualScaleByLabel": {"NAME": 1, "PHONE": 2}}}}
    rows = [("good", json.dumps(good)), ("scaled", json.dumps(scaled)), ("bad", "{"), ("gone", None), ("lost", json.dumps({"promotionGate": {"enforced": True}}))]
    got = {r.path: (r.failures, r.ablated) for r in provenance.artifact_gate(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert got == {"good": ([], False), "scaled": (["scale of PHONE"], False), "bad": (["no gate"], True), "gone": (["missing"], True), "lost": (["not passed"], True)}
