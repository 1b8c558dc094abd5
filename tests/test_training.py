"""Fitting of directions against plain loops over the same records."""

import random
import re
import unicodedata

import pytest

from tambon.functions import thai_text as text
from tambon.operators import kernel, scoring, training
from tambon.operators.kernel import FIELD, Gazetteer, Parser
from tambon.operators.scoring import Resources

PLACES = [dict(subdistrict="นาดี", district="บ้านสุข", province="ลำธาร", zipcode="61110"), dict(subdistrict="ต้นไม้", district="เมืองลำธาร", province="ลำธาร", zipcode="61000")]
NAMES = ["คุณมาลัย ใจดี", "นายสมชาย", "มาลี รุ่งเรือง", "อาจารย์แก้ว"]
KINDS = "id long, raw string, weight double, spans array<struct<label:string,start:int,end:int>>, " + ", ".join(f"{f} string" for f in FIELD.values())


def records():
    """Messages of two places in three forms, with and without the name's span, weights of 0, 1 and 2, in no order."""
    out = []
    for i in range(18):
        name, place, end = NAMES[i % 4], PLACES[i % 2], ("\n", " ", "")[i % 3]
        phone, address = f"08{i:08d}", f"บ้านเลขที่ {i + 1} ถนนสุข"
        raw = f"{name}{end}{phone}{end}{address} ต.{place['subdistrict']} อ.{place['district']} จ.{place['province']} {place['zipcode']}"
        values = {"name": name, "phone": phone, "address": address, **place}
        spans = [(label, raw.index(values[f]), raw.index(values[f]) + len(values[f])) for label, f in FIELD.items() if label != "NAME" or i % 5]
        out.append((i * 7 % 18, raw, float(i % 3), spans, *(values[f] for f in FIELD.values())))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(records(), KINDS).coalesce(1)


def test_records_of_one_file_are_dealt_over_the_cores(spark, frame):
    assert training._dealt(frame).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_feature_that_recurs_is_hashed_once(monkeypatch):
    hashed, plain = [], scoring.fnv1a
    monkeypatch.setattr(scoring, "fnv1a", lambda text: hashed.append(text) or plain(text))
    parser, r = Parser(Gazetteer(PLACES)), Resources("p", 211)
    scan, seeds, _ = parser.seeds(records()[0][1])
    first = [scoring.candidate_features(scan, s, r) for s in seeds]
    assert len(hashed) == len(set(hashed)) > 0
    assert [scoring.candidate_features(scan, s, r) for s in seeds] == first and len(hashed) == len(set(hashed))


def test_pairwise_updates_are_those_of_a_plain_loop(spark, frame):
    r, l2 = Resources("p", 128, by_label={"NAME": 1.0, "PHONE": 0.5, "ADDRESS_DETAIL": 1.0}), 0.02
    parser, want = Parser(Gazetteer(PLACES)), {}
    for label in ("NAME", "PHONE", "ADDRESS_DETAIL"):
        w, bias = [0.0] * r.dimension, 0.0
        for epoch in range(3):
            for _, raw, weight, spans, *_ in sorted(records()):
                if not weight:
                    continue
                scan, seeds, _ = parser.seeds(raw)
                gold = next(((a, b) for x, a, b in spans if x == label), None)
                mine = [s for s in seeds if s.label == label]
                right = [s for s in mine if (s.start, s.end) == gold]
                wrong = sorted((s for s in mine if (s.start, s.end) != gold), key=lambda s: -s.evidence)[:4]
                pairs = [(a, b) for a in right for b in (None, *wrong)] if gold else [(None, b) for b in wrong]
                for pair in pairs:
                    sides = [(scoring.candidate_features(scan, s, r), sign, scoring.logit(s.evidence)) for s, sign in zip(pair, (1, -1), strict=True) if s is not None]
                    presence = sum(sign for _, sign, _ in sides)
                    margin = bias * presence + sum(sign * (fixed + sum(w[i] * v for i, v in x.items())) for x, sign, fixed in sides)
                    pull, step = scoring.sigmoid(-margin), 0.04 / (epoch + 1) ** 0.5 * weight
                    for i in {i for x, *_ in sides for i in x}:
                        w[i] += step * (pull * sum(sign * x.get(i, 0) for x, sign, _ in sides) - l2 * w[i])
                    bias += step * pull * presence
        want[label] = w, bias
    got = training.fit_pairwise(frame, PLACES, r, epochs=3, l2=l2, negatives=4)
    assert list(got) == list(want) and any(abs(x) > 0.01 for x in want["PHONE"][0])
    for label, (vector, bias) in got.items():
        assert vector.tolist() == pytest.approx(want[label][0], abs=1e-10) and bias == pytest.approx(want[label][1], abs=1e-10)


MIX = Resources("c", 96, "char-ngram-v2", scoring="label-mix-v1")


def unit(v):
    return v / (v @ v) ** 0.5


def close(got, want):
    assert set(got) == set(want)
    for label, vector in want.items():
        assert got[label][0].tolist() == pytest.approx(vector.tolist(), abs=1e-6) and got[label][1] == 0


def test_spans_of_several_texts_are_those_of_one(monkeypatch):
    texts = ["คุณมาลัย\n0812345678 é", "é ก 12", "", "😀 ต.นาดี"]
    spans = [(k, a, b) for k, x in enumerate(texts) for a in range(len(x) + 1) for b in range(a, len(x) + 1)]
    for some in (spans, [x for x in spans if x[0] != 1]):
        found = scoring.span_matrix([x if k != 1 or some is spans else "" for k, x in enumerate(texts)], some, MIX)
        assert all((row == scoring.span_features(texts[k], a, b, MIX)).all() for row, (k, a, b) in zip(found, some, strict=True))
    hashed, plain = [], scoring.fnv1a
    monkeypatch.setattr(scoring, "fnv1a", lambda text: hashed.append(text) or plain(text))
    scoring.span_matrix(["คุณแก้วตา"] * 9, [(k, 0, 8) for k in range(9)], Resources("c", 97, "char-ngram-v2", scoring="label-mix-v1"))
    assert len(hashed) == len(set(hashed)) > 0


def test_centroids_are_those_of_a_plain_loop(frame):
    sums, weights = {}, {}
    for _, raw, weight, spans, *_ in records():
        for label, a, b in spans:
            sums[label] = sums.get(label, 0) + weight * scoring.span_features(raw, a, b, MIX).astype(float)
            weights[label] = weights.get(label, 0) + weight
    whole, total = sum(sums.values()), sum(weights.values())
    close(training.fit_centroids(frame, MIX), {x: unit(sums[x] / weights[x] - (whole - sums[x]) / (total - weights[x])) for x in sums})


def test_the_postcode_of_a_training_record_is_not_taken_from_its_phone(spark, tmp_path):
    from tambon.plans import queries

    spark.createDataFrame([(100103, 10, "A"), (100105, 10, "A"), (100106, 10, "B")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    rows = {r.id: (r.raw, [(s.start, s.end) for s in r.spans if s.label == "POSTCODE"]) for r in queries._training(spark, str(tmp_path))[0].collect()}
    assert all("10010" in raw[:40] for raw, _ in rows.values())
    raw, found = rows[100103]
    assert found == [(raw.rindex("10010"), len(raw))]
    assert rows[100105][1] == rows[100106][1] == []  # written without a postcode, and with another one


@pytest.mark.parametrize("negatives", [1, 32])
def test_contrast_is_that_of_a_plain_loop(frame, negatives):
    parser, sums, weights = Parser(Gazetteer(PLACES)), {}, {}
    for _, raw, weight, _, *expected in records():
        if not weight:
            continue
        scan, seeds, _ = parser.seeds(raw)
        parser.score(scan, seeds)
        for label, wanted in zip(FIELD, expected, strict=True):
            mine = [s for s in seeds if s.label == label]
            wrong = sorted((s for s in mine if s.canonical != wanted), key=lambda s: (-s.evidence, -s.score))[:negatives]
            for side, group in ((1, [s for s in mine if s.canonical == wanted]), (0, wrong)):
                if group:
                    mean = sum(scoring.span_features(raw, s.start, s.end, MIX).astype(float) for s in group) / len(group)
                    sums[label, side] = sums.get((label, side), 0) + weight * mean
                    weights[label, side] = weights.get((label, side), 0) + weight
    means = {k: v / weights[k] for k, v in sums.items()}
    want = {label: unit(means[label, 1] - means[label, 0]) for label, side in means if side and (label, 0) in means}
    assert {"NAME", "ADDRESS_DETAIL"} <= set(want)
    close(training.fit_contrast(frame, PLACES, MIX, negatives=negatives), want)


def test_a_task_sends_its_sums_not_its_records(spark, frame, monkeypatch):
    sent, plain = spark.sparkContext.accumulator(0), training._sums
    monkeypatch.setattr(training, "_dealt", lambda records: records.coalesce(1))

    def counted(*args):
        out = plain(*args)
        sent.add(out.num_rows)
        return out

    monkeypatch.setattr(training, "_sums", counted)
    training.fit_contrast(frame.unionByName(frame).unionByName(frame), PLACES, MIX)
    assert 0 < sent.value <= 2 * len(FIELD) * (MIX.dimension + 1)


ODD = ["คุณ", "นาง", "นางสาว", "บ้านเลขที่", "ถนน", "คอนโด", "ต.", "อ.", "จ.", "ตำบล", "ต .", "ผู้รับ:", "ที่อยู่:", "โทร:", "0812345678", " ", "  ", "\n", "\r\n", ",", ";", "|", "61110", "นาดี", "บ้านสุข", "ลำธาร", "1/2", "é", "é", "😀", "　", "ด.ช.", "เมือง", "๑๒", "A"]


def odd_texts(n):
    dice = random.Random(7)
    return ["", " ", ",;", *("".join(dice.choices(ODD, k=dice.randrange(1, 24))) for _ in range(n))]


def test_candidates_of_several_messages_become_vectors_in_one_call(spark, frame, monkeypatch):
    calls, sent, plain, sums = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), scoring.span_matrix, training._sums
    monkeypatch.setattr(training, "_dealt", lambda records: records.coalesce(1))

    def matrix(*args):
        calls.add(1)
        return plain(*args)

    def counted(*args):
        out = sums(*args)
        sent.add(out.num_rows)
        return out

    monkeypatch.setattr(training, "span_matrix", matrix)
    monkeypatch.setattr(training, "_sums", counted)
    weighted = sum(x[2] > 0 for x in records())
    training.fit_contrast(frame, PLACES, MIX)
    assert 0 < calls.value <= -(-len(records()) // training.CANDIDATES_OF) < weighted
    assert 0 < sent.value <= 2 * 2 * len(FIELD)  # a row per label and side, from the one task and where they are merged


def test_a_record_without_text_adds_nothing(spark, frame):
    empty = spark.createDataFrame([(99, None, 1.0, [], *[None] * 7), (98, "", 1.0, [], *[None] * 7)], KINDS)
    want = {label: vector for label, (vector, _) in training.fit_contrast(frame, PLACES, MIX).items()}
    close(training.fit_contrast(frame.unionByName(empty), PLACES, MIX), want)


def test_what_a_segments_start_decides_is_looked_up_once(monkeypatch):
    starts, plain = [], kernel.Scan.beginning
    monkeypatch.setattr(kernel.Scan, "beginning", lambda scan, start: starts.append(start) or plain(scan, start))
    Parser(Gazetteer(PLACES)).seeds(records()[0][1])
    assert len(starts) == len(set(starts)) > 1


def plain_evidence(scan, start, end):
    """Evidence of one segment, each rule by its pattern."""
    raw = scan.raw
    after = lambda ranges: any(not text.strip(raw[x[1] : start]) for x in ranges)
    has = lambda pattern: re.compile(pattern).search(raw, start, end)
    word, digit, title = has(text.ADDRESS_WORD), has("[0-9]"), re.compile(text.TITLE).match(raw, start, end)
    prefixes = sum(a[0] < end and start < a[1] for a in scan.admin)
    thai = sum("ก" <= c <= "๙" for c in raw[start:end])
    first = not text.strip(raw[:start]) and scan.last_phone > end and "\n" not in raw[start:end]
    name = 0.96 if after(scan.to) or first else 0.94 if title else 0.62 if not digit and thai / (end - start) > 0.7 else 0.2
    address = 0.94 if after(scan.at) or word or re.compile("[0-9]").match(raw, start, end) else 0.45
    before_admin = any(a[0] >= end and not text.strip(raw[end : a[0]]) for a in scan.coherent)
    starts_line = start == 0 or after(b for b in scan.breaks if b[1] <= start)
    address += sum([-0.4 * bool(title), 0.04 * before_admin, -0.08 * (prefixes > 1), 0.04 * starts_line, -0.02 * (prefixes > 0 and "," in raw[start:end])])
    return max(0.0, name - 0.5 * bool(word or digit)), max(0.0, address)


def test_segments_have_the_evidence_of_each_rule():
    parser, seen = Parser(Gazetteer(PLACES)), 0
    for raw in [*(x[1] for x in records()), *odd_texts(400)]:
        scan, seeds, _ = parser.seeds(raw)
        for s in seeds:
            if s.source == "segment":
                want = plain_evidence(scan, s.start, s.end)[s.label == "ADDRESS_DETAIL"]
                assert s.evidence == pytest.approx(want, abs=1e-12), (raw, s)
                seen += 1
        spans = [(s.label, s.start, s.end) for s in seeds if s.source == "segment"]
        assert len(spans) == len(set(spans))
    assert seen > 3000


@pytest.mark.parametrize("least, most", [(1, 4), (2, 3), (3, 5)])
def test_span_vectors_are_those_of_counted_n_grams(least, most):
    r = Resources("c", 37, "char-ngram-v2", least, most, scoring="label-mix-v1")
    texts = odd_texts(12)
    spans = [(k, a, b) for k, x in enumerate(texts) for a in range(0, len(x) + 1, 2) for b in (a, a + 1, a + 2, a + 3, len(x)) if b <= len(x)]
    for some in ([k for k, x in enumerate(texts) if unicodedata.is_normalized("NFC", x)], range(len(texts))):
        chosen = [x for x in spans if x[0] in some]
        found = scoring.span_matrix([x if k in some else "" for k, x in enumerate(texts)], chosen, r)
        for row, (k, a, b) in zip(found, chosen, strict=True):
            raw, part, want = texts[k], unicodedata.normalize("NFC", texts[k][a:b]), [0.0] * 37
            names = [(f"g{len(g)}:{g}", 1) for g in scoring.grams(part, least, most)]
            names += [(f"len:{min(32, len(part) // 2)}", 0.5), (f"left:{raw[max(0, a - 3) : a] or '<BOS>'}", 0.75), (f"right:{raw[b : b + 3] or '<EOS>'}", 0.75)]
            names += [(f"shape:{name}", w) for name, w, pattern in (("digit", 1.5, ".*[0-9]"), ("thai", 1.5, ".*[ก-๙]"), ("numeric", 2.0, rf"[+0-9{text.S}-]+\Z")) if re.match(pattern, part, re.S)]
            for name, w in names:
                at, sign = scoring.slot(name, 37)
                want[at] += sign * w
            norm = sum(x * x for x in want) ** 0.5 or 1.0
            assert row.tolist() == pytest.approx([x / norm for x in want], abs=1e-6), (raw, a, b)
