"""Registered queries over whole tables, and the SQL they are held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import thai_text as t
from ..operators import metrics, provenance, split
from ..operators.engine import AddressEngine
from ..operators.kernel import FIELD, Options
from ..operators.scoring import Resources
from ..operators.structured import structured_tuples as tuples_of
from ..operators.training import family_weights, fit_centroids, fit_contrast, fit_pairwise
from ..sources import readers
from .messages import gazetteer, gazetteer_sql, messages, messages_sql

FIELDS = list(FIELD.values())
MOST_PROVINCES = 1000
QUERIES: dict = {}
SQL: dict[str, str] = {}
CLEAN, MESSY, PLACES = (messages_sql(True, True), messages_sql(False, True), gazetteer_sql(True))

# What the rules give for messy messages, worked out from how these are made, not from the parser.
# Styles 1 and 2 have no valid zipcode. In style 6 the province is misspelt by one letter: it is recovered as the first place of that
# province, so it agrees with the other parts for messages of that place alone, and is dropped for all others.
FOUND = f"""select m.id, m.style, m.family, m.raw, gold_name as name, gold_phone as phone, gold_address as address, gold_subdistrict as subdistrict, gold_district as district,
  case when style <> 6 or gold_zipcode = f.first then gold_province end as province, case when style not in (1, 2) then gold_zipcode end as zipcode, {', '.join(f'gold_{f}' for f in FIELDS)}
  from ({MESSY}) m join (select province, min(zipcode) as first from ({PLACES}) g group by province) f on f.province = m.gold_province"""
# The rules' evidence by style: labelled values and structured suffixes 0.995, first lines 0.97, titles and address words 0.94 (with 0.04 each for
# the start of a line and what follows), prefixed places 0.98, mentions 0.96, Thai digits' zipcodes 0.94, a distance of 1 in 12 letters 0.5 + 0.35 * (11 / 12 * 100 - 80) / 20.
_THAI = "translate({x}, '0123456789', '๐๑๒๓๔๕๖๗๘๙')"
_SPANS = {
    "NAME": ("name", "name", "case style when 3 then 0.995 when 4 then 0.94 else 0.97 end"),
    "PHONE": ("phone", f"case style when 5 then {_THAI.format(x='phone')} else phone end", "0.99"),
    "ADDRESS_DETAIL": ("address", "address", "case style when 3 then 0.995 when 4 then 0.94 else 1.0 end"),
    "SUBDISTRICT": ("subdistrict", "subdistrict", "case style when 3 then 0.995 when 4 then 0.96 else 0.98 end"),
    "DISTRICT": ("district", "district", "case style when 3 then 0.995 when 4 then 0.96 else 0.98 end"),
    "PROVINCE": ("province", "case style when 6 then 'เชีบง' || substr(province, 6) else province end", "case style when 3 then 0.995 when 4 then 0.96 when 7 then 0.96 when 6 then 0.704167 else 0.98 end"),
    "POSTCODE": ("zipcode", f"case style when 5 then {_THAI.format(x='zipcode')} else zipcode end", "case style when 3 then 0.995 when 5 then 0.94 else 0.96 end"),
}
SPANS = " union all ".join(f"select id, style, '{label}' as label, '{f}' as field, {f} as canonical, cast(instr(raw, {text}) - 1 as integer) as start, cast(instr(raw, {text}) - 1 + length({text}) as integer) as \"end\", cast({value} as double) as confidence from ({FOUND}) x where {f} is not null" for label, (f, text, value) in _SPANS.items())
RIGHT = {f: f"coalesce({f} = gold_{f}, false)" for f in FIELDS}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(spark, sf_dir, clean=False, **options) -> DataFrame:
    return AddressEngine(gazetteer(spark, sf_dir), options=Options(**options)).parse(messages(spark, sf_dir, clean))


# Parsing


@query(f"select id, {', '.join(f'gold_{f} as {f}' for f in FIELDS)}, cast(7 as bigint) as spans, cast(0 as bigint) as abstained from ({CLEAN}) m")
def parse_messages(spark, sf_dir):
    return _parsed(spark, sf_dir, clean=True).select("id", *FIELDS, F.size("spans").cast("long").alias("spans"), F.size("abstentions").cast("long").alias("abstained"))


@query(f"select x.id, x.style, {', '.join(f'x.{f}' for f in FIELDS)}, round(s.confidence, 4) as confidence from ({FOUND}) x join (select id, avg(confidence) as confidence from ({SPANS}) s group by id) s on s.id = x.id")
def parse_messy_messages(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "style", *FIELDS, F.round("confidence", 4).alias("confidence"))


@query(f"select id, label, canonical, start, \"end\", round(confidence, 4) as confidence, true as at_offsets from ({SPANS}) s")
def parsed_spans(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("id", "raw", F.explode("spans").alias("s"))
    return rows.select("id", "s.label", "s.canonical", "s.start", "s.end", F.round("s.confidence", 4).alias("confidence"), (F.substring("raw", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.text")).alias("at_offsets"))


@query(f"select style, field, 'low-confidence' as reason, count(*) as n from ({SPANS}) s where confidence < 0.975 group by style, field")
def abstentions(spark, sf_dir):
    """With a floor above most of the rules' evidence, so that there is something to abstain from."""
    return _parsed(spark, sf_dir, min_field_confidence=0.975).select("id", "style", F.explode("abstentions").alias("a")).groupBy("style", "a.field", "a.reason").agg(F.count("*").alias("n"))


@query()
def candidate_trace(spark, sf_dir):
    rows = _parsed(spark, sf_dir, diagnostics="full").select("style", F.explode("trace").alias("c"))
    return rows.groupBy("style", "c.label", "c.source", "c.outcome", "c.reason").agg(F.count("*").alias("n"), F.round(F.avg("c.score"), 6).alias("mean_score"))


def _funnel_sql() -> str:
    reachable = {f: "count(zipcode)" if f == "zipcode" else "count(*)" for f in FIELDS}  # a misspelt province has its candidate, whether it is chosen or not
    rates = lambda x: f"cast({x} as double) / count(*)"
    return " union all ".join(f"select '{f}' as field, count(*) as expected, {reachable[f]} as reachable, {reachable[f]} as normalization_reachable, count({f}) as selected, count({f}) as accepted, {rates(reachable[f])} as reachable_rate, {rates(reachable[f])} as normalization_reachable_rate, {rates(f'count({f})')} as selected_rate, {rates(f'count({f})')} as accepted_rate from ({FOUND}) x" for f in FIELDS)


@query(_funnel_sql())
def candidate_funnel(spark, sf_dir):
    return metrics.funnel(_parsed(spark, sf_dir, diagnostics="full"))


@query()
def rule_histograms(spark, sf_dir):
    return metrics.histograms(_parsed(spark, sf_dir, diagnostics="full"))


_EXACT = " and ".join(RIGHT.values())


@query(f"select style, family, count(*) as records, count(*) filter (where {_EXACT}) as exact_records, {', '.join(f'count(*) filter (where {x}) as correct_{f}' for f, x in RIGHT.items())}, cast(grouping(style) as integer) as all_style, cast(grouping(family) as integer) as all_family, round(count(*) filter (where {_EXACT}) / cast(count(*) as double), 9) as exact_accuracy from ({FOUND}) x group by grouping sets ((), (style), (family))")
def accuracy_slices(spark, sf_dir):
    out = metrics.exact_accuracy(_parsed(spark, sf_dir), by=["style", "family"])
    return out.withColumns({"all_style": F.col("all_style").cast("int"), "all_family": F.col("all_family").cast("int"), "exact_accuracy": F.round("exact_accuracy", 9)})


@query("select count(*) as records, count(*) as exact_records, " + ", ".join(f"count(*) as correct_{f}" for f in FIELDS) + ", cast(1 as double) as exact_accuracy from customer join nation on c_nationkey = n_nationkey")
def exact_accuracy_clean(spark, sf_dir):
    return metrics.exact_accuracy(_parsed(spark, sf_dir, clean=True))


@query(f"select cast(least(9, floor(round(confidence * 10, 6))) as integer) as bin, count(*) as samples, round(avg(confidence), 4) as mean_confidence, cast(1 as double) as accuracy, round(sum((confidence - 1) * (confidence - 1)) / (select count(*) from ({SPANS}) s), 6) as brier_part, round(abs(sum(confidence) - count(*)) / (select count(*) from ({SPANS}) s), 6) as ece_part from ({SPANS}) s group by 1")
def parse_calibration(spark, sf_dir):
    gold = F.element_at(F.create_map(*[F.lit(x) if i % 2 == 0 else x for label, f in FIELD.items() for i, x in enumerate((label, F.col(f"gold_{f}")))]), F.col("s.label"))
    rows = _parsed(spark, sf_dir).select("*", F.explode("spans").alias("s"))
    out = metrics.calibration(rows.select(F.col("s.confidence").alias("confidence"), F.col("s.canonical").eqNullSafe(gold).alias("correct")))
    return out.select("bin", "samples", F.round("mean_confidence", 4).alias("mean_confidence"), "accuracy", F.round("brier_part", 6).alias("brier_part"), F.round("ece_part", 6).alias("ece_part"))


@query()
def ablation(spark, sf_dir):
    """Evidence alone against label mixing without directions, on the same records."""
    rows, places = messages(spark, sf_dir, False), gazetteer(spark, sf_dir)
    mixed = Resources("mix", 64, "char-ngram-v2", scoring="label-mix-v1", by_label=dict.fromkeys(FIELD, 0.55))
    arms = {"evidence": None, "label_mix": mixed}
    parts = [metrics.exact_accuracy(AddressEngine(places, r).parse(rows)).select(F.lit(name).alias("arm"), "records", "exact_records", "exact_accuracy") for name, r in arms.items()]
    return parts[0].unionByName(parts[1])


# Scans and text functions


@query(f"select id, len(regexp_extract_all(raw, '[+]?[0-9]{{9,10}}')) as phones, len(list_filter(regexp_extract_all(raw, '[0-9๐-๙]+'), lambda x: length(x) = 5)) as postcodes, len(regexp_extract_all(raw, '\\||\\r?\\n')) as breaks, len(regexp_extract_all(raw, '(?:ชื่อผู้รับ|ผู้รับ|ชื่อ)\\s*[:：]\\s*')) as to_labels from ({CLEAN}) m")
def scan_counts(spark, sf_dir):
    n = lambda p: F.size(t.ranges(F.col("raw"), p)).cast("long")
    return messages(spark, sf_dir).select("id", n(t.PHONE).alias("phones"), n(t.POSTCODE).alias("postcodes"), n(t.SEPARATOR).alias("breaks"), n(t.RECIPIENT_LABEL).alias("to_labels"))


@query(f"select id, cast(instr(raw, gold_phone) - 1 as bigint) as first_start, cast(instr(raw, gold_phone) + 9 as bigint) as first_end from ({CLEAN}) m")
def phone_ranges(spark, sf_dir):
    r = F.get(t.ranges(F.col("raw"), t.PHONE), F.lit(0))
    return messages(spark, sf_dir).select("id", r["start"].cast("long").alias("first_start"), r["end"].cast("long").alias("first_end"))


@query(f"select id, cast(len(regexp_extract_all(raw, '(?:แขวง|ตำบล|ต\\s*\\.|เขต|อำเภอ|อ\\s*\\.|จังหวัด|จ\\s*\\.)\\s*')) as bigint) as prefixes from ({MESSY}) m")
def admin_prefixes(spark, sf_dir):
    return messages(spark, sf_dir, False).select("id", F.size(t.ranges(F.col("raw"), t.ADMIN)).cast("long").alias("prefixes"))


@query(f"select id, gold_phone as phone, gold_zipcode as zipcode from ({CLEAN}) m")
def normalized_numbers(spark, sf_dir):
    m = messages(spark, sf_dir)
    thai = lambda c: F.translate(F.col(c), "0123456789", t.THAI_DIGITS)
    return m.select("id", t.phone_column(F.concat(F.lit("+66-"), F.substring(thai("gold_phone"), 2, 20))).alias("phone"), t.postcode_column(F.concat(F.lit(" "), thai("gold_zipcode"), F.lit("."))).alias("zipcode"))


@query("select doc_id, nullif(trim(regexp_replace(text, '[\\t-\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')), '') as text from documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.squeeze_column(F.col("text")).alias("text"))


@query("select doc_id, cast(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 5)) as bigint) as fives from documents")
def digit_runs_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.ranges(F.col("text"), t.POSTCODE)).cast("long").alias("fives"))


@query("select a.p_partkey, cast(levenshtein(a.p_name, b.p_name) as bigint) as distance, round((length(a.p_name) + length(b.p_name) - levenshtein(a.p_name, b.p_name)) * 100.0 / (length(a.p_name) + length(b.p_name)), 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("distance"), F.round(t.similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@query("select l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 9) as sigmoid, round(ln(greatest(0.0001, least(0.9999, l_discount)) / (1 - greatest(0.0001, least(0.9999, l_discount)))), 9) as logit from lineitem")
def score_functions(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(t.sigmoid(d * 10 - 0.5), 9).alias("sigmoid"), F.round(t.logit(d), 9).alias("logit"))


_FNV = "list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split({x}, ''), lambda c: cast(unicode(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"select doc_id, {_FNV.format(x=chr(39) + 'seed' + chr(39) + ' || cast(doc_id as varchar)')} % 10000 as bucket from documents")
def hash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (t.fnv1a(F.concat(F.lit("seed"), F.col("doc_id").cast("string"))) % 10_000).alias("bucket"))


# Gazetteer


@query(f"with g as ({PLACES}) select 'SUBDISTRICT' as label, subdistrict as surface, subdistrict as canonical, location_id from g union all select 'DISTRICT', district, district, location_id from g union all select 'PROVINCE', province, province, location_id from g union all select 'POSTCODE', zipcode, zipcode, location_id from g")
def gazetteer_terms(spark, sf_dir):
    return readers.terms(gazetteer(spark, sf_dir))


@query(f"select subdistrict, district, province, zipcode, cast(row_number() over (order by location_id) - 1 as integer) as location_id from ({PLACES}) g")
def gazetteer_scan(spark, sf_dir):
    g = gazetteer(spark, sf_dir)
    names = g.select(F.concat(F.lit("ต."), "subdistrict", F.lit(", อำเภอ"), "district", F.lit(" ,จังหวัด"), "province", F.lit(", "), "zipcode").alias("name"), F.col("location_id").alias("position"))
    return readers.gazetteer(names.union(names))


@query(f"with g as ({PLACES}) select label, province, count(*) as terms from (select 'SUBDISTRICT' as label, province from g union all select 'DISTRICT', province from g union all select 'PROVINCE', province from g) x group by label, province")
def fuzzy_index_counts(spark, sf_dir):
    g = gazetteer(spark, sf_dir)
    return readers.terms(g).where("label <> 'POSTCODE'").join(g.select("location_id", "province"), "location_id").groupBy("label", "province").agg(F.count("*").alias("terms"))


@query(f"with g as ({PLACES}), m as ({MESSY}), p as (select distinct province from g), h as (select m.id, p.province, len(m.raw) - instr(reverse(m.raw), reverse(p.province)) as place from m join p on contains(m.raw, p.province)) select id, arg_max(province, place * 1000 + length(province)) as hint from h group by id")
def province_hint(spark, sf_dir):
    """The last province mentioned: a contains-join with the few distinct provinces, a checked dimension."""
    m, p = messages(spark, sf_dir, False).select("id", "raw"), gazetteer(spark, sf_dir).select("province").distinct()
    if p.count() > MOST_PROVINCES:
        raise ValueError(f"more than {MOST_PROVINCES} provinces are no dimension to send to every task")
    hits = m.join(F.broadcast(p), F.col("raw").contains(F.col("province")))
    at = F.length("raw") - F.expr("locate(reverse(province), reverse(raw))")
    return hits.groupBy("id").agg(F.max_by("province", F.struct(at, F.length("province"))).alias("hint"))


@query(f"with g as ({PLACES}), m as ({CLEAN}) select m.id, count(*) filter (where g.zipcode = m.gold_zipcode) as by_zip, count(*) filter (where g.province = m.gold_province) as by_province, count(*) filter (where g.district = m.gold_district and g.province = m.gold_province and g.zipcode = m.gold_zipcode) as by_three from m join g on g.province = m.gold_province group by m.id")
def tuple_cascade(spark, sf_dir):
    m, g = messages(spark, sf_dir), gazetteer(spark, sf_dir)
    zip_ok, dist_ok = F.col("zipcode") == F.col("gold_zipcode"), F.col("district") == F.col("gold_district")
    return m.join(g, F.col("province") == F.col("gold_province")).groupBy("id").agg(F.count_if(zip_ok).alias("by_zip"), F.count("*").alias("by_province"), F.count_if(zip_ok & dist_ok).alias("by_three"))


# Sources


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, props is null or json_extract(props, '$.k') is null as bad from events")
def json_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("r"))
    return rows.select("event_id", "r.k", F.col("r.k").isNull().alias("bad"))


@query(f"select id, cast(null as varchar) as problem, gold_name as name, cast(1 as bigint) as spans from ({CLEAN}) m")
def record_validation(spark, sf_dir):
    m = messages(spark, sf_dir)
    n = F.length("gold_name")
    span = F.struct(F.lit("NAME").alias("label"), F.col("gold_name").alias("text"), F.col("gold_name").alias("canonical"), F.lit(0).alias("start"), n.alias("end"), F.lit(0).alias("codePointStart"), n.alias("codePointEnd"))
    gold = F.struct(*[(F.lit("other") if f == "name" else F.col(f"gold_{f}")).alias(f) for f in ("name", "phone", "address", "subdistrict", "district", "province", "zipcode")])
    place = F.struct(*[F.col(f"gold_{f}").alias(f) for f in ("subdistrict", "district", "province", "zipcode")])
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "raw", F.lit("clean").alias("caseType"), F.lit("easy").alias("difficulty"), F.array(span).alias("spans"), gold.alias("expected"), place.alias("seedLocation")))
    records = readers.surface_gold(readers.parsed_records(m.select(line.alias("value"))))
    return records.select(F.col("id").cast("long").alias("id"), "problem", F.col("expected.name").alias("name"), F.size("spans").cast("long").alias("spans"))


@query("select md5(text) as digest, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return readers.duplicate_ids(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest")), "digest")


@query("select doc_id, sha256(text) as digest from documents")
def content_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"select 'recipient-list-' || lpad(cast(id as varchar), cast(greatest(4, length(cast(id as varchar))) as integer), '0') as id, 'province' as style, gold_name as name, gold_phone as phone, gold_address as address, gold_subdistrict as subdistrict, gold_district as district, gold_province as province, gold_zipcode as zipcode from ({CLEAN}) m")
def recipient_list(spark, sf_dir):
    text = F.concat(F.lit("ชื่อผู้รับ: "), "gold_name", F.lit("\nเบอร์โทร: "), "gold_phone", F.lit("\nที่อยู่: "), "gold_address", F.lit(" ตำบล"), "gold_subdistrict", F.lit(" อำเภอ"), "gold_district", F.lit(" จังหวัด"), "gold_province", F.lit(" "), "gold_zipcode", F.lit("\nหมายเหตุ: -"))
    found = readers.recipient_records(messages(spark, sf_dir).select(F.col("id").alias("number"), text.alias("raw")))
    return found.drop("raw")


# Splits


@query(f"select id, case when b < 1500 then 'development' when b < 3500 then 'evaluation' else 'train' end as partition from (select id, {_FNV.format(x='chr(115) || chr(0) || ' + chr(39) + 'partition' + chr(39) + ' || chr(0) || gold_subdistrict || chr(0) || gold_district || chr(0) || gold_province || chr(0) || gold_zipcode')} % 10000 as b from ({CLEAN}) m) x")
def training_split(spark, sf_dir):
    m = messages(spark, sf_dir).select("id", *[F.col(f"gold_{c}").alias(c) for c in split.KEY])
    return split.complete(split.for_training(m, "s")).select("id", "partition")


@query("select c_mktsegment as family, count(distinct case when c_custkey % 2 = 0 then 'train' else 'evaluation' end) as sides from customer group by 1 having count(distinct case when c_custkey % 2 = 0 then 'train' else 'evaluation' end) > 1")
def template_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.when(F.col("c_custkey") % 2 == 0, "train").otherwise("evaluation").alias("side"))
    return split.template_conflicts(c, "family", "side")


# Every place has messages of every style, so no place has to move for coverage.
@query(f"select id, 'style-' || style as case_type, case when {_FNV.format(x='chr(115) || chr(0) || gold_subdistrict || chr(0) || gold_district || chr(0) || gold_province || chr(0) || gold_zipcode')} % 10000 < 2000 then 'evaluation' else 'train' end as partition from ({MESSY}) m")
def coverage_split(spark, sf_dir):
    m = messages(spark, sf_dir, False).select("id", F.concat(F.lit("style-"), "style").alias("case_type"), *[F.col(f"gold_{c}").alias(c) for c in split.KEY])
    return split.by_location(m, "s").select("id", "case_type", "partition")


# Metrics on given tables


@query("with s as (select (doc_id % 101) / 100.0 as c, cast(quality as double) as y from labels) select cast(least(9, floor(c * 10 + 0)) as integer) as bin, count(*) as samples, round(avg(c), 9) as mean_confidence, round(avg(y), 9) as accuracy, round(sum((c - y) * (c - y)) / (select count(*) from s), 9) as brier_part, round(abs(sum(c) - sum(y)) / (select count(*) from s), 9) as ece_part from s group by 1")
def label_calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(((F.col("doc_id") % 101) / F.lit(100.0)).alias("confidence"), F.col("quality").alias("correct"))
    out = metrics.calibration(rows)
    return out.select("bin", "samples", *[F.round(c, 9).alias(c) for c in ("mean_confidence", "accuracy", "brier_part", "ece_part")])


@query("select l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[cast(floor((count(*) - 1) * 0.5) as bigint) + 1] as p50, list_sort(list(l_extendedprice))[cast(floor((count(*) - 1) * 0.95) as bigint) + 1] as p95, list_sort(list(l_extendedprice))[cast(floor((count(*) - 1) * 0.99) as bigint) + 1] as p99 from lineitem group by 1, 2")
def latency_percentiles(spark, sf_dir):
    return metrics.nearest_ranks(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) as integer) as all_status, cast(grouping(o_orderpriority) as integer) as all_priority, count(*) as records, count(*) filter (where o_totalprice >= 100000) as exact, cast(ceil(count(*) * 0.95) as bigint) as required, count(*) filter (where o_totalprice >= 100000) >= ceil(count(*) * 0.95) as passed from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority))")
def acceptance_slices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    out = o.groupingSets([[], [a], [b]], a, b).agg(F.grouping("o_orderstatus").cast("int").alias("all_status"), F.grouping("o_orderpriority").cast("int").alias("all_priority"), F.count("*").alias("records"), F.count_if(F.col("o_totalprice") >= 100000).alias("exact"))
    required, passed = metrics.acceptance(F.col("records"), F.col("exact"), 0.95)
    return out.withColumns({"required": required, "passed": passed})


@query("with s as (select o_orderpriority as slice, count(*) as records, count(*) filter (where o_totalprice >= 100000) as a, count(*) filter (where o_totalprice >= 120000 or o_orderstatus = 'F') as b from orders group by 1) select count(*) filter (where records >= 5) as compared, cast(coalesce(string_agg(slice, ',' order by slice) filter (where records >= 5 and a < b), '') as varchar) as failures, count(*) filter (where records >= 5) > 0 and count(*) filter (where records >= 5 and a < b) = 0 as passed from s")
def promotion_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count("*").alias("records"), F.count_if(F.col("o_totalprice") >= 100000).alias("candidate_exact"), F.count_if((F.col("o_totalprice") >= 120000) | (F.col("o_orderstatus") == "F")).alias("baseline_exact"))
    return metrics.promotion_gate(o).select("compared", F.array_join("failures", ",").alias("failures"), "passed")


@query("select l_orderkey, l_linenumber, case when l_discount * 10 >= 0.8 then 'high' when l_discount * 10 >= 0.6 then 'medium' when l_discount > 0 then 'low' else 'none' end as band from lineitem")
def confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metrics.band(F.col("l_discount") * 10).alias("band"))


# Training


@query("with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as idx from embeddings where label is not null), s as (select label, idx, sum(cast(v as double)) as s, count(*) as n from e group by 1, 2), g as (select idx, sum(s) as s, sum(n) as n from s group by 1) select s.label, cast(s.idx as integer) as idx, round(s.s / s.n - (g.s - s.s) / (g.n - s.n), 6) as difference from s join g using (idx) where g.n > s.n")
def label_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("idx", "v"))
    s = e.groupBy("label", "idx").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    g = s.groupBy("idx").agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    return s.join(g, "idx").where("gn > n").select("label", "idx", F.round(F.col("s") / F.col("n") - (F.col("gs") - F.col("s")) / (F.col("gn") - F.col("n")), 6).alias("difference"))


@query("select family, round(n / (f * m), 9) as weight, cast(m as bigint) as records from (select c_mktsegment as family, count(*) as m, sum(count(*)) over () as n, count(*) over () as f from customer join nation on c_nationkey = n_nationkey group by 1) x")
def family_balance(spark, sf_dir):
    return family_weights(messages(spark, sf_dir), "family").groupBy("family").agg(F.round(F.first("weight"), 9).alias("weight"), F.count("*").alias("records"))


def _training(spark, sf_dir) -> tuple[DataFrame, list[dict]]:
    raw, zipcode = F.col("raw"), F.col("gold_zipcode")
    starts = {f: F.instr(raw, F.col(f"gold_{f}")) - 1 for f in FIELDS}
    starts["zipcode"] = F.when(raw.endswith(zipcode), F.length(raw) - F.length(zipcode)).otherwise(-1)  # its digits may stand within the phone too
    spans = F.array(*[F.struct(F.lit(label).alias("label"), starts[f].alias("start"), (starts[f] + F.length(f"gold_{f}")).alias("end")) for label, f in FIELD.items()])
    rows = family_weights(messages(spark, sf_dir, False), "family")
    rows = rows.withColumn("spans", F.filter(spans, lambda s: s["start"] >= 0)).withColumns({f: F.col(f"gold_{f}") for f in FIELDS})
    places = [r.asDict() for r in gazetteer(spark, sf_dir).orderBy("location_id").drop("location_id").collect()]
    return rows, places


def _directions(spark, found: dict) -> DataFrame:
    rows = [(label, float((v**2).sum()), float(abs(v).max()), float(b)) for label, (v, b) in found.items()]
    return spark.createDataFrame(rows, "label string, squares double, most double, bias double")


@query()
def span_directions(spark, sf_dir):
    rows, _ = _training(spark, sf_dir)
    return _directions(spark, fit_centroids(rows, Resources("c", 512, "char-ngram-v2", scoring="label-mix-v1")))


@query()
def contrast_directions(spark, sf_dir):
    rows, places = _training(spark, sf_dir)
    return _directions(spark, fit_contrast(rows, places, Resources("c", 512, "char-ngram-v2", scoring="label-mix-v1")))


@query()
def pairwise_directions(spark, sf_dir):
    rows, places = _training(spark, sf_dir)
    return _directions(spark, fit_pairwise(rows, places, Resources("p", 2048, by_label={"NAME": 1.0}), epochs=4))  # as many as a build takes


# Structured suffixes


@query(f"with m as ({MESSY}), s as (select id, gold_subdistrict as a, gold_district as b, gold_province as c, gold_zipcode as z, raw, cast(gold_zipcode as integer) - 10000 as location_id from m where style = 3), p as (select id, location_id, 'SUBDISTRICT' as label, a as canonical, instr(raw, 'ตำบล' || a) + 3 as start from s union all select id, location_id, 'DISTRICT', b, instr(raw, 'อำเภอ' || b) + 4 from s union all select id, location_id, 'PROVINCE', c, instr(raw, 'จังหวัด' || c) + 6 from s union all select id, location_id, 'POSTCODE', z, length(raw) - 5 from s) select id, cast(0 as integer) as ordinal, label, canonical, cast(start as integer) as start, cast(start + length(canonical) as integer) as \"end\", location_id, cast(0.995 as double) as evidence from p")
def structured_tuples(spark, sf_dir):
    return tuples_of(messages(spark, sf_dir, False), gazetteer(spark, sf_dir))


# Provenance and gates


@query("select n_nationkey, sha256('{\"nation\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') as checksum, 'v-' || left(sha256('{\"nation\":\"' || n_name || '\",\"region\":' || n_regionkey || '}'), 12) as version from nation")
def build_checksums(spark, sf_dir):
    made = provenance.json_checksum(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))
    return table(spark, sf_dir, "nation").select("n_nationkey", made.alias("checksum"), provenance.version("v-", made).alias("version"))


@query("select n_regionkey, count(*) as members, sha256(string_agg(sha256(n_name), chr(0) order by sha256(n_name))) as checksum from nation group by 1")
def set_checksums(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.sha2("n_name", 256).alias("checksum"))
    return provenance.set_checksum(rows, ["n_regionkey"])


@query(f"with g as ({PLACES}) select count(*) as expected, count(*) as found, sha256('[' || string_agg('{{\"id\":' || location_id || ',\"raw\":\"' || subdistrict || '\"}}', ',' order by location_id) || ']') as checksum, 'records differ' as problem from g where location_id % 2 = 0")
def evaluation_drift(spark, sf_dir):
    """Against a checksum of other records, so that the drift shows."""
    places = gazetteer(spark, sf_dir).select(F.col("location_id").alias("id"), F.col("subdistrict").alias("raw"))
    return provenance.evaluation_drift(places, places.where("id % 2 = 0"), ["id", "raw"], "0" * 64)


@query("select distinct unnest(regexp_extract_all(html, 'https?://[0-9A-Za-z_.-]+')) as reference from pages")
def source_references(spark, sf_dir):
    return provenance.references(table(spark, sf_dir, "pages"), "html", r"https?://[0-9A-Za-z_.-]+")


@query("select 'artifact-' || p_partkey as path, concat_ws(',', case when p_partkey % 7 = 0 then 'missing' when p_partkey % 5 = 0 then 'no gate' when p_partkey % 3 = 0 then 'grandfathered' when p_partkey % 11 = 0 then 'not enforced' when p_partkey % 13 = 0 then 'not passed' end, case when p_partkey % 7 <> 0 and p_partkey % 17 = 0 then 'scale of PROVINCE' end) as failures from part")
def artifact_gate(spark, sf_dir):
    k = F.col("p_partkey")
    gate = F.when(k % 5 != 0, F.struct((k % 11 != 0).alias("enforced"), (k % 13 != 0).alias("passed"), F.when(k % 3 == 0, F.lit(True)).alias("grandfathered")))
    scales = F.create_map(F.lit("NAME"), F.lit(1.0), F.lit("PROVINCE"), F.when(k % 17 == 0, 0.5).otherwise(0.0))
    text = F.to_json(F.struct(gate.alias("promotionGate"), F.struct(F.struct(scales.alias("residualScaleByLabel")).alias("scoringConfig")).alias("resources")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("artifact-"), k.cast("string")).alias("path"), F.when(k % 7 != 0, text).alias("value"))
    return provenance.artifact_gate(rows).select("path", F.array_join("failures", ",").alias("failures"))
