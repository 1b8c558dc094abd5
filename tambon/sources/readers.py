"""Readers and checks for annotated messages, gazetteers and recipient lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.thai_text import S, squeeze_column, strip_column

PLACE = "struct<subdistrict:string,district:string,province:string,zipcode:string>"
# Fixed values, here and in RECORD and LABELS: names of the data contract.
EXPECTED = "struct<name:string,phone:string,address:string,subdistrict:string,district:string,province:string,zipcode:string>"
RECORD = f"id string, raw string, caseType string, difficulty string, spans array<struct<label:string,text:string,canonical:string,start:int,end:int,codePointStart:int,codePointEnd:int>>, expected {EXPECTED}, seedLocation {PLACE}, seedProfile string, seedChat struct<datasetSplit:string,templateFamily:string,nameCategory:string,collision:struct<pairId:string>>"
LABELS = ("NAME", "PHONE", "ADDRESS_DETAIL", "SUBDISTRICT", "DISTRICT", "PROVINCE", "POSTCODE", "OTHER")
# Prefixes of place names, the first that fits is cut.
PREFIXES = {"subdistrict": ("แขวง", "ตำบล", "ต."), "district": ("กิ่งอำเภอ", "อำเภอ", "เขต", "อ."), "province": ("จังหวัด", "จ.")}


def parsed_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines as records with `problem`: null, or the first thing that is wrong. Blank lines go. Any other columns (file, line) stay."""
    text = lines.where(F.length(strip_column(F.col(value))) > 0)
    rows = text.withColumn("r", F.from_json(F.col(value), RECORD)).select(*[c for c in lines.columns if c != value], "r.*")
    points = lambda a, b: F.substring("raw", a + 1, b - a)
    bad_span = F.exists("spans", lambda s: ~F.coalesce(s["label"].isin(*LABELS) & s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["start"] < s["end"]), F.lit(False)))
    units = lambda at: F.when(at <= 0, at).otherwise((F.length(F.encode(F.substring("raw", F.lit(1), at), "UTF-16BE")) / 2).cast("int"))
    right = lambda s: points(s["codePointStart"], s["codePointEnd"]).eqNullSafe(s["text"]) & units(s["codePointStart"]).eqNullSafe(s["start"]) & units(s["codePointEnd"]).eqNullSafe(s["end"])
    bad_offset = F.exists("spans", lambda s: ~right(s))
    place = [F.coalesce(F.length(F.col(f"seedLocation.{c}")), F.lit(0)) > 0 for c in ("subdistrict", "district", "province", "zipcode")]
    rules: list[tuple[Column, str]] = [
        (F.col("id").isNull() | F.col("raw").isNull() | F.col("caseType").isNull() | F.col("difficulty").isNull(), "a required text is missing"),
        (F.col("spans").isNull() | F.col("expected").isNull(), "spans or expected are missing"),
        (bad_span, "a span has a wrong label or range"),
        (bad_offset, "a span's text is not at its offsets"),
        (~(place[0] & place[1] & place[2] & place[3]), "the location has an empty part"),
        (~F.coalesce(F.col("seedChat.datasetSplit"), F.lit("train")).isin("train", "evaluation"), "the declared split is unknown"),
    ]
    problem = F.coalesce(*[F.when(bad, F.lit(said)) for bad, said in rules])
    return rows.withColumn("problem", problem)


def strict(records: DataFrame) -> DataFrame:
    """Fails on the first record with a problem, whatever columns are read; names its line where there is a column `line`."""
    where = [F.concat(F.lit("line "), F.col("line").cast("string"))] * ("line" in records.columns)
    said = F.concat_ws(": ", *where, F.coalesce("id", F.lit("?")), "problem")
    return records.where(F.assert_true(F.col("problem").isNull(), said).isNull())


def _has(label: str):
    return lambda span: span["label"] == label


def surface_gold(records: DataFrame) -> DataFrame:
    """Names and addresses are expected as they stand in the text: `expected` takes the normalised text of the first such span, and `normalization_expected` keeps what was given."""
    out = records.withColumn("normalization_expected", F.col("expected"))
    for label, name in (("NAME", "name"), ("ADDRESS_DETAIL", "address")):
        mine = F.filter("spans", _has(label))
        out = out.withColumn("expected", F.when(F.size(mine) > 0, F.col("expected").withField(name, squeeze_column(F.get(mine, F.lit(0))["text"]))).otherwise(F.col("expected")))
    return out


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text files as (value, file, line), lines from 1, without reading a file in one task.

    Files are read in splits, whose rows are numbered as they come; a split's first line follows from the number of lines of
    the file's splits before it, a table of a row for each split.
    """
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(splits.withColumn("_before", F.coalesce(before, F.lit(0))), ["file", "_split"]).select("value", "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"))


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotated messages of several files, tagged with `family` (the file), with gold from surfaces.

    An id that occurs twice, in a file or across files, is refused at once; a bad record stops the read when it is reached. Errors name the line.
    """
    if not paths:
        raise ValueError("at least one file is needed")
    records = parsed_records(numbered_lines(spark, *paths))
    again = records.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("file", "line")).alias("last")).where("n > 1").first()
    if again:
        raise ValueError(f"{again['last']['file']}, line {again['last']['line']}: duplicate id {again['id']}")
    family = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return surface_gold(strict(records.withColumn("family", family)).drop("file", "line"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def cut_prefix(c: Column, kind: str) -> Column:
    out = c
    for prefix in reversed(PREFIXES[kind]):
        out = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(out)
    return strip_column(out)


def gazetteer(names: DataFrame, name: str = "name", order: str = "position") -> DataFrame:
    """("sub, district, province, zip", position) as distinct location tuples numbered by first appearance."""
    parts = F.transform(F.split(name, ","), strip_column)
    whole = F.assert_true((F.size(parts) == 4) & F.get(parts, F.lit(3)).rlike(r"^[0-9]{5}\z"), F.concat(F.lit("not a place: "), F.col(name)))
    rows = names.where(whole.isNull()).select(cut_prefix(parts[0], "subdistrict").alias("subdistrict"), cut_prefix(parts[1], "district").alias("district"), cut_prefix(parts[2], "province").alias("province"), parts[3].alias("zipcode"), F.col(order).alias("_at"))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Distinct (subdistrict, district, province, zipcode) with location_id in order of _at: a dimension, small enough for one task to number."""
    first = rows.groupBy("subdistrict", "district", "province", "zipcode").agg(F.min("_at").alias("_at"))
    return first.withColumn("location_id", (F.row_number().over(Window.orderBy("_at")) - 1).cast("int")).drop("_at")


def terms(places: DataFrame) -> DataFrame:
    """What may stand for a place in a message: (label, surface, canonical, location_id)."""
    city, bangkok = F.lit("เมือง"), F.lit("กรุงเทพมหานคร")
    term = lambda label, surface, name, keep=F.lit(True): F.struct(F.lit(label).alias("label"), surface.alias("surface"), name.alias("canonical"), keep.alias("keep"))
    d, p = F.col("district"), F.col("province")
    every = [term("SUBDISTRICT", F.col("subdistrict"), F.col("subdistrict")), term("DISTRICT", d, d), term("PROVINCE", p, p), term("POSTCODE", F.col("zipcode"), F.col("zipcode"))]
    every += [term("DISTRICT", city, d, d.startswith("เมือง") & (d != city)), *[term("PROVINCE", F.lit(x), p, p == bangkok) for x in ("กรุงเทพ", "กทม.", "กทม")]]
    return places.select(F.explode(F.filter(F.array(*every), lambda x: x["keep"])).alias("t"), "location_id").select("t.label", "t.surface", "t.canonical", "location_id")


def recipient_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """(text) of a whole list file as blocks: number from 1, raw (trimmed lines, no empty ones)."""
    clean = F.regexp_replace(F.col(text), r"\r\n", "\n")
    blocks = F.posexplode(F.split(clean, rf"\n[{S}]*---[{S}]*\n")).alias("at", "block")
    lines = F.filter(F.transform(F.split("block", "\n"), strip_column), lambda x: x != "")
    return texts.select(blocks).select((F.col("at") + 1).alias("number"), F.array_join(lines, "\n").alias("raw")).where("raw <> ''")


def recipient_records(blocks: DataFrame) -> DataFrame:
    """Blocks with labelled lines as records: id, raw, style (bangkok or province) and the seven expected fields; others are left out, numbers kept."""
    field = lambda label: F.nullif(strip_column(F.regexp_extract("raw", rf"(?m)^{label}[{S}]*[:：](.*)$", 1)), F.lit(""))
    rows = blocks.select("number", "raw", field("ชื่อผู้รับ").alias("name"), field("เบอร์โทร").alias("phone"), field("ที่อยู่").alias("_at")).where("name is not null and phone is not null and _at is not null")
    styles = {"bangkok": rf"^(.+?)[{S}]+แขวง(.+?)[{S}]+เขต(.+?)[{S}]+(กรุงเทพมหานคร)[{S}]+([0-9]{{5}})\z", "province": rf"^(.+?)[{S}]+ตำบล(.+?)[{S}]+อำเภอ(.+?)[{S}]+จังหวัด(.+?)[{S}]+([0-9]{{5}})\z"}
    part = lambda i: F.coalesce(*[F.nullif(F.regexp_extract("_at", p, i), F.lit("")) for p in styles.values()])
    style = F.coalesce(*[F.when(F.col("_at").rlike(p), F.lit(name)) for name, p in styles.items()])
    named = [part(i + 1).alias(c) for i, c in enumerate(("address", "subdistrict", "district", "province", "zipcode"))]
    return rows.select(F.concat(F.lit("recipient-list-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0"))).alias("id"), "raw", style.alias("style"), "name", "phone", *named)


def supplemented(blocks: DataFrame, supplement: DataFrame) -> DataFrame:
    """Blocks without labelled lines, with the expected fields that `supplement` (raw, ...) has for exactly that text; fails at a block that it doesn't have."""
    labelled = recipient_records(blocks).select("raw").distinct().withColumn("_labelled", F.lit(True))
    joined = blocks.join(labelled, "raw", "left").join(supplement.withColumn("_there", F.lit(True)), "raw", "left")
    there = F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit("no annotation of block "), F.col("number").cast("string"))).isNull()
    # One condition, so that the check is never moved ahead of leaving labelled blocks out.
    return joined.where(F.when(F.col("_labelled"), F.lit(False)).otherwise(there)).drop("_there", "_labelled")


def write_report(rows: DataFrame, path: str) -> None:
    """A report, a few rows, as one file of JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def external(rows: DataFrame, parser, fields: list[str]) -> DataFrame:
    """Another parser's answers (`parser`: DataFrame to DataFrame with the fields), empty texts as nulls."""
    return parser(rows).withColumns({f: F.nullif(F.col(f), F.lit("")) for f in fields})
