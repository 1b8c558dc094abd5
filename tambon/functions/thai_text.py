"""Text constants and normalisers, as Python regular expressions and as Spark columns.

The white-space class and digit rules are those of the original data contract: white space is the
Unicode set below, `[0-9]` are ASCII digits, and Thai digits are named where they count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

S = r"\t-\r\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
D = "0-9๐-๙"

# Patterns that must equal those of the data contract for equal results.
PHONE = rf"(?<![{D}])(?:(?:\+66|0066)[-.{S}]?[1-9๑-๙][{D}]?(?:[-.{S}]?[{D}]){{7,8}}|[0๐][2-9๒-๙][{D}]?(?:[-.{S}]?[{D}]){{6,8}})(?![{D}])"
POSTCODE = rf"(?<![{D}])[{D}]{{5}}(?![{D}])"
ADDRESS_HINT = r"(?:บ้านเลขที่|เลขที่|หมู่บ้าน|คอนโดมิเนียม|คอนโด|อพาร์ทเม้นท์|อพาร์ตเมนต์|หอพัก|โรงพยาบาล|โรงแรม|โรงงาน|โกดัง|ตลาด|คลินิก|ร้าน|โรงเรียน|อาคาร|โครงการ|สำนักงาน|ถนน|ซอย|ตึก|[0-9]+(?:/[0-9]+)?)"
ADDRESS_WORD = r"(?:บ้านเลขที่|เลขที่|หมู่บ้าน|คอนโด|อพาร์|หอพัก|โรงพยาบาล|โรงแรม|โรงงาน|โกดัง|ตลาด|คลินิก|ร้าน|โรงเรียน|อาคาร|โครงการ|สำนักงาน|ถนน|ซอย|ตึก)"
TITLE = r"(?:เด็กชาย|เด็กหญิง|ด\.ช\.|ด\.ญ\.|นาย|นางสาว|นาง|น\.ส\.|ดร\.|คุณ|พระ|อาจารย์|ศาสตราจารย์)"
ADMIN = rf"(?:แขวง|ตำบล|ต[{S}]*\.|เขต|อำเภอ|อ[{S}]*\.|จังหวัด|จ[{S}]*\.|(?<![ก-๙])[ตอจ](?=[{S}]+[ก-๙]))[{S}]*"
RECIPIENT_LABEL = rf"(?:ชื่อผู้รับ|ผู้รับ|ชื่อ)[{S}]*[:：][{S}]*"
PHONE_LABEL = rf"(?:เบอร์โทร|โทรศัพท์|โทร|เบอร์)[{S}]*[:：][{S}]*"
ADDRESS_LABEL = rf"(?:ที่อยู่จัดส่ง|ที่อยู่|ส่งที่)[{S}]*[:：][{S}]*"
SEPARATOR = r"(?:\||\r?\n)"
STRUCTURED = (
    rf"แขวง(?<subdistrict>[^\n\r\u2028\u2029]+?)[{S}]+เขต(?<district>[^\n\r\u2028\u2029]+?)[{S}]+(?<province>กรุงเทพมหานคร)[{S}]+(?<zipcode>[0-9]{{5}})(?=\Z|\n|\|)",
    rf"ตำบล(?<subdistrict>[^\n\r\u2028\u2029]+?)[{S}]+อำเภอ(?<district>[^\n\r\u2028\u2029]+?)[{S}]+จังหวัด(?<province>[^\n\r\u2028\u2029]+?)[{S}]+(?<zipcode>[0-9]{{5}})(?=\Z|\n|\|)",
)

WHITE = "".join(re.findall(f"[{S}]", "".join(map(chr, range(0x10000)))))
_spaces = re.compile(rf"[{S}]+")
_ascii = str.maketrans(THAI_DIGITS, "0123456789")
_not_digit = re.compile(r"[^0-9]")


def python_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?<subdistrict>", "(?P<subdistrict>").replace("(?<district>", "(?P<district>").replace("(?<province>", "(?P<province>").replace("(?<zipcode>", "(?P<zipcode>"))


def strip(text: str) -> str:
    return text.strip(WHITE)


def squeeze(text: str) -> str:
    return _spaces.sub(" ", text)


def phone(text: str) -> str | None:
    digits = _not_digit.sub("", text.translate(_ascii))
    for code in ("0066", "66"):
        if digits.startswith(code):
            digits = "0" + digits[len(code) :]
            break
    return digits if digits[:1] == "0" and len(digits) in (9, 10) else None


def postcode(text: str) -> str | None:
    digits = _not_digit.sub("", text.translate(_ascii))
    return digits if len(digits) == 5 else None


def canonical(label: str, text: str) -> str | None:
    text = strip(text)
    if not text:
        return None
    return phone(text) if label == "PHONE" else postcode(text) if label == "POSTCODE" else squeeze(text)


# The same on columns.


def ascii_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, "0123456789")


def phone_column(c: Column) -> Column:
    digits = F.regexp_replace(ascii_digits(c), "[^0-9]", "")
    local = F.when(digits.startswith("0066"), F.concat(F.lit("0"), F.substring(digits, 5, 1 << 20))).when(digits.startswith("66"), F.concat(F.lit("0"), F.substring(digits, 3, 1 << 20))).otherwise(digits)
    return F.when(local.rlike(r"^0[0-9]{8,9}\z"), local)


def postcode_column(c: Column) -> Column:
    digits = F.regexp_replace(ascii_digits(c), "[^0-9]", "")
    return F.when(F.length(digits) == 5, digits)


def strip_column(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{S}]+|[{S}]+\z", "")


def squeeze_column(c: Column) -> Column:
    return F.nullif(F.regexp_replace(strip_column(c), rf"[{S}]+", " "), F.lit(""))


OPEN, CLOSE = "\uE000", "\uE001"


def ranges(c: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<start int, end int>>, half-open, in code points.

    Matches are marked in one pass, so lookarounds see their real surroundings; pieces between marks then give the offsets.
    Marks that the text already holds are dropped from the copy that is scanned only when there are any (their private-use code points are not text).
    """
    pieces = F.split(F.regexp_replace(c, pattern.replace(r"\Z", r"\z"), f"{OPEN}$0{CLOSE}"), OPEN)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"), F.lit(True).alias("first"))

    def add(acc: Column, piece: Column) -> Column:
        size = F.instr(piece, CLOSE) - 1
        span = F.array(F.struct(acc["at"].cast("int").alias("start"), (acc["at"] + size).cast("int").alias("end")))
        return F.struct((acc["at"] + F.length(piece) - F.when(acc["first"], 0).otherwise(1)).cast("int").alias("at"), F.when(acc["first"] | (size <= 0), acc["found"]).otherwise(F.concat(acc["found"], span)).alias("found"), F.lit(False).alias("first"))

    return F.when(c.isNotNull(), F.aggregate(pieces, zero, add, lambda acc: acc["found"]))


def similarity(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise((total - F.levenshtein(a, b)) / total * 100)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(bounded / (1 - bounded))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units (equal to code points below U+10000)."""
    units = F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[floor((n - 1) * p)] of a collected array, 0 if empty."""
    ordered = F.array_sort(values)
    at = F.floor((F.size(values) - 1) * F.lit(p)).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(ordered, at).cast("double"))
