"""Delivery messages made from customers, nations and regions: the tables hold no Thai text.

One text serves both engines; {div} is integer division and {repeat_int} a cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SOUND = "translate(cast({x} as {string}), '0123456789', 'กขคงจชซดตน')"

_TEMPLATE = """
select c_custkey as id, c_mktsegment as family, cast(c_custkey % 8 as integer) as style,
  'คุณลูก' || {name} || ' ใจดี' as gold_name,
  '08' || lpad(cast(c_custkey as {string}), 8, '0') as gold_phone,
  'บ้านเลขที่ ' || cast(c_custkey % 99 + 1 as {string}) || ' ถนนสุข' as gold_address,
  'บาง' || {sub} as gold_subdistrict, 'สัน' || {dist} as gold_district, 'เชียง' || {prov} as gold_province,
  cast(10000 + n_nationkey as {string}) as gold_zipcode
from customer join nation on c_nationkey = n_nationkey
"""


def _gold(string: str, div: str) -> str:
    sound = lambda x: _SOUND.format(x=x, string=string)
    return _TEMPLATE.format(string=string, name=sound("c_custkey"), sub=sound("n_nationkey"), dist=sound(f"n_nationkey {div} 2"), prov=sound("n_regionkey"))


CLEAN = "gold_name || {nl} || 'โทร ' || gold_phone || {nl} || gold_address || ' ต.' || gold_subdistrict || ' อ.' || gold_district || ' จ.' || gold_province || ' ' || gold_zipcode"
MESSY = """case style
  when 0 then """ + CLEAN + """
  when 1 then gold_name || {nl} || gold_phone || {nl} || gold_address || ' ต.' || gold_subdistrict || ' อ.' || gold_district || ' จ.' || gold_province
  when 2 then gold_name || {nl} || gold_phone || {nl} || gold_address || ' ต.' || gold_subdistrict || ' อ.' || gold_district || ' จ.' || gold_province || ' 99999'
  when 3 then 'ผู้รับ: ' || gold_name || {nl} || 'โทร: ' || gold_phone || {nl} || 'ที่อยู่: ' || gold_address || ' ตำบล' || gold_subdistrict || ' อำเภอ' || gold_district || ' จังหวัด' || gold_province || ' ' || gold_zipcode
  when 4 then gold_name || gold_phone || gold_address || ' ' || gold_subdistrict || ' ' || gold_district || ' ' || gold_province || ' ' || gold_zipcode
  when 5 then gold_name || {nl} || translate(gold_phone, '0123456789', '๐๑๒๓๔๕๖๗๘๙') || {nl} || gold_address || ' ต.' || gold_subdistrict || ' อ.' || gold_district || ' จ.' || gold_province || ' ' || translate(gold_zipcode, '0123456789', '๐๑๒๓๔๕๖๗๘๙')
  when 6 then gold_name || {nl} || gold_phone || {nl} || gold_address || ' ต.' || gold_subdistrict || ' อ.' || gold_district || ' จ.เชีบง' || substr(gold_province, 6) || ' ' || gold_zipcode
  else gold_name || {nl} || gold_phone || {nl} || gold_address || ' แขวง' || gold_subdistrict || ' เขต' || gold_district || ' ' || gold_province || ' ' || gold_zipcode end"""


def messages_sql(clean: bool, duck: bool) -> str:
    """(id, family, style, gold_..., raw) in one dialect. Clean messages have one style; messy ones eight, by id."""
    gold = _gold("varchar" if duck else "string", "//" if duck else "div")
    return f"select *, {(CLEAN if clean else MESSY).replace('{nl}', 'chr(10)')} as raw from ({gold}) g"


def gazetteer_sql(duck: bool) -> str:
    string, div = ("varchar", "//") if duck else ("string", "div")
    sound = lambda x: _SOUND.format(x=x, string=string)
    return f"select 'บาง' || {sound('n_nationkey')} as subdistrict, 'สัน' || {sound(f'n_nationkey {div} 2')} as district, 'เชียง' || {sound('n_regionkey')} as province, cast(10000 + n_nationkey as {string}) as zipcode, n_nationkey as location_id from nation"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def messages(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "nation")
    return spark.sql(_bind(messages_sql(clean, duck=False)), **t)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_bind(gazetteer_sql(duck=False)), **tables(spark, sf_dir, "nation"))


def _bind(sql: str) -> str:
    return sql.replace("from customer join nation", "from {customer} join {nation}").replace("from nation", "from {nation}")
