"""Structured address suffixes as a relational plan: four labelled parts in a row, resolved against the gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.thai_text import STRUCTURED, ranges, strip_column

PARTS = {"subdistrict": "SUBDISTRICT", "district": "DISTRICT", "province": "PROVINCE", "zipcode": "POSTCODE"}
EVIDENCE = 0.995


def structured_tuples(messages: DataFrame, places: DataFrame, id: str = "id", raw: str = "raw") -> DataFrame:
    """A row for each part of each suffix and each place it may be: (id, ordinal, label, canonical, start, end, location_id, evidence).

    Places are those with the same four parts, else those that differ in the subdistrict only, else those with the same province and postcode; without any, location_id
    is null. Messages with null text have no rows. Places meet messages as one row per (province, zipcode), so a message is never multiplied before the choice is made.
    """

    def found_by(i: int) -> Column:
        return F.transform(ranges(F.col(raw), STRUCTURED[i]), lambda r: F.struct(F.lit(i).alias("pattern"), r["start"].alias("start"), r["end"].alias("end")))

    found = F.concat(*map(found_by, range(len(STRUCTURED))))
    rows = messages.select(F.col(id).alias("id"), F.col(raw).alias("_raw"), F.posexplode(found).alias("ordinal", "_r"))
    rows = rows.withColumn("_text", F.substring(F.col("_raw"), F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start")))

    def part(group: int) -> Column:
        return strip_column(F.coalesce(*[F.when(F.col("_r.pattern") == i, F.regexp_extract("_text", p.replace(r"\Z", r"\z"), group)) for i, p in enumerate(STRUCTURED)]))

    rows = rows.withColumns({name: part(i + 1) for i, name in enumerate(PARTS)}).where(" and ".join(f"{name} <> ''" for name in PARTS))
    after = F.lit(1)
    for name in PARTS:
        rows = rows.withColumn(f"_{name}", F.call_function("locate", F.col(name), F.col("_text"), after))
        after = F.col(f"_{name}") + F.length(name)
    spans = [F.struct(F.lit(label).alias("label"), F.col(name).alias("canonical"), (F.col("_r.start") + F.col(f"_{name}") - 1).alias("start"), (F.col("_r.start") + F.col(f"_{name}") - 1 + F.length(name)).alias("end")) for name, label in PARTS.items()]
    by_code = places.groupBy("province", "zipcode").agg(F.collect_list(F.struct("location_id", F.col("subdistrict").alias("s"), F.col("district").alias("d"))).alias("_places"))
    rows = rows.join(by_code, ["province", "zipcode"], "left")
    near = F.filter("_places", lambda x: x["d"] == F.col("district"))
    same = F.filter(near, lambda x: x["s"] == F.col("subdistrict"))
    chosen = F.when(F.size(same) > 0, same).when(F.size(near) > 0, near).otherwise(F.col("_places"))
    out = rows.select("id", "ordinal", F.explode(F.array(*spans)).alias("s"), chosen.alias("_places"))
    return out.select("id", "ordinal", "s.label", "s.canonical", "s.start", "s.end", F.explode_outer("_places").alias("p")).select("id", "ordinal", "label", "canonical", "start", "end", "p.location_id", F.lit(EVIDENCE).alias("evidence"))
