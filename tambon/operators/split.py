"""Splits that keep a location, and declared templates, on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.thai_text import fnv1a

KEY = ("subdistrict", "district", "province", "zipcode")


def location_key(*columns: str) -> Column:
    return F.concat_ws("\0", *(columns or KEY))


def bucket(*parts: Column) -> Column:
    return fnv1a(F.concat_ws("\0", *parts)) % 10_000


def for_training(records: DataFrame, seed: str, development: float = 0.15, evaluation: float = 0.2, declared: str | None = None) -> DataFrame:
    """`records` with partition: train, development, evaluation, or excluded where a declared split disagrees."""
    if not (development > 0 and evaluation > 0 and development + evaluation < 1):
        raise ValueError("both ratios must be positive and sum below one")
    b = bucket(F.lit(seed), F.lit("partition"), location_key())
    first, second = int(development * 10_000), int((development + evaluation) * 10_000)
    part = F.when(b < first, "development").when(b < second, "evaluation").otherwise("train")
    if declared:
        said = F.col(declared)
        part = F.when((part == "evaluation") & (said == "train") | (part != "evaluation") & (said == "evaluation"), "excluded").otherwise(part)
    return records.withColumn("partition", part)


def complete(split: DataFrame) -> DataFrame:
    """The split itself; fails where train, development or evaluation holds no record."""
    sides = {r.partition for r in split.select("partition").distinct().collect()}  # four at most
    empty = [x for x in ("train", "development", "evaluation") if x not in sides]
    if empty:
        raise ValueError(f"no record is left for {', '.join(empty)}")
    return split


def template_conflicts(records: DataFrame, template: str, declared: str) -> DataFrame:
    """Template families that are declared on both sides."""
    return records.where(F.col(template).isNotNull() & F.col(declared).isNotNull()).groupBy(template).agg(F.countDistinct(declared).alias("sides")).where("sides > 1")


def by_location(records: DataFrame, seed: str, evaluation: float = 0.2, case: str = "case_type") -> DataFrame:
    """train or evaluation by location; then each case type that evaluation misses takes over the location with the least coverage hash.

    The loop runs over case types, a label set; locations stay distributed, and each step takes one row to the driver.
    """
    if not 0 < evaluation < 1:
        raise ValueError("the ratio must be between zero and one")
    keyed = records.withColumn("_key", location_key())
    locations = keyed.groupBy("_key").agg(F.collect_set(case).alias("cases"), F.min("id").alias("first"))
    locations = locations.withColumn("held", bucket(F.lit(seed), F.col("_key")) < int(evaluation * 10_000)).withColumn("order", fnv1a(F.concat_ws("\0", F.lit(seed), F.lit("coverage"), F.col("_key"))))
    cases = [r[case] for r in records.groupBy(case).agg(F.min("id").alias("first")).orderBy("first").collect()]
    covered = {c for r in locations.where("held").select(F.explode("cases").alias("c")).distinct().collect() for c in [r.c]}
    moved: list[str] = []
    for name in cases:
        if name not in covered:
            row = locations.where(~F.col("held") & F.array_contains("cases", name) & ~F.col("_key").isin(moved)).orderBy("order", "first").first()
            if row:
                moved.append(row["_key"])
                covered.update(row.cases)
    held = locations.select("_key", (F.col("held") | F.col("_key").isin(moved)).alias("_held"))
    return keyed.join(held, "_key").withColumn("partition", F.when(F.col("_held"), "evaluation").otherwise("train")).drop("_key", "_held")
