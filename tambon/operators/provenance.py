"""What an artifact was made from and whether it may be shipped: checksums, references in sources, the gate, and drift of the evaluation set.

A checksum of a set needs all of its members in one place, in order. Sets here are lists of files and evaluation sets;
SET_BOUND is checked before members are joined, and a larger set fails instead of filling a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SET_BOUND = 200_000
#: Fixed value: how generated resources are named in sources.
REFERENCE = r"resources/generated/[0-9A-Za-z_.-]+\.json"
ARTIFACT = "promotionGate struct<enforced:boolean,passed:boolean,ablationApplicable:boolean,grandfathered:boolean>, resources struct<scoringConfig:struct<residualScaleByLabel:map<string,double>>>"


def json_checksum(*parts: Column) -> Column:
    """sha256 of the parts as one JSON object, in the order given; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def version(prefix: str, checksum: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(checksum, 1, 12))


def _joined(ordered: Column, between: str) -> Column:
    small = F.assert_true(F.size(ordered) <= SET_BOUND, F.lit(f"a set of more than {SET_BOUND} members has no checksum in one piece"))
    return F.when(small.isNull(), F.array_join(ordered, between))


def set_checksum(checksums: DataFrame, by: list[str], checksum: str = "checksum") -> DataFrame:
    """sha256 of the sorted checksums of each group, a NUL between them; order and partitions of the rows don't count, repeated members do."""
    counted = checksums.groupBy(*by).agg(F.count(checksum).alias("members"), F.collect_list(checksum).alias("_all"))
    return counted.select(*by, "members", F.sha2(_joined(F.array_sort("_all"), "\0"), 256).alias("checksum"))


def records_checksum(records: DataFrame, fields: list[str], id: str = "id") -> DataFrame:
    """One row (records, checksum): sha256 of a JSON array of the records, by id in code-point order. `fields` are the object's, in order."""
    lines = records.select(F.struct(F.col(id).alias("id"), F.to_json(F.struct(*fields)).alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return lines.select(F.size("rs").cast("long").alias("records"), F.sha2(F.concat(F.lit("["), _joined(F.col("rs.line"), ","), F.lit("]")), 256).alias("checksum"))


def evaluation_drift(records: DataFrame, ids: DataFrame, fields: list[str], checksum: str, id: str = "id") -> DataFrame:
    """One row: expected and found ids of the evaluation set, the checksum now, and `problem` (null, or what changed)."""
    wanted = ids.select(id).distinct()
    now = records_checksum(records.join(wanted, id, "left_semi"), fields, id)
    out = wanted.agg(F.count("*").alias("expected")).crossJoin(now)  # one row each
    changed = F.when(F.col("records") != F.col("expected"), "records are missing or repeated").when(F.col("checksum") != F.lit(checksum), "records differ")
    return out.select("expected", F.col("records").alias("found"), "checksum", changed.alias("problem"))


def references(texts: DataFrame, text: str, pattern: str = REFERENCE) -> DataFrame:
    """The distinct strings in the texts that a pattern matches."""
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("reference")).distinct()


def source_texts(spark: SparkSession, *roots: str, names: str = "*.{ts,tsx}") -> DataFrame:
    """(file, value) of all source files below the roots, without hidden and installed folders."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).text(list(roots))
    return files.select(F.input_file_name().alias("file"), "value").where(~F.col("file").rlike(r"/(\.[^/]*|node_modules)/"))


def artifact_gate(artifacts: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, value as JSON text, null where there is no file) to (path, failures, ablated): an artifact may be shipped if nothing failed.

    Unreadable JSON counts as an artifact without a gate. A flag that is missing counts as false.
    """
    a = artifacts.select(F.col(path).alias("path"), F.col(value).alias("_value"), F.from_json(F.col(value), ARTIFACT).alias("a"))
    flag = lambda name: F.coalesce(F.col(f"a.promotionGate.{name}"), F.lit(False))
    gate = (
        F.when(F.col("_value").isNull(), "missing")
        .when(F.col("a.promotionGate").isNull(), "no gate")
        .when(flag("grandfathered"), "grandfathered")
        .when(~flag("enforced"), "not enforced")
        .when(~flag("passed"), "not passed")
    )
    scales = F.coalesce(F.map_entries("a.resources.scoringConfig.residualScaleByLabel"), F.array().cast("array<struct<key:string,value:double>>"))
    scaled = F.transform(F.filter(scales, lambda e: (e["key"] != "NAME") & (e["value"] != 0)), lambda e: F.concat(F.lit("scale of "), e["key"]))
    failures = F.concat(F.when(gate.isNotNull(), F.array(gate)).otherwise(F.array().cast("array<string>")), scaled)
    return a.select("path", failures.alias("failures"), F.coalesce(F.col("a.promotionGate.ablationApplicable"), F.lit(True)).alias("ablated"))
