"""Evaluation as aggregations: accuracy by slices, calibration, candidate funnel, percentiles, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.thai_text import S
from .kernel import FIELD

FIELDS = tuple(FIELD.values())
LABEL = {v: k for k, v in FIELD.items()}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def exact_accuracy(parsed: DataFrame, by: list[str] = (), gold: str = "gold_", failed: str | None = None) -> DataFrame:
    """Records, exact records, and correct values per field; two nulls agree; a failed parse is wrong everywhere.

    With `by`, one pass gives the whole and a slice per value of each column (grouping sets).
    """
    ok = ~F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(True)
    right = {f: ok & F.col(f).eqNullSafe(F.col(gold + f)) for f in FIELDS}
    exact = reduce(lambda a, b: a & b, right.values())
    count = lambda c: F.sum(c.cast("long"))
    aggregates = [F.count("*").alias("records"), count(exact).alias("exact_records"), *[count(c).alias(f"correct_{f}") for f, c in right.items()]]
    if not by:
        out = parsed.agg(*aggregates)
    else:
        sets = [[], *[[F.col(c)] for c in by]]
        out = parsed.groupingSets(sets, *[F.col(c) for c in by]).agg(*aggregates, *[F.grouping(c).alias(f"all_{c}") for c in by])
    return out.withColumn("exact_accuracy", _share(F.col("exact_records"), F.col("records")))


def acceptance(records: Column, exact: Column, least: float) -> tuple[Column, Column]:
    """How many exact records are required, and whether there are so many."""
    required = F.ceil(records * F.lit(least))
    return required, exact >= required


def calibration(samples: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """A row per occupied bin: samples, mean confidence, accuracy, and the bin's shares of Brier score and expected calibration error."""
    c, y = F.col(confidence), F.col(correct).cast("double")
    binned = samples.groupBy(F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int").alias("bin")).agg(F.count("*").alias("samples"), F.sum(c).alias("confidence_sum"), F.sum(y).alias("correct"), F.sum((c - y) * (c - y)).alias("squares"))
    total = F.sum("samples").over(Window.partitionBy())  # at most `bins` rows
    return binned.select("bin", "samples", (F.col("confidence_sum") / F.col("samples")).alias("mean_confidence"), (F.col("correct") / F.col("samples")).alias("accuracy"), (F.col("squares") / total).alias("brier_part"), (F.abs(F.col("confidence_sum") - F.col("correct")) / total).alias("ece_part"))


def funnel(parsed: DataFrame, gold: str = "gold_", normal: str | None = None, spans: str | None = None) -> DataFrame:
    """Per field: records that expect a value, reach it with some candidate, select it, accept it. Needs full diagnostics.

    A value is reached by a candidate of its canonical form. With `spans` (gold spans, offsets as in the trace), a name or an address detail that has a span is
    reached by a candidate at exactly that span, white space at its ends aside. Either way `normalization_reachable` counts those whose value in the
    columns `normal` (by default as `gold`) some candidate has as its canonical form.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(LABEL[f]).alias("label"), F.col(gold + f).alias("value"), F.col((normal or gold) + f).alias("normal")) for f in FIELDS])).alias("w")
    rows = parsed.select("trace", wanted, *[spans] * bool(spans)).where("w.value is not null")
    mine = F.filter("trace", lambda c: c["label"] == F.col("w.label"))
    canonical = F.filter(mine, lambda c: c["canonical"] == F.col("w.normal"))
    hits = canonical
    if spans:
        span = F.get(F.filter(spans, lambda s: F.col("w.label").isin("NAME", "ADDRESS_DETAIL") & (s["label"] == F.col("w.label"))), F.lit(0))
        before = F.length(F.regexp_extract(span["text"], rf"^[{S}]*", 0))
        after = F.when(before == F.length(span["text"]), 0).otherwise(F.length(F.regexp_extract(span["text"], rf"[{S}]*\z", 0)))
        rows = rows.withColumns({"_start": span["start"] + before, "_end": span["end"] - after})
        hits = F.when(F.col("_start").isNull(), canonical).otherwise(F.filter(mine, lambda c: (c["start"] == F.col("_start")) & (c["end"] == F.col("_end"))))
    rows = rows.withColumns({"hits": hits, "alike": F.size(canonical) > 0})
    some = lambda *outcomes: F.sum(F.exists("hits", lambda c: c["outcome"].isin(*outcomes)).cast("long"))
    counts = rows.groupBy(F.col("w.field").alias("field")).agg(F.count("*").alias("expected"), F.sum((F.size("hits") > 0).cast("long")).alias("reachable"), F.sum(F.col("alike").cast("long")).alias("normalization_reachable"), some("accepted", "abstained").alias("selected"), some("accepted").alias("accepted"))
    return counts.withColumns({f"{c}_rate": _share(F.col(c), F.col("expected")) for c in ("reachable", "normalization_reachable", "selected", "accepted")})


def histograms(parsed: DataFrame) -> DataFrame:
    """How often each reason for pruning, rejection rule, and rule behind an accepted candidate occurs."""
    traced = parsed.select(F.explode("trace").alias("c"))
    parts = [
        traced.where("c.outcome = 'pruned'").select(F.lit("pruned").alias("kind"), F.col("c.reason").alias("name")),
        parsed.select(F.explode("rejections").alias("r")).select(F.lit("rejected").alias("kind"), F.col("r.ruleId").alias("name")),
        traced.where("c.outcome = 'accepted'").select(F.explode("c.evidence").alias("e")).select(F.lit("accepted").alias("kind"), F.col("e.ruleId").alias("name")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "name").agg(F.count("*").alias("n"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """sorted[floor((n - 1) p)] per group, exactly, without gathering a group: equal values are counted first, and only counts are ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.select(*by, value, "_n", F.coalesce(below, F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    at = {name: F.floor((F.col("_all") - 1) * F.lit(p)) for name, p in ps.items()}
    return ranked.groupBy(*by).agg(*[F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col(value))).alias(name) for name, k in at.items()])


def promotion_gate(slices: DataFrame, least_records: int = 5) -> DataFrame:
    """From (slice, records, candidate_exact, baseline_exact): whether the candidate is nowhere worse. Without any slice large enough the gate fails."""
    compared = F.col("records") >= least_records
    worse = compared & (F.col("candidate_exact") < F.col("baseline_exact"))
    out = slices.agg(F.sum(compared.cast("long")).alias("compared"), F.array_sort(F.collect_list(F.when(worse, F.col("slice")))).alias("failures"))
    return out.withColumn("passed", (F.coalesce("compared", F.lit(0)) > 0) & (F.size("failures") == 0))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").when(confidence > 0, "low").otherwise("none")
