"""Fitting label directions: gold centroids, candidate contrast, and pairwise residuals."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .kernel import FIELD, Gazetteer, Parser
from .scoring import LABELS, Resources, candidate_features, logit, sigmoid, span_matrix


#: Texts whose spans, or whose candidates, are made into vectors at once: enough to share the cost of a call, few enough for their vectors to stay small.
TEXTS_AT_ONCE = 64
CANDIDATES_OF = 8


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) or 1.0)


_SUMS = pa.schema([("k", pa.int32()), ("packed", pa.binary())])


def _sums(vectors: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """What a task adds: a row for each vector, its weight before it."""
    held = np.column_stack((weights, vectors))
    k = np.flatnonzero(held.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([held[x].tobytes() for x in k], pa.binary())], schema=_SUMS)


def _added(records: DataFrame, add, count: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and weights that tasks of `add` sum up, added once more, a task for each vector: the driver gets one row of it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((count, 1 + dimension))
        for batch in batches:
            for k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[k] += np.frombuffer(packed)
        yield _sums(held[:, 1:], held[:, 0])

    held = np.zeros((count, 1 + dimension))
    for row in records.mapInArrow(add, "k int, packed binary").repartitionById(count, F.col("k")).mapInArrow(merge, "k int, packed binary").collect():
        held[row.k] = np.frombuffer(row.packed)
    return held[:, 1:], held[:, 0]


def fit_centroids(records: DataFrame, r: Resources, other_as_negative: bool = False) -> dict:
    """From (raw, spans[label, start, end], weight): per label, the weighted mean of its spans less that of the others, of length one. Each task adds up its records, so labels times dimension rows of it move."""
    labels = (*LABELS, *(("OTHER",) if other_as_negative else ()))
    row_of = {label: k for k, label in enumerate(labels)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights = np.zeros((len(labels), r.dimension)), np.zeros(len(labels))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts, found, shares = part.column("raw").to_pylist(), [], []
                for k, (spans, weight) in enumerate(zip(part.column("spans").to_pylist(), part.column("weight").to_pylist(), strict=True)):
                    if weight:
                        for s in spans:
                            if s["label"] in row_of:
                                found.append((k, s["start"], s["end"]))
                                shares.append((row_of[s["label"]], weight))
                if found:
                    dealt = np.zeros((len(labels), len(found)))
                    dealt[[k for k, _ in shares], range(len(found))] = [weight for _, weight in shares]
                    vectors += dealt @ span_matrix([x or "" for x in texts], found, r)
                    weights += dealt.sum(axis=1)
        yield _sums(vectors, weights)

    rows = _dealt(records.select("raw", "spans", F.col("weight").cast("double").alias("weight")))
    vectors, weights = _added(rows, add, len(labels), r.dimension)
    whole, total = vectors.sum(axis=0), weights.sum()
    return {label: (_unit(vectors[k] / weights[k] - (whole - vectors[k]) / (total - weights[k])), 0.0) for label, k in row_of.items() if label in LABELS and 0 < weights[k] < total}


def fit_contrast(records: DataFrame, places: list[dict], r: Resources, negatives: int = 32) -> dict:
    """From (raw, the seven expected fields, weight): the mean of right candidates less that of the strongest wrong ones; a record's weight is shared among its candidates. Each task adds up its records."""
    if negatives <= 0:
        raise ValueError("negatives must be positive")

    group_of = {label: 2 * n for n, label in enumerate(LABELS)}  # the wrong ones, and after them the right ones
    count = 2 * len(LABELS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(Gazetteer(places))
        vectors, weights = np.zeros((count, r.dimension)), np.zeros(count)
        for batch in batches:
            for first in range(0, batch.num_rows, CANDIDATES_OF):
                rows, shares, at = batch.slice(first, CANDIDATES_OF).to_pylist(), [], {}
                for text, row in enumerate(rows):
                    if not row["weight"]:
                        continue
                    scan, seeds, _ = parser.seeds(row["raw"] or "")
                    parser.score(scan, seeds)
                    groups = [[] for _ in range(count)]
                    for s in seeds:
                        groups[group_of[s.label] + (s.canonical == row[FIELD[s.label]])].append(s)
                    for k, group in enumerate(groups):
                        if not k % 2:
                            group = sorted(group, key=lambda s: (-s.evidence, -s.score))[:negatives]
                        if group:
                            weights[k] += row["weight"]
                            share = row["weight"] / len(group)
                            shares += [(k, at.setdefault((text, s.start, s.end), len(at)), share) for s in group]
                if at:
                    k, place, share = zip(*shares, strict=True)
                    dealt = np.bincount(np.array(k) * len(at) + place, share, minlength=count * len(at)).reshape(count, len(at))
                    vectors += dealt @ span_matrix([row["raw"] or "" for row in rows], list(at), r)
        yield _sums(vectors, weights)

    rows = _dealt(records.select("raw", F.col("weight").cast("double").alias("weight"), *FIELD.values()))
    vectors, weights = _added(rows, add, count, r.dimension)
    return {label: (_unit(vectors[k + 1] / weights[k + 1] - vectors[k] / weights[k]), 0.0) for label, k in group_of.items() if weights[k] and weights[k + 1]}


def fit_pairwise(records: DataFrame, places: list[dict], r: Resources, epochs: int = 6, rate: float = 0.04, l2: float = 1e-5, negatives: int = 8) -> dict:
    """Logistic descent on pairs (right, wrong), with an empty option for absent fields; evidence is the fixed part of the margin.

    From (id, raw, spans, weight). Candidates are generated and hashed once, distributed, and packed as one row per record and label. The updates themselves
    depend on their order, so each label's examples are replayed in the order of ids by one task per label, which holds one record at a time: sorted examples
    are written to a local file as they come, and each epoch reads it through.
    """
    if r.features != "candidate-hash-v3" or r.scoring != "residual-rank-v2":
        raise ValueError("pairwise fitting requires candidate-hash-v3 and residual-rank-v2")
    if not (epochs > 0 and rate > 0 and l2 >= 0 and negatives > 0):
        raise ValueError("epochs, rate and negatives must be positive, l2 non-negative")
    active = [x for x in LABELS if r.by_label.get(x, 0) > 0]
    if not active:
        return {}
    made = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("id", records.schema["id"].dataType), *T._parse_datatype_string("weight double, packed binary")])
    made_arrow, fitted = to_arrow_schema(made), "label int, vector array<double>, bias double"

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(Gazetteer(places))
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if not row["weight"]:
                    continue
                scan, seeds, _ = parser.seeds(row["raw"])
                for n, label in enumerate(active):
                    gold = next((s for s in row["spans"] if s["label"] == label), None)
                    span = gold and _trim(row["raw"], gold["start"], gold["end"])
                    mine = [s for s in seeds if s.label == label]
                    right = [s for s in mine if span and (s.start, s.end) == span]
                    wrong = sorted((s for s in mine if not span or (s.start, s.end) != span), key=lambda s: -s.evidence)[:negatives]
                    shown = [*right, *wrong]
                    if shown and (right or not span):
                        packed = _pack([candidate_features(scan, s, r) for s in shown], [logit(s.evidence) for s in shown], len(right))
                        rows.append({"label": n, "id": row["id"], "weight": row["weight"], "packed": packed})
            yield pa.RecordBatch.from_pylist(rows, schema=made_arrow)

    def replay(held) -> tuple[np.ndarray, float]:
        w, bias = np.zeros(r.dimension), 0.0
        for epoch in range(epochs):
            held.seek(0)
            while head := held.read(struct.calcsize(_HEAD)):
                weight, size = struct.unpack(_HEAD, head)
                presence, base, at, x, either = _unpack(held.read(size))
                step, here = rate / np.sqrt(epoch + 1) * weight, w[at]
                for pair, keep, push, fixed, sides in zip(x, 1 - step * l2 * either, step * x, base, presence, strict=True):
                    pull = sigmoid(-(bias * sides + fixed + float(pair.dot(here))))
                    here *= keep
                    here += pull * push
                    bias += step * pull * sides
                w[at] = here
        return w, float(bias)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            vector, bias = replay(held)
            return pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([vector.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["label", "vector", "bias"])

        label = None
        with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as held:
            for batch in batches:
                for other, weight, packed in zip(*(batch.column(c).to_pylist() for c in ("label", "weight", "packed")), strict=True):
                    if other != label:
                        if label is not None:
                            yield done()
                            held.seek(0)
                            held.truncate()
                        label = other
                    held.write(struct.pack(_HEAD, weight, len(packed)))
                    held.write(packed)
            if label is not None:
                yield done()

    rows = _dealt(records.select("id", "raw", "spans", F.col("weight").cast("double").alias("weight"))).mapInArrow(examples, made)
    rows = rows.repartitionById(len(active), F.col("label")).sortWithinPartitions("label", "id").select("label", "weight", "packed")
    found = {active[x.label]: (np.array(x.vector), x.bias) for x in rows.mapInArrow(fit, fitted).collect()}
    return {label: found.get(label, (np.zeros(r.dimension), 0.0)) for label in active}


def _dealt(records: DataFrame) -> DataFrame:
    """Candidates of a record cost far more than moving it, and records may come in one small file: they are dealt over the cores, some tasks for each."""
    spark = records.sparkSession
    return records.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


_HEAD = "<di"  # weight, packed bytes


def _pack(features: list[dict[int, int]], base: list[float], rights: int) -> bytes:
    """The updates of a record: differences of its candidates over the features that any of them has, and which of these either candidate has."""
    at, column = np.unique(np.concatenate([np.fromiter(x, np.int32, len(x)) for x in features]), return_inverse=True)
    x = np.zeros((len(features), len(at)))
    x[np.repeat(np.arange(len(features)), [len(f) for f in features]), column] = np.concatenate([np.fromiter(f.values(), np.int32, len(f)) for f in features])
    signs = _pairs(rights, len(features))
    pairs = signs @ x
    size = next(k for k in (1, 2, 4) if np.abs(pairs).max(initial=0) < 1 << 8 * k - 1)
    either = (np.abs(signs) @ np.abs(x) > 0).astype(np.int8)
    return b"".join((struct.pack("<iii", *pairs.shape, size), signs.sum(axis=1).astype("<f8").tobytes(), (signs @ base).astype("<f8").tobytes(), at.astype("<i4").tobytes(), pairs.astype(f"<i{size}").tobytes(), either.tobytes()))


def _unpack(packed: bytes):
    """Per update: sides by sign, fixed margin; the features' places; differences and presence as matrices."""
    n, wide, size = struct.unpack_from("<iii", packed)
    numbers, cells = np.frombuffer(packed, "<f8", 2 * n, 12).tolist(), 12 + 16 * n + 4 * wide
    x = np.frombuffer(packed, f"<i{size}", n * wide, cells).astype(np.float64).reshape(n, wide)
    return numbers[:n], numbers[n:], np.frombuffer(packed, "<i4", wide, 12 + 16 * n), x, np.frombuffer(packed, np.int8, n * wide, cells + size * n * wide).reshape(n, wide)


@lru_cache(maxsize=1024)
def _pairs(rights: int, n: int) -> np.ndarray:
    """The updates of a record in order, as signs of its candidates: each right one against nothing and against each wrong one; without any, nothing against each wrong one."""
    one = np.eye(n)
    if not rights:
        return -one
    return np.array([x for a in one[:rights] for x in (a, *(a - b for b in one[rights:]))])


def _trim(raw: str, start: int, end: int):
    from .kernel import trimmed

    return trimmed(raw, start, end)


def family_weights(records: DataFrame, family: str) -> DataFrame:
    """`records` with weight = n / (families * n of the family): families count alike. Families are few; the table of their sizes is broadcast."""
    sizes = records.groupBy(family).agg(F.count("*").alias("_mine"))
    total = sizes.agg(F.sum("_mine").alias("_n"), F.count("*").alias("_families"))
    return records.join(F.broadcast(sizes), family).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / (F.col("_families") * F.col("_mine"))).drop("_mine", "_n", "_families")


__all__ = ["family_weights", "fit_centroids", "fit_contrast", "fit_pairwise"]
