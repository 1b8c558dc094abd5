"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities, counts and weights of a lexicon, hits near a second-person
word, rates of capitals, punctuation and obfuscated words, length. The lexicon is learned from labels:
words and word beginnings that are far more frequent, by documents, in toxic ones. Lexicon features of a
training row come from a lexicon of the other fold, so that trees don't trust a word for having
been in that very row. Calibration is isotonic over out-of-fold scores and weights classes by their
whole counts.

The classifier is fitted on a bounded Bernoulli sample of labelled rows: SAMPLE_PER_CLASS of each
class on average. Lexicon and trees are bounded by LEXICON and ROUNDS.

Defined cases: null or empty text scores like one without any sign of toxicity; labels that are
null or match no document are not learned from; without rows of both classes the score is the share of toxic labels (0 without
any); a row whose doc_id is null is held out and scored; repeated rows are scored one by one; equal texts get equal scores; a very long text
is scored whole; an empty table gives no rows; extra columns are ignored, and `score` replaces columns of the names that it adds.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, read_table, remainder, worker_cache

SAMPLE_PER_CLASS = 5000
LEXICON = 20_000
LEAST_DOCS = 3
LEAST_WEIGHT = 2.0
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 32
THRESHOLD = 0.3
CACHE_CHUNKS = 150_000
NEAR = 5
#: Second-person words of the corpus languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_plain_letters = str.maketrans("013457@$!", "oieastasi")
_strange = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]|[^\W\d_](?:[.\-_*][^\W\d_]){2,}|([^\W\d_])\1{3,}")
_edges = ".,;:!?\"'()[]{}|<>*%$&#-_ "
NAMES = ["hits", "hits_100", "weight", "weight_100", "strongest", "kinds", "near_you", "capitals", "marks", "obfuscated", "obfuscated_hits", "log_words"]


def keys(chunk: str) -> list[str]:
    """The lexicon keys of a chunk: the word, and its beginnings of 4 to 6 letters."""
    word = chunk.lower().strip(_edges)
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)] if word else []


class Chunks:
    """Per chunk: lexicon weight, second person?, letters, capitals, marks, obfuscated?, hit only once plain?"""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.rows, self.table = lexicon, {}, np.zeros((1024, 8))

    def add(self, chunk: str) -> int:
        at = self.rows[chunk] = len(self.rows)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        get, word = self.lexicon.get, chunk.lower().strip(_edges)
        weight = max(get(word, 0.0), *(get(f"{word[:n]}*", 0.0) for n in (4, 5, 6) if len(word) > n), 0.0)
        strange, hidden, marks = False, 0.0, 0
        if not (alphabetic := chunk.isalpha()) or len(set(word)) * 2 < len(word):
            strange = bool(_strange.search(chunk))
            if not weight and (strange or any(c in "@$!0134579" for c in chunk.strip(_edges))):
                plain = re.sub(r"[.\-_*]", "", chunk.lower().strip(".,;:!?")).translate(_plain_letters)
                plain = [plain, re.sub(r"(.)\1{2,}", r"\1", plain)]
                hidden = max((get(k, 0.0) for p in plain for k in keys(p)), default=0.0)
            marks = sum(c in "!?*#@$%&" for c in chunk)
        letters = len(chunk) if alphabetic else sum(map(str.isalpha, chunk))
        capitals = 0 if chunk.islower() else sum(map(str.isupper, chunk))
        self.table[at] = (max(weight, hidden), word in YOU, letters, capitals, marks, strange, hidden > 0, len(chunk))
        return at

    def features(self, text: str | None) -> np.ndarray:
        if len(self.rows) > CACHE_CHUNKS:
            self.rows, self.table = {}, np.zeros((1024, 8))
        chunks, known, add = (text or "").split(), self.rows, self.add
        out = np.zeros(len(NAMES))
        if not chunks:
            return out
        at = np.array([known[c] if c in known else add(c) for c in chunks])
        weight = self.table[at, 0]
        sums = np.bincount(at, minlength=len(self.rows)) @ self.table[: len(self.rows)] if len(at) > 4 * len(self.rows) else self.table[at].sum(axis=0)
        hit = np.flatnonzero(weight)
        n = len(chunks)
        near = 0
        if len(hit) and sums[1]:
            you = np.flatnonzero(self.table[at, 1])
            after = np.searchsorted(you, hit - NEAR)
            near = int(np.count_nonzero((after < len(you)) & (you[np.minimum(after, len(you) - 1)] <= hit + NEAR)))
        out[:] = [len(hit), 100 * len(hit) / n, sums[0], 100 * sums[0] / n, weight.max(), len(set(at[hit].tolist())), near, sums[3] / max(1, sums[2]), sums[4] / max(1, sums[7]), sums[5] / n, sums[6], np.log1p(n)]
        return out


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level on binned features."""

    def __init__(self) -> None:
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        share = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-total))
            tree, leaf = self._grow(binned, w * (y - p), w * p * (1 - p))
            total += leaf
            self.trees.append(tree)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(g), int)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = RATE * gs / (hs + 1)
            if node >= nodes // 2 or len(mine) < 10:
                continue
            best = (1e-6, -1, 0)
            for f in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(x[mine, f], g[mine], BINS))[:-1]
                left_h = np.cumsum(np.bincount(x[mine, f], h[mine], BINS))[:-1]
                gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best[0] and 1e-9 < left_h[k] < hs - 1e-9:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1:]
                at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
        return (feature, cut, value), value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (binned[rows, np.maximum(f, 0)] > cut[at]))
            total += value[at]
        return total


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y by weighted squares (pool adjacent violators): upper ends and values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # value, weight, upper end
    for s, v, q in zip(score[order], y[order], w[order], strict=True):
        if blocks and blocks[-1][2] == s:
            last = blocks[-1]
            last[0], last[1] = (last[0] * last[1] + v * q) / (last[1] + q), last[1] + q
        else:
            blocks.append([float(v), float(q), float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, ends: np.ndarray, values: np.ndarray, share: float):
        self.lexicon, self.trees, self.ends, self.values, self.share = lexicon, trees, ends, values, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        raw = self.trees.score(x)
        # Linear between the middles of steps keeps the order of scores within a step.
        p = np.interp(raw, self.ends, self.values)
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-raw)), 0, 1)


def lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    found = {}
    for key, t, c in rows:
        weight = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t >= LEAST_DOCS and weight >= LEAST_WEIGHT:
            found[key] = float(weight)
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """From (doc_id, text) and (doc_id, toxic) of the rows that may be learned from.

    Labels that match no document don't count. They are sampled before they meet the texts: at most about 2 * per_class ids go to every task, and no text moves but the sample's.
    """
    labels = labels.join(docs.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2 * LEAST_DOCS:
        return Model({}, None, np.zeros(0), np.zeros(0), share)
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    sample = docs.join(F.broadcast(picked), "doc_id").select("toxic", "text", (F.shiftright(F.xxhash64("doc_id"), 24) % 2 == 0).cast("int").alias("fold")).cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            some = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int32()), pa.array([k[2] for k in some], pa.int32()), pa.array([found[k] for k in some], pa.int64())], names=["key", "toxic", "fold", "n"])

        for batch in batches:
            for toxic, text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((k, toxic, fold) for k in {k for chunk in set((text or "").split()) for k in keys(chunk)})
                if len(found) > 300_000:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    try:
        totals = {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
        total = lambda t, f: sum(n for (a, b), n in totals.items() if a == t and f in (b, None))
        cell = lambda t, f: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0))
        counts = sample.mapInArrow(count, "key string, toxic int, fold int, n long").groupBy("key").agg(*[cell(t, f).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)])
        # The most telling keys only: bounded by a multiple of the lexicon's size.
        best = counts.where(f"n10 + n11 >= {LEAST_DOCS}").withColumn("odds", F.expr(f"ln((n10 + n11 + 0.5) / (n00 + n01 + 0.5)) + ln({total(0, None) + 1}D / {total(1, None) + 1}D)")).where(f"odds >= {LEAST_WEIGHT}").orderBy(F.desc("odds"), "key").limit(3 * LEXICON).collect()
        by_fold = [lexicon([(r.key, r[f"n1{f}"], r[f"n0{f}"]) for r in best], total(1, f), total(0, f)) for f in (0, 1)]
        full = lexicon([(r.key, r.n10 + r.n11, r.n00 + r.n01) for r in best], total(1, None), total(0, None))
        held = sample.sparkSession.sparkContext.broadcast(by_fold)

        def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [Chunks(x) for x in held.value]
            for batch in batches:
                got = [(t, f, tables[1 - f].features(x).tolist()) for t, x, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

        got = sample.mapInArrow(featurise, "toxic int, fold int, x array<double>").toPandas()  # bounded by the sample
    finally:
        sample.unpersist()
    # A fixed order, so that the same rows give the same trees.
    x = np.array(got.x.tolist()).reshape(len(got), len(NAMES))
    order = np.lexsort([*x.T, got.fold.to_numpy(), got.toxic.to_numpy()])
    x, y, fold = x[order], got.toxic.to_numpy()[order].astype(float), got.fold.to_numpy()[order]
    if len(np.unique(y)) < 2:
        return Model({}, None, np.zeros(0), np.zeros(0), share)
    w = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    w /= w.mean()
    raw = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any() and (fold != f).any():
            raw[fold == f] = Trees().fit(x[fold != f], y[fold != f], w[fold != f]).score(x[fold == f])
    ends, values = isotonic(raw, y, w)
    return Model(full, Trees().fit(x, y, w), ends, values, share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        model = held.value
        chunks = worker_cache(key, lambda: Chunks(model.lexicon))
        x = np.array([chunks.features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return pd.Series(model.score(x))

    of = of.asNondeterministic()  # else what is worked out from the score would have it run again
    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """One label a document: repeated rows count as toxic if any is."""
    return only(labels, doc_id="long", toxic="int").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    docs = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(True)))
    labels = trusted_labels(read_table(spark, sf_dir, "labels"))
    may = labels.where(remainder(F.col("doc_id"), 4) != 2)
    return score(docs, fit(docs, may)).select("doc_id", "held_out", "score", "predicted")
