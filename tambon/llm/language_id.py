"""Word-first language identification with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word falls back to its character
n-grams (with word ends), the longest first: the mean over those of the longest length that
has any known one. A document's language is the best mean over its words.

The model is fitted on a bounded sample of labelled rows, SAMPLE_PER_LANG documents of each of the
MAX_LANGS most frequent languages on average (a Bernoulli sample by a hash of the id), and
keeps at most MAX_WORDS words and MAX_GRAMS n-grams, so that what is broadcast is bounded.

Defined cases: null text, or text without a letter, gives `und` with score 0; without any
labelled row every document gets `und`; ties go to the language first in the alphabet;
repeated rows are scored one by one; a null doc_id trains like any other; a very long text is scored whole, and a very long word
counts as any other; an empty table gives no rows; extra columns are kept by `identify`, which replaces columns named lang_pred and score, and ignored by the query.
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

SAMPLE_PER_LANG = 4000
MAX_LANGS = 256
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
LONGEST_GRAM = 4
CACHE_CHUNKS = 100_000
UNKNOWN = "und"
_letters = re.compile(r"[^\W\d_]+").findall


class Model:
    """Per-language log frequencies of words and n-grams: rows of a matrix, a column for each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs = langs
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: i + len(words) for i, g in enumerate(grams)}
        self.matrix = np.array([*words.values(), *grams.values(), np.zeros(len(langs))], dtype=np.float32).reshape(len(words) + len(grams) + 1, len(langs))

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is the word's score: its own, or those of its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        padded, get = f" {word} ", self.grams.get
        for n in range(LONGEST_GRAM, 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := get(padded[i : i + n])) is not None]
            if found:
                return found
        return [len(self.matrix) - 1]


class Scorer:
    """Keeps what a worker has worked out about chunks (text between white space): number of words and sum of their scores."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.model.langs) + 1), np.float32)

    def learn(self, chunks: list[str]) -> None:
        rows, sizes, words = [], [], []
        for chunk in chunks:
            found = _letters(chunk.lower())
            words.append(len(found))
            for w in found:
                mine = self.model.rows(w)
                rows += mine
                sizes.append(len(mine))
        new = np.zeros((len(chunks), len(self.model.langs) + 1), np.float32)
        new[:, 0] = words
        if rows:
            sizes = np.array(sizes)
            means = np.add.reduceat(self.model.matrix[rows], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            np.add.at(new[:, 1:], np.repeat(np.arange(len(chunks)), words), means)
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        if len(self.known) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(chunks)), self.table.shape[1]), np.float32)])
        self.table[first : first + len(chunks)] = new

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for lo in range(0, len(texts), 100):
            if len(self.known) > CACHE_CHUNKS:
                self.clear()
            split = [(t or "").split() for t in texts[lo : lo + 100]]
            known = self.known
            new = {c for chunks in split for c in chunks if c not in known}
            if new:
                self.learn(list(new))
            for chunks in split:
                total = self.table[[known[c] for c in chunks]].sum(axis=0, dtype=np.float64)
                if not chunks or not total[0]:
                    out.append((UNKNOWN, 0.0))
                    continue
                # Words are not independent: evidence counts as that of at most 30 words.
                z = total[1:] / total[0] * min(total[0], 30)
                p = np.exp(z - z.max())
                out.append((self.model.langs[int(p.argmax())], float(p.max() / p.sum())))
        return out


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Sums (lang, key) over a partition, in bounded memory."""
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "key", "n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of(found, *row)
            if len(found) > 200_000:
                yield flush()
                found.clear()
    if found:
        yield flush()


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """From (doc_id, text, lang) of the rows that may be learned from."""
    docs = docs.where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_lang / r["count"]))])
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(share, "lang") * (1 << 20)).select("lang", "text")

    def words(found: Counter, lang: str, text: str) -> None:
        for w in _letters(text.lower()):
            found[lang, w] += 1

    def grams(found: Counter, lang: str, word: str, n: int) -> None:
        padded = f" {word} "
        for size in range(1, LONGEST_GRAM + 1):
            for i in range(len(padded) - size + 1):
                found[lang, padded[i : i + size]] += n

    kind = "lang string, key string, n long"
    counts = sample.mapInArrow(lambda b: _counted(b, words), kind).groupBy("lang", "key").agg(F.sum("n").alias("n")).cache()
    at = {lang: i for i, lang in enumerate(langs)}

    def table(counted: DataFrame, most: int, sizes: list[int]) -> dict[str, np.ndarray]:
        wide = counted.groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        rows = wide.where("all >= 3").orderBy(F.desc("all"), "key").limit(most).collect()
        raw = {r.key: np.array([r.by.get(lang, 0) for lang in langs], float) for r in rows}
        out = {}
        for size in sizes:  # n-grams of each length have their own total
            names = [k for k in raw if size < 0 or len(k) == size]
            total = sum((raw[k] for k in names), np.zeros(len(langs)))
            out |= {k: np.log((raw[k] + 0.1) / (total + 0.1 * max(1, len(names)))) for k in names}
        return out

    try:
        known = table(counts, MAX_WORDS, [-1])
        pieces = counts.mapInArrow(lambda b: _counted(b, grams), kind).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        return Model([*at], known, table(pieces, MAX_GRAMS, list(range(1, LONGEST_GRAM + 1))))
    finally:
        counts.unpersist()


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        scorer = worker_cache(key, lambda: Scorer(held.value))
        return pd.DataFrame(scorer(texts.tolist()), columns=["lang_pred", "score"])

    predict = predict.asNondeterministic()  # else a filter on what it returns would have it run twice
    found = f"_found_{key}"
    return docs.withColumn(found, predict(F.col(text))).withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}).drop(found)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    docs = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
    model = fit(docs.where("not held_out"))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The pipeline's stage: documents without a recognisable language go; a missing `lang` is filled with the one found."""
    model = fit(only(docs, doc_id="long", text="string", lang="string").where(F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) != 0))
    found = identify(docs, model).where(F.col("lang_pred") != UNKNOWN).where(F.col("score") >= least)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)
