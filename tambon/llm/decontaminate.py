"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, exact check.

Texts become words (white-space chunks, lower-cased, letters and digits only). The random walk of Chakraborty, Goldenberg
and Koucky copies a sequence into a longer one, at each step staying on a word or moving on as
a random function of step and word says; sequences at a small edit distance then often agree
step by step, so that edit distance becomes Hamming distance. Windows of documents, about as long as items, are
embedded at every STRIDE-th word; items at each of their words that leaves a whole window, so that
some pair of windows is aligned whatever the passage's place. REPEATS independent walks are sampled at BITS
places BANDS times each (twice as often for items looked up at stride 1). A window is so short that the shortest passage within the distance (all edits deletions) holds one at a
stride's place, and at most half of that passage. Windows that agree with an item in a sample are candidates, and each
candidate is verified: the item's word edit distance to the best passage there must be at most
(1 - SIMILARITY) of its length. Over random texts with as many deletions, insertions or substitutions as that allows, these values
found 95 % and more of passages at each length tested (see the tests).

Items are broadcast in blocks of at most ITEMS items and WORDS words; a larger benchmark takes more passes over the documents.

Defined cases: null or empty texts contain nothing; an item that is null or has no word matches
nothing; items too short for windows of 4 words are looked up at stride 1, and below 4 words only
exactly, by a look-up of all runs of so many words; equal items are looked up once and all reported; a row per row of documents and item, at the best place, the
first of equally good ones found; repeated rows give rows each; a very long text is scanned in whole; an empty table of either kind gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import stir
from .shared import only, read_table, stored, worker_cache

SIMILARITY = 0.8
STRIDE = 8
REPEATS, BANDS, BITS = 4, 6, 4
LENGTHS = (4, 6, 8, 12, 16, 32)
ITEMS, WORDS = 20_000, 2_000_000
CACHE_CHUNKS = 100_000
_not_word = re.compile(r"[\W_]+")
_prime = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, chunk: str) -> int:
        word = chunk.lower()
        if not word.isalnum():  # the pattern would find nothing in it
            word = _not_word.sub("", word)
        value = (xxhash.xxh64_intdigest(word) | 1) if word else 0
        if len(chunk) <= 64:
            self[chunk] = value
        return value


def words(text: str | None) -> np.ndarray:
    hashes = worker_cache("chunk hashes", _Hashes)
    if len(hashes) > CACHE_CHUNKS:
        hashes.clear()
    chunks = (text or "").split()
    h = np.fromiter(map(hashes.__getitem__, chunks), np.uint64, len(chunks))
    return h[h != 0]


def allowed(n: int, similarity: float) -> int:
    return int(round((1 - similarity) * n, 9))


def shortest(n: int, similarity: float) -> int:
    """Words of the shortest passage within the distance: all edits are deletions."""
    return n - allowed(n, similarity)


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of the item to any passage of the text, and where the passage begins and ends."""
    at = np.arange(len(text) + 1)
    row, start = np.zeros(len(text) + 1, np.int64), at.copy()
    for i, w in enumerate(item):
        # Distance and start travel together in one number, so that minima keep the start.
        code = row * (1 << 32) + start
        put = np.minimum(code[1:] + (1 << 32), code[:-1] + ((text != w).astype(np.int64) << 32))
        put = np.append((i + 1) << 32, put)
        put = np.minimum.accumulate(put - (at << 32)) + (at << 32)
        row, start = put >> 32, put & 0xFFFFFFFF
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def walk(hashes: np.ndarray, starts: np.ndarray, steps: int, visit) -> None:
    """visit(step, hashes read at it): `hashes` are the words', mixed for one walk, with `steps` more at the end."""
    at = starts.copy()
    for step in range(steps):
        h = hashes[at]
        visit(step, h)
        bit = h >> np.uint64(step % 64)
        bit &= np.uint64(1)
        at += bit.view(np.int64)


def first_look(keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """Marks by the upper bits of some keys, about 32 marks a key: small enough for a core's cache."""
    n = max(12, min(24, int(32 * max(1, len(keys))).bit_length()))
    marks = np.zeros(1 << n, bool)
    marks[keys >> np.uint64(64 - n)] = True
    return np.uint64(64 - n), marks


def looked_up(look: tuple[np.uint64, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The places of keys that may be there."""
    return np.flatnonzero(look[1][keys >> look[0]])


class Runs:
    """Items of fewer words than the shortest window: found as they are."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items, self.tables = items, {}
        for n in sorted({len(x) for _, x in items}):
            which = np.array([i for i, (_, x) in enumerate(items) if len(x) == n])
            keys = self.keys(np.concatenate([items[i][1] for i in which]), n)[::n]
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], which[order], first_look(keys)

    @staticmethod
    def keys(tokens: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
        for i in range(n):
            out = stir(out * _prime + tokens[i : len(tokens) - n + 1 + i])
        return out

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """As Index.matches, at distance 0 and the first place."""
        ends = np.cumsum([len(t) for t in texts])
        tokens, found = (np.concatenate(texts) if texts else np.zeros(0, np.uint64)), []
        for n, (table, which, look) in self.tables.items():
            keys = self.keys(tokens, n)
            at = looked_up(look, keys)
            left, right = (np.searchsorted(table, keys[at], side) for side in ("left", "right"))
            at, left, right = at[left < right], left[left < right], right[left < right]
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
            at, left, right, doc = at[inside], left[inside], right[inside], doc[inside]
            _, first = np.unique(doc * len(table) + left, return_index=True)
            for k in first.tolist():
                lo = int(at[k] - (ends[doc[k] - 1] if doc[k] else 0))
                found += [(int(doc[k]), int(which[x]), 0, lo, lo + n) for x in range(left[k], right[k])]
        return sorted(found)


class Index:
    """The samples of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stride: int, similarity: float, seed: int = 7):
        self.items, self.stride, self.similarity = items, stride, similarity
        self.bands = BANDS if stride > 1 else 2 * BANDS  # short items have few windows
        rng = np.random.default_rng(seed)
        self.steps = 2 * LENGTHS[-1]
        # places[repeat][length] is a list of bands, each a list of steps below twice the length.
        self.places = [[[np.sort(rng.choice(2 * n, BITS, replace=False)) for _ in range(self.bands)] for n in LENGTHS] for _ in range(REPEATS)]
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, (_, item) in enumerate(items):
            least = shortest(len(item), similarity)
            by_length[max(k for k, n in enumerate(LENGTHS) if n <= max(LENGTHS[0], min(least - stride + 1, least // 2)))].append(i)
        self.lengths = sorted(by_length)
        self.steps = 2 * LENGTHS[self.lengths[-1]] if self.lengths else 0
        tail = np.arange(self.steps, dtype=np.uint64)
        # The items' words as numbers, and a first look at words of texts by their upper bits.
        self.vocabulary = np.unique(np.concatenate([x for _, x in items]))
        self.numbered = [np.searchsorted(self.vocabulary, x) for _, x in items]
        self.known = first_look(self.vocabulary)
        self.tables = {}
        for k in self.lengths:
            which = np.concatenate([np.full(max(1, len(items[i][1]) - LENGTHS[k] + 1), i) for i in by_length[k]])
            start = np.concatenate([np.arange(max(1, len(items[i][1]) - LENGTHS[k] + 1)) for i in by_length[k]])
            for repeat in range(REPEATS):
                keys = []
                for i in by_length[k]:
                    own = start[which == i]
                    keys.append(self.keys(np.append(items[i][1], tail), own, repeat, [k])[k])
                for band in range(self.bands):
                    key = np.concatenate([x[band] for x in keys])
                    order = np.argsort(key, kind="stable")
                    self.tables[repeat, k, band] = key[order], which[order], start[order], first_look(key)

    def keys(self, tokens: np.ndarray, starts: np.ndarray, repeat: int, lengths: list[int]) -> dict[int, list[np.ndarray]]:
        """`tokens` end with `steps` more than windows may start at."""
        mixed = stir(tokens + np.uint64((repeat + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        wanted = defaultdict(list)
        out = {k: [np.full(len(starts), band + 1, np.uint64) for band in range(self.bands)] for k in lengths}
        for k in lengths:
            for band, places in enumerate(self.places[repeat][k]):
                for p in places:
                    wanted[int(p)].append(out[k][band])

        def visit(step: int, h: np.ndarray) -> None:
            for key in wanted.get(step, ()):
                key *= _prime
                key ^= h
                key ^= key >> np.uint64(29)

        walk(mixed, starts, self.steps if len(lengths) > 1 else 2 * LENGTHS[lengths[0]], visit)
        for k in lengths:
            for key in out[k]:
                key *= _prime
        return out

    def candidates(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places where they would begin, each pair once, in order."""
        found = []
        padded = np.append(tokens, np.arange(self.steps, dtype=np.uint64))
        for lo in range(0, len(tokens), self.stride * 16384):
            starts = np.arange(lo, min(len(tokens), lo + self.stride * 16384), self.stride)
            for repeat in range(REPEATS):
                keys = self.keys(padded, starts, repeat, self.lengths)
                for k in self.lengths:
                    for band in range(self.bands):
                        table, which, start, look = self.tables[repeat, k, band]
                        key = keys[k][band]
                        maybe = looked_up(look, key)
                        if len(maybe):
                            left, right = np.searchsorted(table, key[maybe], "left"), np.searchsorted(table, key[maybe], "right")
                            times = right - left
                            x = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
                            # One number a pair; a place may be below zero by an item's length.
                            found.append(np.unique((which[x] << 44) + np.repeat(starts[maybe], times) - start[x] + (1 << 40)))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs >> 44, (pairs & ((1 << 44) - 1)) - (1 << 40)

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens as numbers of the items' words; other words get a number of their own."""
        out = np.full(len(tokens), len(self.vocabulary))
        maybe = looked_up(self.known, tokens)
        at = np.minimum(np.searchsorted(self.vocabulary, tokens[maybe]), len(self.vocabulary) - 1)
        right = self.vocabulary[at] == tokens[maybe]
        out[maybe[right]] = at[right]
        return out

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item, distance, first word, word after the last), the best place of each pair."""
        ends = np.cumsum([len(t) for t in texts])
        if not len(ends) or not ends[-1] or not self.items:
            return []
        tokens, best, tried = np.concatenate(texts), {}, {}
        items, places = self.candidates(tokens)
        if not len(items):
            return []
        numbers, here = self.numbers(tokens), np.zeros(len(self.vocabulary) + 1, bool)
        sizes = np.array([len(x) for _, x in self.items])[items]
        most_of = [allowed(len(x), self.similarity) for _, x in self.items]
        last_word = int(ends[-1]) - 1
        docs_of = [np.searchsorted(ends, np.clip(x, 0, last_word), "right").tolist() for x in (places, places + sizes // 2, places + sizes - 1)]
        for item, place, *docs in zip(items.tolist(), places.tolist(), *docs_of, strict=True):
            words = self.items[item][1]
            most = most_of[item]
            # The window's place says where the item begins, but for the edits before it and the walk's own.
            slack = most + self.stride
            for doc in set(docs):
                first, last = (int(ends[doc - 1]) if doc else 0), int(ends[doc])
                before = tried.get((doc, item))
                if before and before[0] <= place <= before[1]:
                    continue
                lo, hi = max(first, place - slack), min(last, place + len(words) + slack)
                if hi <= lo:
                    continue
                tried[doc, item] = (place, place + max(0, self.stride - 1))
                here[numbers[lo:hi]] = True
                shared = np.count_nonzero(here[self.numbered[item]])
                here[numbers[lo:hi]] = False
                if shared < len(words) - most:
                    continue
                distance, a, b = best_passage(words, tokens[lo:hi])
                if distance <= most and (doc, item) not in best or distance < best.get((doc, item), (most + 1,))[0]:
                    best[doc, item] = (distance, lo + a - first, lo + b - first)
        return [(doc, item, *x) for (doc, item), x in sorted(best.items())]


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, distance, start_word, end_word for each document and item found in it."""
    docs = only(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    items = only(benchmark, item_id="long", text="string").where("text is not null").withColumn("item", F.xxhash64("text"))
    kind = "doc_id long, text_hash long, item long, distance int, start_word long, end_word long"

    def scan(indexes) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    texts = [words(t) for t in part.column(2).to_pylist()]
                    got = [(g[0], index.items[g[1]][0], *g[2:]) for index in indexes.value for g in index.matches(texts)]
                    if got:
                        at, item, distance, first, end = zip(*got, strict=True)
                        ids = [c.take(pa.array(at)) for c in part.columns[:2]]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "text_hash", "item", "distance", "start_word", "end_word"])

        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null").mapInArrow(rows, kind)

    found, block, size = [], [], 0

    def close() -> None:
        least = lambda item: shortest(len(item), similarity)
        short = [x for x in block if len(x[1]) < LENGTHS[0]]
        indexes: list = [Runs(short)] if short else []
        for stride, group in ((STRIDE, [x for x in block if least(x[1]) >= STRIDE + LENGTHS[0] - 1]), (1, [x for x in block if len(x[1]) >= LENGTHS[0] and least(x[1]) < STRIDE + LENGTHS[0] - 1])):
            if group:
                indexes.append(Index(group, stride, similarity))
        if indexes:
            found.append(scan(spark.sparkContext.broadcast(indexes)))
        block.clear()

    for row in items.select("item", "text").distinct().orderBy("item", "text").toLocalIterator():  # a block at a time on the driver
        item = words(row.text)
        if len(item):
            block.append((row.item, item))
            size += len(item)
            if len(block) >= ITEMS or size >= WORDS:
                close()
                size = 0
    close()
    out = spark.createDataFrame([], kind)
    for part in found:
        out = out.unionByName(part)
    return out.join(items.select("item", "item_id"), "item").select("doc_id", "text_hash", "item_id", "distance", "start_word", "end_word")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold a benchmark item go."""
    gone = stored(find(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
