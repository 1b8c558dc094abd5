"""Perplexity under an interpolated modified Kneser-Ney model, and a filter by language.

The model is a bigram model over all words of trusted text (documents labelled quality = 1); every trusted
document and word is counted, none is sampled. Words are white-space chunks without one trailing mark, lower-cased
when only the first letter is a capital. A word that trusted text doesn't have gets the uniform share of the lower order.

The HEAD most frequent words go by numbers, and what is known of them is held in arrays of that size. All others go by
64-bit hashes with the top bit set; what is known of them is sharded as bigrams are. The head only saves bytes: scores don't depend on it.

Sharded count joins: a bigram of two numbers is a number of 2 * BITS bits, any other a hash of both, and its shard a range of those. Counting
sends packed arrays of distinct bigrams to shards, where they are summed; scoring sends the distinct keys of each
batch of documents (bigrams, and hashed words as words and as histories) to the same shards, where they meet the counts. A
document's log-probability is what its numbered words give when no bigram is known plus, for every known key, a
correction. So a shard returns partial sums, and one small shuffle adds them. A task holds one shard of
the counts and one batch at a time; the number of shards follows spark.sql.shuffle.partitions.

The filter: one trusted document in HELD_OUT (by a hash of its id) is kept out of the counts, since the
model knows its own documents better than others. Per language, the log perplexities of those give the LOW and HIGH quantiles, widened
by MARGIN times their distance from the median; documents outside go. A counted document is scored without its own
occurrences (leave one out), so that it is held against the same bounds as if it had no label. Fewer than LEAST_HELD held-out documents say little
of their language: its bounds are then widened to hold those of all languages together, and the distances of all languages from their median, widened
too, around the median of the language's held-out documents and that of all its documents. A language without trusted documents is
held against those of all languages together.

Defined cases: null or empty text has null perplexity and goes; without any trusted row every
document's perplexity is null and nothing is filtered; with fewer than LEAST_HELD held out in all, none is filtered but those without words; repeated rows get equal scores, and a row per
distinct (doc_id, text); a null doc_id is scored; null languages form one group.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import stir
from .shared import dropped, give_back, only, read_table, shuffle_partitions, stored, worker_cache

BITS = 18
HEAD = 1 << BITS
START, FIRST = 1, 2  # the uniform distribution has a place for the unknown word and one for the start
HASH_BITS = 47  # of keys that are hashes: a key that the model doesn't have meets one with a probability of the model's size / 2^47
_top, _mix, _hash = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << HASH_BITS) - 1)
BATCH_DOCS, BATCH_WORDS = 2048, 1_000_000
COUNTED = 1 << 15  # mark of a document that the model has counted, beside its number in the batch
CACHE_CHUNKS = 100_000
SAMPLE = 2000
BROADCAST_LABELS = 5_000_000
LOW, HIGH, MARGIN = 0.01, 0.98, 0.25
HELD_OUT = 5
LEAST_HELD = 30


def normal(chunk: str) -> str:
    if len(chunk) > 1 and chunk[-1] in ".,;:!?":
        chunk = chunk[:-1]
    return chunk.lower() if len(chunk) == 1 or chunk[1:].islower() else chunk


class Words:
    """From chunk to word number or hash, remembering what was worked out. The vocabulary: hashes of the words with numbers, sorted, and their numbers."""

    def __init__(self, vocabulary: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.numbers = vocabulary
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known, chunks = self.known, (text or "").split()
        try:
            return np.array([known[c] for c in chunks], dtype=np.uint64)
        except KeyError:
            new = [c for c in set(chunks) if c not in known]
            h = np.array([xxhash.xxh64_intdigest(normal(c)) for c in new], dtype=np.uint64)
            found = h | _top
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = np.where(self.hashes[at] == h, self.numbers[at], found)
            known.update(zip(new, found.tolist(), strict=True))
            return np.array([known[c] for c in chunks], dtype=np.uint64)


def shard_of(keys: np.ndarray, bounds: np.ndarray, shards: int) -> np.ndarray:
    """By ranges of keys: a shard's keys are near each other and their differences short. Hashes are spread evenly, pairs of numbers by `bounds`."""
    return np.where(keys < _top, np.searchsorted(bounds, keys, "right"), (((keys & _hash) * np.uint64(shards)) >> np.uint64(HASH_BITS)).astype(np.int64))


def bigrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories and words."""
    return np.concatenate([np.array([START], np.uint64), ids[:-1]]), ids


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """v * HEAD + w if both are numbers, else a hash of HASH_BITS with the top bit set."""
    return np.where((v | w) < _top, (v << np.uint64(BITS)) | w, (stir(v * _mix + w) & _hash) | _top)


def history_keys(v: np.ndarray) -> np.ndarray:
    """Of hashed words as histories alone."""
    return (stir(v ^ _mix) & _hash) | _top


def word_keys(w: np.ndarray) -> np.ndarray:
    """Of hashed words as words and, since all words but a text's last are histories too, as histories."""
    return (w & _hash) | _top


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    if not len(x):
        return b""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(x: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    plain = np.frombuffer(pa.decompress(x, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(plain.reshape(size, n).T).reshape(-1).view(kind)


def ascending(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return squeezed(np.diff(x, prepend=x.dtype.type(0)))


def unascending(x: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(x, n, np.uint64), dtype=np.uint64)


def pair_rows(pairs: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Histories in order, their words, counts."""
    return ascending(np.ascontiguousarray(pairs[0])), squeezed(np.ascontiguousarray(pairs[1])), squeezed(counts)


def unpaired(a: bytes, b: bytes, n: int) -> np.ndarray:
    return np.stack([unascending(a, n), unsqueezed(b, n, np.uint64)])


def summed_pairs(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order with their counts."""
    order = np.lexsort(pairs[::-1])
    pairs = pairs[:, order]
    new = np.flatnonzero(np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, np.int64)
    weights = np.ones(len(order), np.int64) if counts is None else counts[order]
    return np.ascontiguousarray(pairs[:, new]), np.add.reduceat(weights, new) if len(new) else weights


def _split(keys: np.ndarray, bounds: np.ndarray, shards: int):
    """The order that puts keys by shard, keeping ties in place, and where each shard begins."""
    shard = shard_of(keys, bounds, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


class Model:
    """What is kept besides the counts: arrays over the head, all of bounded size. `floor` is the log-probability of a word never seen."""

    def __init__(self, vocabulary: Broadcast, bounds: np.ndarray, discounts: np.ndarray, total: np.ndarray, log_rest: np.ndarray, log_low: np.ndarray, floor: float, shards: int):
        self.vocabulary, self.bounds, self.discounts, self.total, self.log_rest, self.log_low, self.floor, self.shards = vocabulary, bounds, discounts, total, log_rest, log_low, floor, shards

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vocabulary": None}  # workers have it already

    def gains(self, counts: np.ndarray, total: np.ndarray, log_rest: np.ndarray, log_low: np.ndarray) -> np.ndarray:
        """log p(w | v) of known bigrams less what the lower order alone gives."""
        low = log_rest + log_low
        return np.log((counts - self.discounts[np.minimum(counts, 3)]) / total + np.exp(low)) - low

    def corrections(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The gains of bigrams of two numbers."""
        v, w = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64(HEAD - 1)).astype(np.int64)
        return self.gains(counts, self.total[v], self.log_rest[v], self.log_low[w])


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of bigrams seen 1 to 4 times."""
    n = np.asarray(n, float)
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return np.array([0, *[float(np.clip(x, 0.05, k + 0.95)) for k, x in enumerate(d)]])


def _vocabulary(trusted: DataFrame, head: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The words that have a number (see Words), and the number of distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            merged: Counter = Counter()
            for chunk, n in found.items():
                merged[normal(chunk)] += n
            return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update((text or "").split())
                if len(found) > 500_000:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    counts = stored(trusted.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # The head by classes of counts, so that no task has to sort all words: as many whole classes as there are numbers for.
    of = F.floor(F.log2("n") * 64).cast("int")
    sizes = counts.groupBy(of.alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect()
    least, known = None, 0
    for row in sizes:
        known += row.words
        if known > head - FIRST:
            break
        least = row.k
    table = counts.where(of >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    words = sorted(zip(table.column("n").to_pylist(), table.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    dropped(counts)
    hashes = np.array([xxhash.xxh64_intdigest(word) for _, word in words], dtype=np.uint64)
    order = np.argsort(hashes)
    return (hashes[order], (order + FIRST).astype(np.uint64)), sum(row.words for row in sizes)


def _bounds(trusted: DataFrame, vocabulary: Broadcast, key: str, shards: int) -> np.ndarray:
    """What divides pairs of numbers into shards: quantiles of those in a sample of about SAMPLE documents. They balance the work; results don't depend on them."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(key, lambda: Words(vocabulary.value))
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                v, w = bigrams(words.of(text))
                found.append(pair_keys(v[: len(w)], w))
            keys = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keys < _top][:: 8].astype(np.int64))], names=["key"])

    share = min(1.0, SAMPLE / max(1, trusted.count()))
    picked = trusted.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    keys = np.sort(picked.select("text").mapInArrow(pairs, "key long").toArrow().column("key").to_numpy())
    return keys[np.arange(1, shards) * len(keys) // shards].astype(np.uint64) if len(keys) else np.zeros(shards - 1, np.uint64)


PACKED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PACKED_SQL = "shard int, kind int, batch long, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PACKED.types)], schema=PACKED)


def _count(trusted: DataFrame, vocabulary: Broadcast, key: str, bounds: np.ndarray, shards: int) -> DataFrame:
    """Packed rows for each shard, stored: kind 0 (a: bigrams of numbers, c: counts), kind 1 (a: histories of others, b: words, c: counts); `batch` is how many."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plain, others, size = worker_cache(key, lambda: Words(vocabulary.value)), [], [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(plain), return_counts=True)
            order, at = _split(keys, bounds, shards)
            keys, n = keys[order], n[order].astype(np.int64)
            some = [(s, at[s], at[s + 1]) for s in range(shards) if at[s] < at[s + 1]]
            rows = [(s, 0, int(hi - lo), ascending(keys[lo:hi]), None, squeezed(n[lo:hi])) for s, lo, hi in some]
            pairs, n = summed_pairs(np.concatenate(others, axis=1))
            order, at = _split(pair_keys(*pairs), bounds, shards)
            pairs, n = pairs[:, order], n[order]
            some = [(s, at[s], at[s + 1]) for s in range(shards) if at[s] < at[s + 1]]
            return _rows(rows + [(s, 1, int(hi - lo), *pair_rows(pairs[:, lo:hi], n[lo:hi])) for s, lo, hi in some])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = words.of(text)
                if len(ids):
                    v, w = bigrams(ids)
                    numbers = (v | w) < _top
                    plain.append(pair_keys(v[numbers], w[numbers]))
                    others.append(np.stack([v[~numbers], w[~numbers]]))
                    size += len(ids)
                    if size > 2 * BATCH_WORDS:
                        yield flush()
                        plain, others, size = [], [], 0
        if plain:
            yield flush()
        del plain, others
        give_back()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def summed():
            n = np.concatenate([p[1] for p in parts])
            if now[1]:
                return summed_pairs(np.concatenate([p[0] for p in parts], axis=1), n)
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, n).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = summed()
            return _rows([(*now, len(n), *(pair_rows(keys, n) if now[1] else (ascending(keys), None, squeezed(n))))])

        for batch in batches:
            for s, kind, many, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (s, kind) != now and parts:
                    yield out()
                    parts, size = [], 0
                now = s, kind
                parts.append((unpaired(a, b, many) if kind else unascending(a, many), unsqueezed(c, many, np.int64)))
                size += many
                if size > 8_000_000 and len(parts) > 1:
                    parts = [summed()]
                    size = len(parts[0][1])
        if parts:
            yield out()

    packed = trusted.select("text").mapInArrow(local, PACKED_SQL)
    return stored(packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(merged, PACKED_SQL), "bigrams")


def _statistics(counts: DataFrame, vocabulary: Broadcast, bounds: np.ndarray, kinds: int, shards: int) -> tuple[Model, DataFrame]:
    """The model, and (id, total, log_rest, log_low, seen) of each hashed word."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((HEAD, 5), np.int64)  # as history: total, kinds seen once, twice, more often; as word: kinds of histories
        n = np.zeros(4, np.int64)

        def cells(ids: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(5)]], names=["id", *"abcde"])

        def add(table: np.ndarray, v: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
            table[:, 0] += np.bincount(v, c, len(table)).astype(np.int64)
            for k in (1, 2, 3):
                table[:, k] += np.bincount(v[(c == k) if k < 3 else (c >= 3)], minlength=len(table))
            table[:, 4] += np.bincount(w, minlength=len(table))

        for batch in batches:
            for kind, many, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                c = unsqueezed(c, many, np.int64)
                n += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
                if not kind:
                    keys = unascending(a, many).astype(np.int64)
                    add(table, keys >> BITS, c, keys & (HEAD - 1))
                    continue
                v, w = unpaired(a, b, many)
                add(table, v[v < _top].astype(np.int64), c[v < _top], w[w < _top].astype(np.int64))
                ids = np.unique(np.concatenate([v[v >= _top], w[w >= _top]]))
                own = np.zeros((len(ids), 5), np.int64)
                add(own, np.searchsorted(ids, v[v >= _top]), c[v >= _top], np.searchsorted(ids, w[w >= _top]))
                yield cells(ids.view(np.int64), own)
        some = np.flatnonzero(table.any(axis=1))
        yield cells(np.append(some, HEAD + np.arange(4)), np.vstack([table[some], np.column_stack([n, np.zeros((4, 4), np.int64)])]))

    found = stored(counts.mapInArrow(sums, "id long, a long, b long, c long, d long, e long").groupBy("id").agg(*[F.sum(x).alias(x) for x in "abcde"]), "word-statistics")
    got = found.where("id >= 0").toArrow().to_pandas()  # bounded by the head; hashes are below zero
    table, n = np.zeros((HEAD, 5), np.int64), np.zeros(4)
    words = got[got.id < HEAD]
    table[words.id] = words[list("abcde")]
    rest = got[got.id >= HEAD]
    n[rest.id - HEAD] = rest.a
    d = discounts(n)
    # The lower order: in how many contexts a word was seen, itself discounted and interpolated with the uniform distribution.
    contexts = {r.k: (r.times, r.whole) for r in found.where(f"id < {HEAD} and e > 0").groupBy(F.least("e", F.lit(5)).alias("k")).agg(F.count("*").alias("times"), F.sum("e").alias("whole")).collect()}
    e = discounts(np.array([contexts.get(k, (0, 0))[0] for k in (1, 2, 3, 4)]))
    whole = sum(x for _, x in contexts.values())
    floor = sum(e[min(k, 3)] * times for k, (times, _) in contexts.items()) / max(1, whole) / (kinds + FIRST)

    def worked_out(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total, seen = table[:, 0], table[:, 4]
        left = table[:, 1] * d[1] + table[:, 2] * d[2] + table[:, 3] * d[3]
        with np.errstate(divide="ignore", invalid="ignore"):
            log_rest = np.where(total > 0, np.log(left / np.maximum(total, 1)), 0.0)
        return np.maximum(total, 1), log_rest, np.log(np.maximum((seen - e[np.minimum(seen, 3)]) / max(1, whole) + floor, 1e-15))

    def of_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, log_rest, log_low = worked_out(np.column_stack([batch.column(k).to_numpy() for k in range(1, 6)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(log_rest), pa.array(log_low), batch.column(5)], names=["id", "total", "log_rest", "log_low", "seen"])

    hashed = found.where("id < 0").mapInArrow(of_hashed, "id long, total long, log_rest double, log_low double, seen long")
    hashed = stored(hashed, "hashed-words")
    dropped(found)
    return Model(vocabulary, bounds, d, *worked_out(table), float(np.log(max(floor, 1e-15))), shards), hashed


def _gains(counts: DataFrame, hashed: DataFrame, model: Model) -> DataFrame:
    """Packed rows (a: keys, b: gains, c: counts) of kind 1: of hashed words, as words and as histories, and of bigrams with any."""
    held = counts.sparkSession.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for many, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                v, w = unpaired(a, b, many).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(unsqueezed(c, many, np.int64))], names=["v", "w", "n"])

    def packed(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts, size, shards = [], 0, held.value.shards

        def flush() -> pa.RecordBatch:
            keys, gains, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            keys, gains, counts = keys[order], gains[order].astype(np.float32), counts[order]
            order, at = _split(keys, held.value.bounds, shards)
            keys, gains, counts = keys[order], gains[order], counts[order]
            some = [(s, at[s], at[s + 1]) for s in range(shards) if at[s] < at[s + 1]]
            return _rows([(s, 1, int(hi - lo), ascending(keys[lo:hi]), squeezed(gains[lo:hi]), squeezed(counts[lo:hi])) for s, lo, hi in some])

        for part in batches:
            parts.append(part)
            size += len(part[0])
            if size > BATCH_WORDS:
                yield flush()
                parts, size = [], 0
        if size:
            yield flush()

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value

        def known():
            for batch in batches:
                v, w, n = (batch.column(k).to_numpy() for k in range(3))
                total, log_rest, log_low = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))  # null, so nan, for numbers
                a, b = np.maximum(v, 0), np.maximum(w, 0)
                total, log_rest, log_low = np.where(v < 0, total, model.total[a]), np.where(v < 0, log_rest, model.log_rest[a]), np.where(w < 0, log_low, model.log_low[b])
                yield pair_keys(v.view(np.uint64), w.view(np.uint64)), model.gains(n, total, log_rest, log_low), n

        return packed(known())

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known():
            for batch in batches:
                ids, total, log_rest, log_low, seen = (batch.column(k).to_numpy() for k in range(5))
                ids = ids.view(np.uint64)
                yield np.concatenate([word_keys(ids), history_keys(ids)]), np.concatenate([log_low - held.value.floor + log_rest, log_rest]), np.concatenate([seen, total])

        return packed(known())

    rows = stored(counts.where("kind = 1").mapInArrow(pairs, "v long, w long, n long"), "pairs")  # so that no task needs two Python workers
    before, after = hashed.select(F.col("id").alias("v"), "total", "log_rest"), hashed.select(F.col("id").alias("w"), "log_low")
    none = F.lit(None).cast("double")
    # Numbers are never joined on: only words outside the head are, and none of them is frequent.
    first = rows.where("v < 0").join(before, "v").select("v", "w", "n", F.col("total").cast("double"), "log_rest")
    rest = rows.where("v >= 0").select("v", "w", "n", none.alias("total"), none.alias("log_rest"))
    joined = first.where("w >= 0").withColumn("log_low", none).unionByName(first.where("w < 0").unionByName(rest).join(after, "w"))
    return stored(joined.select("v", "w", "n", "total", "log_rest", "log_low").mapInArrow(of_pairs, PACKED_SQL).unionByName(hashed.mapInArrow(of_words, PACKED_SQL)), "gains")


def train(trusted: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame] | None:
    """The model and its counts from the texts of `trusted`; None without any word."""
    spark = trusted.sparkSession
    shards, key = shuffle_partitions(spark), uuid.uuid4().hex
    words, kinds = _vocabulary(trusted, head)
    if not kinds:
        return None
    vocabulary = spark.sparkContext.broadcast(words)
    bounds = _bounds(trusted, vocabulary, key, shards)
    counts = _count(trusted, vocabulary, key, bounds, shards)
    model, hashed = _statistics(counts, vocabulary, bounds, kinds, shards)
    gains = _gains(counts, hashed, model)
    dropped(hashed)
    return model, counts.where("kind = 0").unionByName(gains)


def perplexity(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """From (doc_id, text, lang, trusted): doc_id, text_hash, lang, trusted, n_words, log_perplexity.

    Where `counted` is there and true, the model knows the document: its own occurrences are taken off what it meets.
    """
    spark = docs.sparkSession
    held, vocabulary, name = spark.sparkContext.broadcast(model), model.vocabulary, uuid.uuid4().hex
    counted = F.col("counted") if "counted" in docs.columns else F.lit(False)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "trusted", counted.alias("counted"), "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, part = held.value, worker_cache(name, lambda: Words(vocabulary.value)), TaskContext.get().partitionId()
        docs, keys, of, times, marks, done, size = [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            number = (part << 32) + done
            key, doc, n = np.concatenate(keys), np.repeat((np.arange(len(docs)) + COUNTED * np.array(marks)).astype(np.uint16), of), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            order = order[_split(key[order], model.bounds, model.shards)[0]]
            key, doc, n = key[order], doc[order], n[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            one, many = key[new], np.diff(np.append(new, len(key))).astype(np.uint16)
            at = np.searchsorted(shard_of(one, model.bounds, model.shards), np.arange(model.shards + 1))
            to = np.append(new, len(key))[at]
            table = pa.Table.from_pylist(docs, schema=DOCS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DOCS) as out:
                out.write_table(table)
            rows = [(done % model.shards, 3, number, sink.getvalue().to_pybytes(), None, None)]
            for s in range(model.shards):
                lo, hi = at[s], at[s + 1]
                if lo < hi:
                    # Sorted keys, those of numbers first, as differences.
                    x, y = one[lo:hi], slice(to[s], to[s + 1])
                    low = int(np.searchsorted(x, _top))
                    a = np.array([low, hi - lo - low, to[s + 1] - to[s]], np.int32).tobytes()
                    small, large = ascending(x[:low]), ascending(x[low:])
                    rows.append((s, 2, number, a + np.int32(len(small)).tobytes() + small + large, squeezed(many[lo:hi]), np.int32(len(z := squeezed(doc[y]))).tobytes() + z + squeezed(n[y])))
            return _rows(rows)

        for batch in batches:
            for doc_id, text_hash, lang, trusted, counted, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = words.of(text)
                row = {"doc_id": doc_id, "text_hash": text_hash, "lang": lang, "trusted": trusted, "n": len(ids), "base": 0.0}
                if len(ids):
                    v, w = bigrams(ids)
                    hashed = w[w >= _top]
                    row["base"] = float(model.log_rest[v[v < _top].astype(np.int64)].sum() + model.log_low[w[w < _top].astype(np.int64)].sum() + model.floor * len(hashed))
                    some, count = np.unique(np.concatenate([pair_keys(v, w), word_keys(hashed)]), return_counts=True)
                    if w[-1] >= _top:  # it is no history
                        last = int(history_keys(w[-1:])[0])
                        at = int(np.searchsorted(some, np.uint64(last)))
                        some, count = np.insert(some, at, np.uint64(last)), np.insert(count, at, -1)
                else:
                    some, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                docs.append(row)
                marks.append(bool(counted))
                keys.append(some)
                of.append(len(some))
                times.append(count.astype(np.int32))
                size += len(ids)
                if len(docs) == BATCH_DOCS or size > BATCH_WORDS:
                    yield flush()
                    docs, keys, of, times, marks, done, size = [], [], [], [], [], done + 1, 0
        if docs:
            yield flush()
        del docs, keys, of, times, marks
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard, known, gain, seen, more = held.value, None, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), []
        for batch in batches:
            for i in range(batch.num_rows):
                s, kind, number, a, b, c = (batch.column(k)[i].as_py() for k in range(6))
                if s != shard:
                    shard, known, gain, seen, more = s, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), []
                if kind == 0:
                    known, seen = unascending(a, number), unsqueezed(c, number, np.int64)
                    gain = model.corrections(known, seen)
                elif kind == 1:
                    more.append((unascending(a, number), unsqueezed(b, number, np.float32), unsqueezed(c, number, np.int64)))
                elif kind == 3:
                    yield _rows([(0, 2, number, a, None, None)])
                else:
                    if more:
                        keys, gains, counts = (np.concatenate(x) for x in zip(*more, strict=True))
                        order = np.argsort(keys)
                        known, gain, seen, more = np.append(known, keys[order]), np.append(gain, gains[order]), np.append(seen, counts[order]), []
                    if not len(known):
                        continue
                    low, high, pairs, size = np.frombuffer(a, np.int32, 4).tolist()
                    keys = np.append(unascending(a[16 : 16 + size], low), unascending(a[16 + size :], high))
                    size = int(np.frombuffer(c, np.int32, 1)[0])
                    many, doc, n = unsqueezed(b, low + high, np.uint16), unsqueezed(c[4 : 4 + size], pairs, np.uint16), unsqueezed(c[4 + size :], pairs, np.int32)
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    own = np.repeat(np.where(known[at] == keys, gain[at], 0.0), many)
                    if (mine := np.flatnonzero((doc >= COUNTED) & (own != 0))).size:
                        # Without the document's own occurrences; where others are left, those of hashed words keep their gains.
                        of = np.repeat(at, many)[mine]
                        left = seen[of] - n[mine]
                        own[mine[left <= 0]] = 0.0
                        some = (left > 0) & (known[of] < _top)
                        own[mine[some]] = model.corrections(known[of[some]], left[some])
                    doc = doc & np.uint16(COUNTED - 1)
                    sums = np.bincount(doc, own * n, BATCH_DOCS)
                    some = np.flatnonzero(sums).astype(np.uint16)
                    if len(some):
                        yield _rows([(0, 1, number, some.tobytes(), sums[some].astype(np.float32).tobytes(), None)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums, table = None, np.zeros(BATCH_DOCS), None

        def out() -> pa.RecordBatch:
            n = table.column("n").to_numpy()
            total = table.column("base").to_numpy() + sums[: len(n)]
            with np.errstate(invalid="ignore", divide="ignore"):
                logs = pa.array(-total / n, pa.float64(), mask=n == 0)
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "text_hash", "lang", "trusted", "n")]
            return pa.RecordBatch.from_arrays([*columns, logs], names=["doc_id", "text_hash", "lang", "trusted", "n_words", "log_perplexity"])

        for batch in batches:
            for kind, this, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if this != number:
                    if table is not None:
                        yield out()
                    number, sums, table = this, np.zeros(BATCH_DOCS), None
                if kind == 2:
                    table = pa.ipc.open_stream(a).read_all()
                else:
                    sums[np.frombuffer(a, np.uint16)] += np.frombuffer(b, np.float32)
        if table is not None:
            yield out()

    parts = shuffle_partitions(spark)
    sent = docs.mapInArrow(send, PACKED_SQL).unionByName(counts)
    met = sent.repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(meet, PACKED_SQL)
    return met.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(add, "doc_id long, text_hash long, lang string, trusted boolean, n_words long, log_perplexity double")


DOCS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n", pa.int64()), ("base", pa.float64())])


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang) with trusted: some label of the document says quality 1 and none says 0.

    Labels go to every task up to BROADCAST_LABELS of them (8 bytes each and as much again); beyond that both sides are shuffled.
    """
    good = only(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("trusted"))
    good = stored(good, "trusted")
    if good.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each distinct (doc_id, text): doc_id, text_hash, lang, trusted, n_words, perplexity, low, high, kept."""
    docs = with_trust(only(docs, doc_id="long", text="string", lang="string"), labels)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    trained = train(docs.where("trusted").where(~held_out))
    if trained is None:
        plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "trusted", F.lit(None).cast("long").alias("n_words"))
        return plain.withColumns({c: F.lit(None).cast("double") for c in ("perplexity", "low", "high")}).withColumn("kept", F.lit(True)).dropDuplicates(["doc_id", "text_hash"])
    docs = docs.withColumn("counted", F.col("trusted") & ~F.coalesce(held_out, F.lit(False)))
    scored = stored(perplexity(docs, *trained), "perplexity").dropDuplicates(["doc_id", "text_hash"])
    shares = [LOW, 0.5, HIGH]
    known = scored.where("trusted and log_perplexity is not null").where(held_out)
    cuts = known.groupBy("lang").agg(F.percentile_approx("log_perplexity", shares, F.lit(10_000)).alias("q"), F.count("*").alias("held")).withColumnRenamed("lang", "_cut")
    every = known.agg(F.percentile_approx("log_perplexity", shares, F.lit(10_000)).alias("every"), F.count("*").alias("all_held"))
    usual = scored.where("log_perplexity is not null").groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("log_perplexity", 0.5, F.lit(10_000)).alias("usual"), F.max("trusted").alias("some"))
    # A row for each language.
    q, every_q, held = F.col("q"), F.col("every"), F.coalesce("held", F.lit(0))
    lower, upper = (lambda x: x[0] - MARGIN * (x[1] - x[0])), (lambda x: x[2] + MARGIN * (x[2] - x[1]))
    wide = (1 + MARGIN) * (1 + 1 / F.sqrt(F.greatest(held, F.lit(1))))
    usual_of = F.when(F.col("some"), F.col("usual"))
    down, up = wide * (every_q[1] - every_q[0]), wide * (every_q[2] - every_q[1])
    few = F.when(F.col("all_held") >= LEAST_HELD, F.struct(F.least(lower(every_q), lower(q), q[1] - down, usual_of - down).alias("low"), F.greatest(upper(every_q), upper(q), q[1] + up, usual_of + up).alias("high")))
    limits = F.when(held >= LEAST_HELD, F.struct(lower(q).alias("low"), upper(q).alias("high"))).otherwise(few)
    bounds = usual.join(F.broadcast(cuts), F.col("_lang").eqNullSafe(F.col("_cut")), "left").join(F.broadcast(every), F.lit(True), "left").select("_lang", F.exp(limits["low"]).alias("low"), F.exp(limits["high"]).alias("high"))
    bounded = scored.join(F.broadcast(bounds), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return bounded.select("doc_id", "text_hash", "lang", "trusted", "n_words", F.exp("log_perplexity").alias("perplexity"), "low", "high").withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents outside their language's bounds go."""
    gone = judge(spark, docs, read_table(spark, sf_dir, "labels")).where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
