"""Near-duplicate documents by an exact multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct shingles of k words, hashed to 64 bits. Its signature has CHUNKS * SLOTS
minima, each cut to 32 bits; the distance of two signatures is the number of slots that differ.
By the pigeonhole principle, two signatures with at most 2 * CHUNKS - 1 different slots have
a chunk in which at most one differs. So each chunk is filed under SLOTS keys, one for each slot that
may be wrong, and every pair within that distance meets under some key: the join misses none of them.
CHUNKS follows from the similarity, so that a pair just at the threshold is within the distance but for MISS.

Documents with equal sets are one class before anything else. Buckets (the classes under one key) are
never expanded into pairs, and candidates are never closed over: only verified links join components.

1. each class is compared with the least head of its buckets (a head is the least class of a
   bucket): sizes, then signatures, then full sets. A class has one such link at most, to a lesser class, so components are trees
   and pointer jumping finds their roots.
2. buckets with the same head are one group from here on: all of it met the head, and a class heads at most CHUNKS * SLOTS
   buckets. Most groups are one component by now. The members of the others are still to be compared
   across components: they are dealt to blocks, a task takes two blocks of a group, compares signatures as arrays and returns
   a forest, the closest pairs that would join all that is close. Those are verified, and components joined.
3. what is still close across components within a group, as its own closest pairs failed, is compared by full sets in the same blocks,
   where a task returns links, not candidates.

So each pair that meets in a bucket is in one component or was compared. The comparison of signatures uses
WIDE slots of 8 bits, whose distance bound loses a pair at the threshold with probability below MISS. A hot group is many blocks of at most
about BLOCK classes and BLOCK_WORDS shingles, never one group.

Defined cases: a null text or one without words has an empty set, no link, and is its own component;
with fewer than k words the whole sequence is the one shingle; a very long text is one set as any other, in a block of its own;
a null doc_id takes part and is never a component's id unless alone (then null, and `kept` is true); repeated doc_ids are separate rows;
ties don't arise, as a component goes by its least doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import give_back, only, read_table, stored, worker_cache

SLOTS, MISS = 5, 1e-5
WIDE, SIGMAS = 256, 4.75
BLOCK, BLOCK_WORDS = 512, 1_000_000
SALTS = 32
REAL_IDS = 1 << 62  # doc_ids from here on are not used as class numbers
CACHE_WORDS = 100_000
_mix = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is exactly 20 and 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    hashes = worker_cache("word hashes", _Hashes)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    span = min(k, len(h))
    out = np.zeros(len(h) - span + 1, np.uint64)
    for i in range(span):
        out = stir(out * _mix + h[i : len(h) - span + 1 + i])
    return np.unique(out)


def chunks_for(similarity: float) -> int:
    """So many chunks that a pair at the threshold has all of them wrong twice with a probability of at most MISS."""
    wrong = 1 - similarity**SLOTS - SLOTS * similarity ** (SLOTS - 1) * (1 - similarity)
    return int(np.ceil(np.log(MISS) / np.log(wrong)))


def slot_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row for each set, a column for each slot; sets are not empty."""
    x, y = slot_seeds(n)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((flat ^ x[i]) * y[i], at) >> np.uint64(32)
    return out


def bucket_keys(signature: np.ndarray, chunks: int) -> np.ndarray:
    """For each row, the chunks * SLOTS keys: a chunk with one slot left out."""
    s = signature.reshape(len(signature), chunks, SLOTS).astype(np.uint64)
    out = np.empty((len(signature), chunks, SLOTS), np.uint64)
    number = np.arange(chunks, dtype=np.uint64)
    for left_out in range(SLOTS):
        key = np.full(s.shape[:2], left_out + 1, np.uint64) + (number << np.uint64(8))
        for i in range(SLOTS):
            if i != left_out:
                key = stir(key * _mix + s[:, :, i])
        out[:, :, left_out] = key
    return out.reshape(len(signature), -1)


def _file(docs: DataFrame, k: int, slots: int) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes, none if the set is empty), signature (slots of 32 bits), wide (WIDE slots of 8)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, k) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(signatures(full, WIDE) if full else [])
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                marks = [next(found) if len(s) else None for s in sets]
                short = [None if m is None else m[:slots].tobytes() for m in marks]
                wide = [None if m is None else m.astype(np.uint8).tobytes() for m in marks]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(map(len, sets)), pa.int64()), *[pa.array(x, pa.binary()) for x in (names, short, wide)]], names=["doc_id", "text_hash", "n_shingles", "set_id", "signature", "wide"])
        give_back()

    return docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")).mapInArrow(rows, "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary, wide binary")


def most_apart(similarity: float) -> int:
    """The distance of WIDE slots that a pair at the threshold hardly ever exceeds."""
    p = (1 - similarity) * 255 / 256
    return int(np.ceil(WIDE * p + SIGMAS * np.sqrt(WIDE * p * (1 - p))))


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of (a, b): c is the least vertex reachable. Minimum labels, then the label's label, until nothing changes."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("n")), "b").groupBy(F.col("a").alias("v")).agg(F.min("n").alias("n"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        step = stored(lower.join(jump, "c").select("v", "old", F.least("c", "j").alias("c")), "labels")
        labels = step.select("v", "c")
        if step.where("c < old").isEmpty():
            return labels


def _close(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures are within the distance."""
    left = marks.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    right = marks.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    most = most_apart(similarity)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDE) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= most))

    joined = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    return joined.select("a", "b", "wa", "wb").mapInArrow(near, "a long, b long")


def trees(parents: DataFrame) -> DataFrame:
    """(v, c) from (a, b), a < b, each b once: c is the root above v. Pointer jumping until no root moves."""
    labels = stored(parents.select(F.col("b").alias("v"), F.col("a").alias("c")), "labels")
    while True:
        above = labels.select(F.col("v").alias("c"), F.col("c").alias("higher"))
        step = stored(labels.join(above, "c", "left").select("v", F.coalesce("higher", "c").alias("c"), F.col("higher").isNotNull().alias("moved")), "labels")
        labels = step.select("v", "c")
        if step.where("moved").isEmpty():
            return labels


def _deal(members: DataFrame) -> DataFrame:
    """Members (head, c, sid, n, tried, ...) of groups with several components, dealt to blocks, each pair of blocks (i, j) of a group with both.

    A hot group meets its size in SALTS parts.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
    per = salted.groupBy("head", "salt").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("rows"), F.sum("n").alias("words"), F.count_if("tried").alias("tried"))
    whole = per.groupBy("head").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), *[F.sum(x).alias(x) for x in ("rows", "words", "tried")])
    # The head itself is not `tried`: with one other that is, nothing is left to compare.
    whole = whole.where("c0 < c1").where("rows > 2 or tried = 0")
    blocks = whole.select("head", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    sizes = per.select("head", "salt").join(blocks, "head")
    mine = salted.join(sizes, ["head", "salt"]).withColumn("mine", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return mine.select("*", other).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "blocks", "salt")


def _by_group(dealt: DataFrame, of, schema: str) -> DataFrame:
    """`of` yields what each group gives: it gets the columns as arrays, the wide signatures as a matrix, the texts if there are any. Groups are runs of sorted rows, many to a batch."""
    with_texts = "text" in dealt.columns
    names = ["head", "i", "j", "mine", "c", "sid", "n", "tried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def groups(table: pa.Table, last: bool):
            nonlocal held
            at = {x: table.column(x).to_numpy() for x in names}
            new = np.flatnonzero((np.diff(at["head"]) != 0) | (np.diff(at["i"]) != 0) | (np.diff(at["j"]) != 0)) + 1
            ends = [0, *new.tolist(), *[table.num_rows] * last]
            wide = np.frombuffer(b"".join(table.column("wide").slice(0, ends[-1]).to_pylist()), np.uint8).reshape(-1, WIDE)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                texts = table.column("text").slice(lo, hi - lo) if with_texts else None
                yield {x: v[lo:hi] for x, v in at.items()}, wide[lo:hi], texts
            held = None if last else table.slice(ends[-1])

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                found = [x for group in groups(now if held is None else pa.concat_tables([held, now]), False) for x in of(*group)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=out)
        if held is not None:
            found = [x for group in groups(held, True) for x in of(*group)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=out)

    out = [x.split()[0] for x in schema.split(", ")]
    columns = [*names, "wide", *["text"] * with_texts]
    return dealt.select(*columns).repartition("head", "i", "j").sortWithinPartitions("head", "i", "j").mapInArrow(run, schema)


def _close_rows(at: dict[str, np.ndarray], wide: np.ndarray, similarity: float, label: np.ndarray):
    """For each row of the first block, the rows of the second in other components (by `label` as it is then) that are close by size and signature, and their distances. The head has been compared with those marked as tried."""
    most, i, j = most_apart(similarity), at["i"][0], at["j"][0]
    side, sid, n, tried, head = at["mine"], at["sid"], at["n"], at["tried"], at["head"][0]
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for x in left:
        may = (label[right] != label[x]) & (np.minimum(n[right], n[x]) >= similarity * np.maximum(n[right], n[x]))
        if i == j:
            may &= sid[right] > sid[x]
        if sid[x] == head:
            may &= ~tried[right]
        elif tried[x]:
            may &= sid[right] != head
        near = right[may]
        if len(near):
            apart = (wide[near] != wide[x]).sum(axis=1)
            if (apart <= most).any():
                yield x, near[apart <= most], apart[apart <= most]


def _forest(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ca, cb): close pairs, and their components, that would join all that is close within each group."""

    def of(at, wide, _):
        label = at["c"].copy()
        for x, near, apart in _close_rows(at, wide, similarity, label):
            for y in near[np.argsort(apart, kind="stable")].tolist():
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    yield min(at["sid"][x], at["sid"][y]), max(at["sid"][x], at["sid"][y]), at["c"][x], at["c"][y]

    return _by_group(dealt, of, "a long, b long, ca long, cb long")


def _involved(dealt: DataFrame, similarity: float) -> DataFrame:
    """The sids that have anyone in another component to be compared with."""

    def of(at, wide, _):
        hit = np.zeros(len(wide), bool)
        for x, near, _ in _close_rows(at, wide, similarity, at["c"]):
            hit[x] = hit[near] = True
        for x in at["sid"][hit].tolist():
            yield (x,)

    return _by_group(dealt, of, "sid long").distinct()


def _joined(dealt: DataFrame, similarity: float, k: int, percent: int) -> DataFrame:
    """Components (a, b) that full sets join, enough of them in each group to join all that is linked there."""

    def of(at, wide, texts):
        label, sets = at["c"].copy(), {}

        def shingles(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(texts[x].as_py(), k)
            return sets[x]

        for x, near, _ in _close_rows(at, wide, similarity, label):
            for y in near.tolist():
                if label[x] != label[y]:
                    p, q = shingles(x), shingles(y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        yield at["c"][x], at["c"][y]
                        label[label == label[y]] = label[x]

    return _by_group(dealt, of, "a long, b long")


def _relabelled(frame: DataFrame, merged: DataFrame) -> DataFrame:
    """`frame` with c as (v, c) of `merged` has it."""
    names = frame.columns
    return frame.join(merged.select(F.col("v").alias("c"), F.col("c").alias("now")), "c", "left").withColumn("c", F.coalesce("now", "c")).select(*names)


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = []
            for a, b, ta, tb in rows:
                if a not in kept:
                    if sum(map(len, kept.values())) > 4_000_000:
                        kept.clear()
                    kept[a] = shingle_set(ta, k)
                x, y = kept[a], shingle_set(tb, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _texts(docs: DataFrame, marks: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, text) of some classes: one text each, found by the class's least doc_id and its text's hash."""
    named = marks.join(sids.distinct(), "sid").select("sid", F.col("text_hash").alias("_hash"), F.col("least").alias("_doc"))
    rows = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    return rows.join(named, rows.doc_id.eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("sid", "text").dropDuplicates(["sid"])


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """From (doc_id, text): doc_id, text_hash, n_shingles, set_id, component (null for empty sets, else of classes), component_id (its least doc_id), a row for each row."""
    docs = only(docs, doc_id="long", text="string")
    similarity = percent / 100
    chunks = chunks_for(similarity)
    filed = stored(_file(docs, k, chunks * SLOTS), "signatures")
    classes = filed.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("wide").alias("wide"))
    # A class goes by its least doc_id. Null ids, those from REAL_IDS on, and ids repeated with other texts, go by numbers above all others.
    own = F.lit(REAL_IDS) + F.pmod(F.xxhash64("set_id"), F.lit(1 << 61))
    marks = stored(classes.select("set_id", "n", "signature", "wide", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"), own.alias("own")), "classes")
    plain = F.when(F.col("least") < REAL_IDS, F.col("least"))
    twice = marks.where("least is not null").groupBy("least").agg(F.count("*").alias("times")).where("times > 1")
    if twice.isEmpty():
        marks = marks.withColumn("sid", F.coalesce(plain, "own"))
    else:
        marks = stored(marks.join(twice, "least", "left").withColumn("sid", F.when(F.col("times").isNull(), F.coalesce(plain, "own")).otherwise(F.col("own"))).drop("times"), "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = bucket_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, -1), chunks)
                sid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(sid)], names=["key", "sid"])

    under_keys = marks.select("sid", "signature").mapInArrow(spread, "key long, sid long")
    heads = under_keys.groupBy("key").agg(F.min("sid").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    own = Window.partitionBy("sid")  # a class has chunks * SLOTS rows
    met = stored(under_keys.join(heads, "key").select("sid", "head").distinct().withColumn("first", F.min("head").over(own)), "met")
    first = met.where("sid != first and head = first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    near = stored(_close(first, marks, similarity), "near")
    texts = stored(_texts(docs, marks, met.select("sid")), "texts")  # the only time that all texts move
    of = lambda pairs: texts.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid")
    labels = trees(_linked(near, of(near), k, percent))

    tried = (F.col("head") == F.col("first")) & (F.col("sid") != F.col("head"))
    members = met.select("head", "sid", tried.alias("tried")).join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    several = members.groupBy("head").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("rows"), F.count_if("tried").alias("some")).where("c0 < c1").where("rows > 2 or some = 0").select("head")
    left = stored(members.join(several, "head").join(marks.select("sid", "n", "wide"), "sid").select("head", "c", "sid", "n", "tried", "wide"), "open")
    merged = None
    if not left.isEmpty():
        forest = stored(_forest(_deal(left), similarity).dropDuplicates(["a", "b"]), "forest")
        fits = _linked(forest.select("a", "b"), of(forest), k, percent)
        joins = stored(forest.join(fits, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "joins")
        if not joins.isEmpty():
            merged = components(joins)
            left = stored(_relabelled(left, merged), "open")
        involved = stored(_involved(_deal(left), similarity), "involved")
        if not involved.isEmpty():
            more = stored(_joined(_deal(left.join(involved, "sid").join(texts, "sid")), similarity, k, percent), "joins")
            if not more.isEmpty():
                merged = components(joins.unionByName(more))
    found = marks.select("set_id", "sid", "least").join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    if merged is not None:
        found = _relabelled(found, merged)
    least = found.groupBy("c").agg(F.min("least").alias("component_id"))
    named = stored(found.join(least, "c").select("set_id", F.col("c").alias("component"), "component_id"), "components")
    return filed.select("doc_id", "text_hash", "n_shingles", "set_id").join(named, "set_id", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """From (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, a row for each row."""
    out = _grouped(docs, k, percent)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_hash")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each group of near-duplicates (five words, similarity 0.8) one row stays, and every row without words.

    It is a row of the group's least (doc_id, text_hash), null ids last; of equal ones, any one.
    """
    found = stored(_grouped(docs, 5, 80).where("set_id is not null").select("doc_id", "text_hash", "component"), "near-duplicates")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash"))
    keys = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    gone = keys.join(first, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_anti").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    left = docs.join(gone, same, "left_anti")
    twice = stored(keys.where("times > 1").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "repeated")
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
