"""Best-fit packing of documents into sequences of a fixed capacity.

Documents are tokenized, ended with id 0, and cut only when longer than the capacity. Then
bulk-synchronous best-fit:

1. range-sort: pieces are range-partitioned and sorted by (length, doc_id, piece), so that a
   piece is named by its length and its rank among the pieces of that length. Lengths are at most the
   capacity, so the sorted documents are at most `capacity` runs of equal length; gaps likewise.
2. each round takes the longest run that is left. Its documents sweep the sorted gaps upwards
   from the successor of their length, tightest first; ranks settle who gets which gap, so no two
   documents ask for one place. What finds no gap opens new sequences. Gaps are updated, and the
   next round begins. A round writes intervals of ranks, not documents.
3. every piece looks its (length, rank) up in the intervals: one narrow pass.

Sweeps on runs give the same sequences as sweeps on single documents, since documents of one
length are interchangeable up to rank; what the driver holds is bounded by the capacity and
the number of intervals, never by the number of documents.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept as null; repeated
doc_ids are packed each on their own; a very long text is cut into as many pieces as it takes; ties between pieces of one length go by doc_id, piece and
checksum, and equal rows are interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, read_table, stored
from .wordpiece import encoder, tokenizer_file

CAPACITY = 2048
SEPARATOR = 0
LENGTH_BITS, RANK_BITS = 22, 40


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """The pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    end, wide = np.array([separator], dtype="<u4").tobytes(), 4 * capacity
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * keep_ids])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in schema]
                for doc, code in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    code += end
                    for k, lo in enumerate(range(0, len(code), wide)):
                        ids = code[lo : lo + wide]
                        row = [doc, k, lo // 4, len(ids) // 4, zlib.crc32(ids), *[np.frombuffer(ids, "<u4").astype(np.int32)] * keep_ids]
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return only(docs, doc_id="long", text="string").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class Gaps:
    """Open sequences in runs: for each gap, intervals of sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.runs, self.opened = capacity, [], {}, 0

    def put(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.runs:
                insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(bisect_left(self.sizes, gap))
        return run

    def successor(self, length: int) -> int | None:
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def open(self, count: int) -> int:
        self.opened += count
        return self.opened - count


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places runs of documents. Returns (length, first rank, first sequence, documents in each sequence, first offset), sorted, and the number of sequences.

    Documents first rank, first rank + 1, ... of that length fill the sequences one after another, up to the next interval of the same length.
    """
    gaps, placed = Gaps(capacity), []
    for length in sorted(counts, reverse=True):  # a round
        rank, left = 0, counts[length]
        while left:
            gap = gaps.successor(length)
            if gap is None:
                gap = capacity
                first, bins = gaps.open(n := -(-left // (capacity // length))), n
            else:
                first, bins = gaps.take(gap)
            each = gap // length
            whole = min(bins, left // each)
            if whole:
                placed.append((length, rank, first, each, capacity - gap))
                gaps.put(gap - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < bins:
                rest = bins - whole
                if left and left < each:
                    placed.append((length, rank, first + whole, each, capacity - gap))
                    gaps.put(gap - left * length, first + whole, 1)
                    rank, left, rest, whole = rank + left, 0, rest - 1, whole + 1
                gaps.put(gap, first + whole, rest)
    return sorted(placed), gaps.opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length and any other columns) with sequence_id and offset."""
    if not 0 < capacity < 1 << LENGTH_BITS:
        raise ValueError(f"a capacity is positive and below {1 << LENGTH_BITS}")
    spark = pieces.sparkSession
    keys = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    names = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            new = np.append(True, lengths[1:] != lengths[:-1])
            at = np.arange(len(lengths))
            local = at - np.maximum.accumulate(np.where(new, at, 0))
            if lengths[0] == last:
                head = len(lengths) if new[1:].sum() == 0 else int(np.flatnonzero(new)[1])
                local[:head] += seen
            last, seen = lengths[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(local)], names=[*names, "_part", "_local"])

    sorted_runs = stored(pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(ranked, f"{fields}, _part int, _local long"), "pieces")
    # A run spans neighbouring partitions, so this has at most capacity + partitions rows.
    heights = sorted_runs.groupBy("length", "_part").agg(F.count("*").alias("n")).orderBy("length", "_part").collect()
    counts: dict[int, int] = {}
    before = {}
    for row in heights:
        before[row["_part"], row.length] = counts.get(row.length, 0)
        counts[row.length] = counts.get(row.length, 0) + row.n
    placed, _ = sweep(counts, capacity)
    plan = np.array(placed, dtype=np.int64).reshape(-1, 5)
    # (length, rank) as one ascending number: a run has fewer than 2^RANK_BITS documents.
    codes = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    held = spark.sparkContext.broadcast((before, plan, codes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, plan, codes = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            part, local = (batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            mixed = (part << LENGTH_BITS) + length
            some, back = np.unique(mixed, return_inverse=True)
            rank = local + np.array([before[int(x) >> LENGTH_BITS, int(x) & ((1 << LENGTH_BITS) - 1)] for x in some], np.int64)[back]
            hit = plan[np.searchsorted(codes, (length << RANK_BITS) + rank, "right") - 1]
            i = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(hit[:, 2] + i // hit[:, 3]), pa.array(hit[:, 4] + i % hit[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return sorted_runs.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    # Stored first: range-partitioning looks at its input twice, and tokenizing twice costs more than writing pieces.
    return pack(stored(cut(docs, tokenizer, capacity, separator, keep_ids), "cut"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read_table(spark, sf_dir, "documents"), tokenizer_file())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the plan of sequences for what is left (`best_fit(..., keep_ids=True)` brings the ids along)."""
    return best_fit(docs, tokenizer_file())
