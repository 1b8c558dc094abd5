"""Token ids in binary form: one concatenated id array with Elias-Fano document boundaries.

The file format is a table of blocks. A block holds consecutive documents (ascending doc_id):

    shard       int     number of the range of ids it belongs to (ascending)
    block       int     number within the shard
    first       long    ids of the shard before this block
    n_docs      int
    n_ids       long
    ids         binary  n_ids little-endian ids, 2 bytes each when every id of the block is below 65536, else 4
    id_bytes    int     2 or 4
    ends        binary  Elias-Fano code of the documents' ends within the block
    doc_ids     binary  n_docs little-endian signed 64-bit document ids
    nulls       binary  n_docs bytes, 1 where the document's id is null; none if no id of the block is

and a manifest (shard, base): the ids before each shard. Both are Parquet, written by Spark's
own committer, so a retried or speculative task never leaves half a file, and any store that
Spark can write will do. No table of 64-bit offsets is kept anywhere: `EliasFano.select` gives
a document's end in constant expected time from its high bits (one sample each 64 ones), and reading goes by it.

Defined cases: a null or empty text is a document of the end id alone; a null doc_id is stored
with a null mark and sorts first; repeated doc_ids are all kept, ordered by text, and equal rows are interchangeable; a very long text is one document,
whose block ends with it; an empty table gives no blocks and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, read_table, scratch_path
from .wordpiece import encoder, tokenizer_file

BLOCK_IDS = 1 << 20
END_ID = 2
SAMPLE = 64


class EliasFano:
    """A non-decreasing list of n numbers below or at `top`, in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, top: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.high, self.low, self.samples = n, top, low_bits, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(np.floor(np.log2(top / n)))) if n and top > n else 0
        at = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        return cls(n, top, low_bits, np.packbits(bits), np.packbits(low), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.high), len(self.low)], dtype="<u4").tobytes()
        return head + np.array([self.top], dtype="<u8").tobytes() + self.high.tobytes() + self.low.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_high, n_low = (int(x) for x in np.frombuffer(data, "<u4", 4))
        top, at = int(np.frombuffer(data, "<u8", 1, 16)[0]), 24
        high = np.frombuffer(data, np.uint8, n_high, at)
        low = np.frombuffer(data, np.uint8, n_low, at + n_high)
        return cls(n, top, low_bits, high, low, np.frombuffer(data, "<u4", -1, at + n_high + n_low) if n else np.zeros(0, "<u4"))

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= ((int(self.low[bit >> 3]) >> (7 - (bit & 7))) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th number: from the last sampled one-bit, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at >> 3, int(self.high[at >> 3]) & (0xFF >> (at & 7))
        while seen.bit_count() <= left:
            left -= seen.bit_count()
            byte += 1
            seen = int(self.high[byte])
        for bit in range(8):
            if seen >> (7 - bit) & 1:
                if not left:
                    return (((byte << 3) + bit - i) << self.low_bits) | self._low(i)
                left -= 1
        raise AssertionError("unreachable")

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return high | (bits << np.arange(self.low_bits)).sum(axis=1)


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32()), ("ends", pa.binary()), ("doc_ids", pa.binary()), ("nulls", pa.binary())])
BLOCKS_SQL = "shard int, block int, first long, n_docs int, n_ids long, ids binary, id_bytes int, ends binary, doc_ids binary, nulls binary"


def _block(shard: int, block: int, first: int, docs: list[int | None], parts: list[bytes]) -> pa.RecordBatch:
    nulls = bytes(doc is None for doc in docs) if None in docs else None
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = EliasFano.of(np.cumsum([len(p) // 4 for p in parts]))
    small = not len(ids) or int(ids.max()) < 1 << 16
    row = [shard, block, first, len(docs), len(ids), ids.astype("<u2" if small else "<u4").tobytes(), 2 if small else 4, ends.to_bytes(), np.array([doc or 0 for doc in docs], dtype="<i8").tobytes(), nulls]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, BLOCKS.types, strict=True)], schema=BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes `docs` (doc_id, text), appends `end_id` to each, and writes blocks and manifest below `path`."""
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string")
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        block = first = held = 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, code in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    parts.append(code + end)
                    held += len(code) // 4 + 1
                    if held >= block_ids:
                        yield _block(shard, block, first, ids, parts)
                        block, first, held, ids, parts = block + 1, first + held, 0, [], []
        if ids:
            yield _block(shard, block, first, ids, parts)

    # Ranges by text's hash too, so that one id's many rows, or rows without an id, are dealt over partitions.
    ranged = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("doc_id", "text")
    ranged.mapInArrow(encode, BLOCKS_SQL).write.parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, rows = 0, []
    for row in totals:  # a row for each range of ids
        rows.append((row.shard, before))
        before += row.n
    spark.createDataFrame(rows, "shard int, base long").coalesce(1).write.parquet(f"{path}/manifest")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks")
    manifest = spark.read.schema("shard int, base long").parquet(f"{path}/manifest")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, first, width, ids, ends, docs, nulls in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                code, raw, begin = EliasFano.from_bytes(ends), memoryview(ids.tobytes()), 0
                starts, sizes, crc = [], [], []
                for i in range(code.n):
                    end = code.select(i)
                    starts.append(base + first + begin)
                    sizes.append(end - begin)
                    crc.append(zlib.crc32(raw[4 * begin : 4 * end]))
                    begin = end
                marks = np.frombuffer(nulls, np.uint8).astype(bool) if nulls else None
                out = [pa.array(np.frombuffer(docs, "<i8"), mask=marks), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(out, kinds, strict=True)], names=names)

    joined = blocks.join(F.broadcast(manifest), "shard").select("base", "first", "id_bytes", "ids", "ends", "doc_ids", "nulls")  # a row for each range of ids
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_file())
    return read_ids(spark, path)
