"""Quotation linking: conversations in reply order, without their quotes.

A line's quote level is its number of leading `>` marks. Runs of lines of one level are passages. Passages and each
message's own text are normalised (lower case, white space folded) and hashed, as a whole and paragraph by
paragraph and line by line. Parts of a quoted passage of under LEAST letters count only where nothing else of it leads anywhere. A quoted passage meets the messages of its conversation
that have the same hash; the latest one before the quoting message is its origin, found by an as-of window over spans of
SPAN turns and over the spans' latest owners, so that a line quoted and owned many times makes no pairs. The parent of a message is the origin of its
first outermost quote; where the outermost quotes lead nowhere, deeper levels are tried, one by one. A message without a linked quote
begins a thread of its own. Reply order is the order of paths (the turns from the thread's first message down),
found by doubling: each round joins every message's path with that of its topmost ancestor so far. `position` numbers the
messages of a conversation in that order; it comes from one range sort, in which a long conversation spans several tasks.

Defined cases: a null text has no quotes and stays null; a message of quotes alone gets an empty text;
lines that announce a quote ("... wrote:" right before one) go with it; a null conv_id or turn links
with nothing; of repeated (conv_id, turn) each row is kept and they share what either is linked with; a passage
found in several earlier messages belongs to the latest; rows without conv_id have no position; ties in reply order go by text, and equal
rows are interchangeable; a very long text is one message, hashed line by line; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import dropped, only, read_table, stored

LEAST = 8
SPAN = 1024
_marks = re.compile(r"^\s*((?:>\s?)+)")
_announces = re.compile(r"(?:wrote|writes|said|écrit|schrieb|escribió)\s*:\s*$", re.IGNORECASE)


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages (level, text) in order."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        found = _marks.match(line)
        level = found[1].count(">") if found else 0
        if level:
            if not before:
                at = len(own) - 1
                while at >= 0 and not own[at].strip():
                    at -= 1
                if at >= 0 and _announces.search(own[at]):
                    del own[at:]
            if level != before or not quoted:
                quoted.append((level, []))
            quoted[-1][1].append(line[found.end() :])
        else:
            own.append(line)
        before = level
    return "\n".join(own).strip("\n") if quoted else text, [(n, "\n".join(lines)) for n, lines in quoted]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def hashes(text: str) -> dict[int, int]:
    """Of the whole, of paragraphs, of lines; with 1 for a part of under LEAST letters, else 0."""
    parts = [text, *(p for p in re.split(r"\n\s*\n", text)), *text.split("\n")]
    clean = [normal(p) for p in parts]
    found: dict[int, int] = {}
    for i, c in enumerate(clean):
        if c:
            found.setdefault(xxhash.xxh64_intdigest(c) - (1 << 63), int(i > 0 and len(c) < LEAST))
    return found


def _parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), own (hashes), quotes (level, place, short, hash)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int32()), ("short", pa.int32()), ("hash", pa.int64())]))
        for batch in batches:
            texts, own, quotes = [], [], []
            for text in batch.column(3).to_pylist():
                body, quoted = passages(text) if text is not None else (None, [])
                texts.append(body)
                own.append(list(hashes(body)) if body else [])
                quotes.append([{"level": n, "place": i, "short": short, "hash": h} for i, (n, q) in enumerate(quoted) for h, short in hashes(q).items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, quote)], names=["conv_id", "turn", "role", "text", "own", "quotes"])

    return messages.mapInArrow(rows, "conv_id long, turn long, role string, text string, own array<long>, quotes array<struct<level:int,place:int,short:int,hash:long>>")


def _latest(wanted: DataFrame, owners: DataFrame) -> DataFrame:
    """For each (conv_id, hash, turn) the latest `origin` before that turn in `owners` (conv_id, hash, origin), if any."""
    span = F.floor(F.col("turn") / SPAN).alias("span")
    own = owners.select("conv_id", "hash", F.col("origin").alias("turn"), F.col("origin").alias("owner"))
    events = own.unionByName(wanted.withColumn("owner", F.lit(None).cast("long"))).select("*", span)
    within = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("owner").over(within)).where("owner is null")
    earlier = Window.partitionBy("conv_id", "hash").orderBy("span").rangeBetween(Window.unboundedPreceding, -1)
    far = events.groupBy("conv_id", "hash", "span").agg(F.max("owner").alias("top")).withColumn("far", F.max("top").over(earlier)).drop("top")
    joined = near.join(far, ["conv_id", "hash", "span"])
    return joined.select("conv_id", "hash", "turn", F.coalesce("near", "far").alias("origin")).where("origin is not null")


def _positions(rows: DataFrame) -> DataFrame:
    """`rows` (a stored table, which goes) with `position`, the place of each in its conversation by reply_path, from 0."""
    spark, names = rows.sparkSession, rows.columns
    keys = [F.col("conv_id"), F.col("reply_path"), F.xxhash64("role", "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(names.index("conv_id")).fill_null(-1).to_numpy(zero_copy_only=False)
            void = batch.column(names.index("conv_id")).is_null().to_numpy(zero_copy_only=False)
            new = np.append(True, (ids[1:] != ids[:-1]) | (void[1:] != void[:-1]))
            at = np.arange(len(ids))
            local = at - np.maximum.accumulate(np.where(new, at, 0))
            if last == (ids[0], void[0]):
                local[: int(np.flatnonzero(new)[1]) if new.sum() > 1 else len(ids)] += seen
            last, seen = (ids[-1], void[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(local)], names=[*names, "_part", "_local"])

    ordered = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(ranked, f"{fields}, _part int, _local long"), "ordered")
    dropped(rows)
    heights = ordered.where("conv_id is not null").groupBy("conv_id", "_part").agg((F.max("_local") + 1).alias("n"))
    # Only a conversation across a border of two partitions has several parts: fewer than two rows a partition.
    several = heights.groupBy("conv_id").agg(F.collect_list(F.struct("_part", "n")).alias("parts")).where("size(parts) > 1")
    before = several.select("conv_id", F.explode("parts").alias("p"), "parts").select("conv_id", F.col("p._part").alias("_part"), F.aggregate(F.filter("parts", lambda q: q["_part"] < F.col("p._part")), F.lit(0).cast("long"), lambda n, q: n + q["n"]).alias("_before"))
    joined = ordered.join(F.broadcast(before), ["conv_id", "_part"], "left")
    return joined.select(*names, F.when(F.col("conv_id").isNotNull(), F.col("_local") + F.coalesce("_before", F.lit(0))).alias("position"))


def link(messages: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text): conv_id, turn, role, text, n_quotes, parent_turn, thread_turn, depth, reply_path, position, a row for each row.

    A conversation in reply order is its rows by position. They are not gathered into one row, since nothing bounds a conversation.
    """
    rows = only(messages, conv_id="long", turn="long", role="string", text="string")
    parsed = stored(_parsed(rows), "messages")
    known = parsed.where("conv_id is not null and turn is not null")
    quoted = known.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    # Only conversations and hashes that are quoted at all go on: a message's own hashes are as many as its lines.
    wanted = quoted.select("conv_id", "hash").distinct()
    owners = known.select("conv_id", F.col("turn").alias("origin"), F.explode("own").alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    found = quoted.join(_latest(quoted.select("conv_id", "hash", "turn").distinct(), owners), ["conv_id", "hash", "turn"])
    # Level first, then place, then what isn't short, then the latest origin: one row a message.
    best = found.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("level", "place", "short", -F.col("origin"))).alias("parent_turn"))
    parents = stored(best, "parents")
    # Messages that quote: path of turns from `top` (an ancestor) down to the message.
    paths = stored(parents.select("conv_id", "turn", F.col("parent_turn").alias("top"), F.array("parent_turn", "turn").alias("path")), "paths")
    while True:
        upper = paths.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("path").alias("above"))
        longer = paths.join(upper, ["conv_id", "top"], "left")
        step = stored(longer.select("conv_id", "turn", F.coalesce("higher", "top").alias("top"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", F.slice("path", 2, F.size("path")))).alias("path"), F.col("higher").isNotNull().alias("moved")), "paths")
        paths = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    linked = stored(paths.join(parents, ["conv_id", "turn"]), "linked")
    out = parsed.join(linked, ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    replies = out.select("conv_id", "turn", "role", "text", F.size(F.array_distinct(F.transform("quotes", lambda q: q["place"]))).alias("n_quotes"), "parent_turn", F.coalesce("top", "turn").alias("thread_turn"), (F.size(path) - 1).alias("depth"), path.alias("reply_path"))
    replies = stored(replies, "replies")
    dropped(parsed)
    return _positions(replies)


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "conversations"))
