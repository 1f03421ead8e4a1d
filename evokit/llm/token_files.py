"""Operator 5: token files with directly addressable codes.

Ids are split into 8-bit chunks. Level k holds the k-th chunk of every id that has one, and a bitmap
that tells which of them go on to level k + 1; a rank directory counts the set bits before every 512th.
Any id is found with one rank and one look-up a level, without decoding its neighbours.

A segment holds whole documents in id order, about ``segment_tokens`` ids, with its document
directory; segments are rows of a Parquet table, so Spark's commit protocol keeps exactly one copy of
each when tasks are run again, and any store that Spark writes will do.

Defined results: a null text counts as empty and gives only the end id; null document ids come
first; equal ids are ordered by their texts' hash, and repeated rows are kept; long texts stay whole;
an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.llm.byte_bpe import codec, read_vocabulary

BLOCK = 512
SEGMENT_TOKENS = 1 << 20
BROADCAST_PARTS = 100_000
#: Positions that are looked up in one copy of a segment.
POSITIONS = 1 << 16
SCHEMA = "part int, seg int, inner_first long, n_tokens long, n_docs long, doc_ids array<long>, doc_starts array<long>, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Levels as bytes: their number, then for each its length, chunks, bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)) if len(more) else [])).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<B", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class Codes:
    """A packed segment opened for reading."""

    def __init__(self, raw: bytes):
        self.levels, at = [], 1
        for _ in range(raw[0]):
            (n,) = struct.unpack_from("<I", raw, at)
            at += 4
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, (n + 7) // 8, at + n)
            at += n + len(bits)
            ranks = np.frombuffer(raw, "<u4", -(-n // BLOCK) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The i-th id: at most one rank a level, each over at most one block of the bitmap."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def rank(self, level: int, i: int) -> int:
        """The ids before place ``i`` of a level that go on to the next one: a look-up and at most a block of the bitmap."""
        _, bits, ranks = self.levels[level]
        first = i // BLOCK * BLOCK
        return int(ranks[i // BLOCK]) + int(np.unpackbits(bits[first >> 3 : (i + 7) >> 3], bitorder="little")[: i - first].sum())

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids from place ``a`` to before ``b``, and no others: their chunks are next to each other in every level, from the rank of ``a`` to that of ``b``."""
        if not 0 <= a <= b <= len(self):
            raise IndexError((a, b))
        parts = []
        for level, (chunks, bits, _) in enumerate(self.levels):
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            parts.append((chunks[a:b].astype(np.uint32), more))
            if not more.any():
                break
            a = self.rank(level, a)
            b = a + int(more.sum())
        value = np.empty(0, np.uint32)
        for own, more in reversed(parts):
            own[more] |= value << 8
            value = own
        return value


def write_tokens(docs: DataFrame, path: str, vocabulary: str, pattern: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every text, append ``end_id`` and write segments in ascending id order to ``path``.

    The one shuffle is by ranges of the id, with the text's hash for equal ids.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, seg = codec(sent.value, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        parts: list[bytes] = []
        size = done = 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(p) // 4 for p in parts)])
            values = (part, seg, done, int(starts[-1]), len(names), names, starts[:-1].tolist(), pack(np.frombuffer(b"".join(parts), "<u4")))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for row, ids, bounds in c.encode_column(batch.column(1)):
                raw = ids.astype("<u4").tobytes()
                for k, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    names.append(ids_of[row + k])
                    parts.append(raw[4 * x : 4 * y] + end)
                    size += y - x + 1
                    if size >= segment_tokens:
                        yield close()
                        names, parts, done, size, seg = [], [], done + size, 0, seg + 1
        if names:
            yield close()

    rows.select("id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first``, the ids in all segments before each.

    The total of each writing task is summed and ordered, one row a task; those rows are sent to the
    segments as a broadcast while they are few, which is counted, so the codes are not shuffled.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    if totals.count() <= BROADCAST_PARTS:
        totals = F.broadcast(totals)
    return table.join(totals, "part").withColumn("first", F.col("before") + F.col("inner_first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document read back from its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = Codes(r["codes"]).between(0, r["n_tokens"]).astype(np.int32)
                bounds = [*r["doc_starts"], r["n_tokens"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["first"] + s for s in r["doc_starts"]], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return segments(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each read from the files by its own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, bounds = Codes(r["codes"]), [*r["doc_starts"], r["n_tokens"]]
                sums = [zlib.crc32(codes.between(a, b).astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["first"] + s for s in r["doc_starts"]], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return segments(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for a table of global positions, each once: they are looked up in their segments, none is decoded.

    Positions find their segment without its codes and are gathered, at most ``POSITIONS`` of them, before the codes are joined to them.
    Null positions and those outside the files give no row.
    """
    table = segments(spark, path)
    # A segment has about SEGMENT_TOKENS ids; buckets of that width make the range join an equi-join.
    width = SEGMENT_TOKENS
    last = ((F.col("first") + F.col("n_tokens") - 1) / width).cast("long")
    spread = table.select("part", "seg", "first", "n_tokens", F.explode(F.sequence((F.col("first") / width).cast("long"), last)).alias("bucket"))
    wanted = positions.select(F.col("position").cast("long")).where("position >= 0").distinct().withColumn("bucket", (F.col("position") / width).cast("long"))
    found = wanted.join(spread, "bucket").where("position >= first and position < first + n_tokens")
    chunk = ((F.col("position") - F.col("first")) / POSITIONS).cast("long").alias("chunk")
    gathered = found.groupBy("part", "seg", "first", chunk).agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = Codes(r["codes"])
                ids = [codes[p - r["first"]] for p in r["positions"]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (r["positions"], ids)], names=["position", "id"])

    return gathered.join(table.select("part", "seg", "codes"), ["part", "seg"]).select("first", "positions", "codes").mapInArrow(run, "position long, id long")
