"""Sequence packing: shortest-pack-first over the length histogram.

Documents are cut into full sequences and a remainder. The histogram of remainder lengths is packed on the
driver (its size is bounded by the sequence length, not by the data): lengths are placed longest first, each
into the shortest packs whose room still takes it, and only counts of pack patterns are kept. Remainders
then get their rank within their length from a range sort, and each rank range belongs to one slot of one
pattern, which gives the sequence and the offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow, texts_of
from timberline.llm.tokens import encoder

SEQUENCE = 1024
#: Chunks in one generation of the encoder's memo; packing follows other stages in the same executors, so it takes less.
MEMO_CHUNKS = 60_000


def pack_histogram(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Pack patterns (lengths in order of placing) and how many packs have each.

    Lengths go longest first. Those of one length fill the packs with least in them first, among those
    with room; what remains opens new packs. Ties of fill go by pattern.
    """
    by_fill: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left, grown = counts[length], []
        for fill in sorted(f for f in by_fill if f + length <= capacity):
            for pattern in sorted(by_fill[fill]):
                if not left:
                    break
                have = by_fill[fill][pattern]
                # A pack may take the length several times; packs that do are the same pattern.
                times = min((capacity - fill) // length, -(-left // have))
                use = min(have, left // times)
                left -= use * times
                grown.append((fill + times * length, (*pattern, *[length] * times), use))
                by_fill[fill][pattern] = have - use
                if have == use:
                    del by_fill[fill][pattern]
            if not by_fill[fill]:
                del by_fill[fill]
        if left:
            times = max(1, capacity // length)
            full, rest = divmod(left, times)
            grown += [(times * length, (length,) * times, full)] * (full > 0) + [(rest * length, (length,) * rest, 1)] * (rest > 0)
        for fill, pattern, n in grown:
            by_fill[fill][pattern] = by_fill[fill].get(pattern, 0) + n
    return sorted((p, n) for packs in by_fill.values() for p, n in packs.items())


class Slots:
    """For each length: the rank ranges of its pieces, and the sequence and offset of each range's first piece."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], first_sequence: int):
        self.ranks: dict[int, list[int]] = defaultdict(list)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                self.ranks[length].append(used[length])
                self.places[length].append((first_sequence, offset))
                used[length] += n
                offset += length
            first_sequence += n
        self.end = first_sequence

    def place(self, length: int, rank: int) -> tuple[int, int]:
        k = bisect_right(self.ranks[length], rank) - 1
        sequence, offset = self.places[length][k]
        return sequence + rank - self.ranks[length][k], offset


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, start, length, ids_crc32, doc_tokens): full sequences and a remainder of each document's ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer, MEMO_CHUNKS).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for at, texts in texts_of(batch, "_text"):
                for i, ids in enumerate(encode([t or "" for t in texts]), at):
                    raw = memoryview(ids.astype("<u4").tobytes() + end)
                    total = len(ids) + 1
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        yield {"_id": numbers[i], "start": start, "length": length, "ids_crc32": zlib.crc32(raw[4 * start : 4 * (start + length)]), "doc_tokens": total}

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(narrow, rows, f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", 5000, keeps=True)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Each document's ids with ``end_id`` are cut at multiples of ``capacity``; every id lies in one piece and
    pieces lie without gaps from offset 0 of their sequence. Null and empty texts have only the end id.
    Repeated rows are packed each by itself; null ids stay null. An empty table gives no rows. Other
    columns, whatever their names, are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(cut_documents(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    slots = Slots(pack_histogram(histogram, capacity), full)
    # Where each length begins in the order of all pieces, full ones last.
    begins, before = {}, 0
    for length in [*sorted(histogram), capacity]:
        begins[length] = before
        before += histogram.get(length, 0)
    # The order is cut into ranges by id too, so a length that a third of all pieces have is no single task.
    ordered = pieces.repartitionByRange("length", "_id", "start", "ids_crc32").sortWithinPartitions("length", "_id", "start", "ids_crc32")
    numbered = scratch.keep(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    firsts, before = {}, 0
    for r in sorted(numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        firsts[r["_part"]] = before
        before += r["n"]
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                rank = firsts[r.pop("_part")] + r.pop("_row") - begins[r["length"]]
                sequence, offset = (rank, 0) if r["length"] == capacity else slots.place(r["length"], rank)
                yield r | {"sequence_id": sequence, "offset": offset}

    out = map_arrow(numbered, rows, f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", 5000)
    return out.withColumnRenamed("_id", id_col)
