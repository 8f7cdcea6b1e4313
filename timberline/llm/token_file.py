"""Token-id files in patched frame-of-reference (PFOR) blocks.

A file is a run of sections; each is self-delimiting and holds whole documents in order:

    "PFT1", section length u32, documents u32, ids u64 (all little-endian)
    doc ids i64[documents], id counts u32[documents]
    blocks u32, byte offset of each block u32[blocks], then the blocks
    one newline byte (the text writer's record separator)

A block has up to BLOCK ids: minimum u32, width u8, exceptions u8, the ids less the minimum packed at that
width (little-endian 64-bit words), then the exceptions' positions u8[] and values u32[]. The width is the
one that the PERCENTILE-th smallest difference of the block needs, larger ones become exceptions.

Sections are written by Spark's text writer (its commit protocol survives lost tasks and works on any
Hadoop file system) and read back with the ``binaryFile`` source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow, texts_of
from timberline.llm.tokens import encoder

BLOCK = 128
PERCENTILE = 90
#: Ids after which a section is closed.
SECTION_IDS = 262_144
MAGIC = b"PFT1"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 2 * width words of 64 bits."""
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((2 * width, len(values)), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & mask).T)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block start offsets and the blocks' bytes; the last block is padded with its own last id."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    grid = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.int64).reshape(n, BLOCK)
    low = grid.min(axis=1)
    over = grid - low[:, None]
    chosen = np.partition(over, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(chosen + 1)).astype(np.int64)
    outlier = over >= (1 << width)[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        words = _pack(np.where(outlier[at], 0, over[at]), int(w))
        for k, row in zip(at.tolist(), words, strict=True):
            packed[k] = row.tobytes()
    out: list[bytes] = []
    counts = outlier.sum(axis=1)
    places, values = np.nonzero(outlier)[1].astype(np.uint8), grid[outlier].astype("<u4")
    ends = np.cumsum(counts).tolist()
    for k, (lo, w, c, end) in enumerate(zip(low.tolist(), width.tolist(), counts.tolist(), ends, strict=True)):
        out.append(lo.to_bytes(4, "little") + bytes((w, c)) + packed[k] + places[end - c : end].tobytes() + values[end - c : end].tobytes())
    sizes = np.array([len(b) for b in out])
    return (np.cumsum(sizes) - sizes).astype("<u4"), b"".join(out)


def decode_blocks(starts: np.ndarray, data: bytes, n_ids: int) -> np.ndarray:
    n = len(starts)
    raw = np.frombuffer(data, np.uint8)
    grid = np.zeros((n, BLOCK), np.uint32)
    if n:
        at = starts.astype(np.int64)
        low = raw[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        width, counts = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            words = raw[at[of][:, None] + 6 + np.arange(16 * int(w))].copy().view("<u8")
            grid[of] = low[of][:, None] + _unpack(words, int(w)).astype(np.uint32)
        for k in np.flatnonzero(counts).tolist():
            a = int(at[k]) + 6 + 16 * int(width[k])
            c = int(counts[k])
            grid[k, raw[a : a + c]] = np.frombuffer(data, "<u4", c, a + c)
    return grid.reshape(-1)[:n_ids]


def encode_section(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    starts, blocks = encode_blocks(flat)
    body = b"".join((np.array(doc_ids, "<i8").tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), np.array([len(starts)], "<u4").tobytes(), starts.tobytes(), blocks))
    return MAGIC + (len(body) + 20).to_bytes(4, "little") + len(doc_ids).to_bytes(4, "little") + len(flat).to_bytes(8, "little") + body


def decode_sections(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, id counts, all ids) of each section of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no section at byte {at}")
        size, docs, n_ids = int.from_bytes(data[at + 4 : at + 8], "little"), int.from_bytes(data[at + 8 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        p = at + 20
        doc_ids = np.frombuffer(data, "<i8", docs, p)
        counts = np.frombuffer(data, "<u4", docs, p + 8 * docs)
        p += 12 * docs
        blocks = int.from_bytes(data[p : p + 4], "little")
        starts = np.frombuffer(data, "<u4", blocks, p + 4)
        yield doc_ids, counts, decode_blocks(starts, data[p + 4 + 4 * blocks : at + size], n_ids)
        at += size + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending order of the id column.

    One file per range of ids, named in order (part-00000 holds the smallest). Null and empty texts give
    only the end id; a null document id is stored as the smallest 64-bit integer. Repeated ids stay, next to
    each other, in the order of their texts' hashes. An empty table gives files without sections.
    """
    narrow = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = narrow.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id])
        held_docs: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for at, texts in texts_of(batch, "text"):
                for i, ids in enumerate(encode([t or "" for t in texts]), at):
                    held_docs.append(numbers[i])
                    held.append(np.concatenate((ids.astype(np.uint32), end)).astype(np.uint32))
                    size += len(ids) + 1
                    if size >= SECTION_IDS:
                        yield {"section": encode_section(held_docs, held)}
                        held_docs, held, size = [], [], 0
        if held:
            yield {"section": encode_section(held_docs, held)}

    sections = map_arrow(ordered, rows, "section binary", 1, keeps=True)
    sections.select(F.col("section").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Returns (file, place, doc_id, n_tokens, ids_crc32, first): a row per document as it lies in the files.

    ``first`` is the number of ids before the document in its own file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in range(batch.num_rows):
                name = int(batch.column(0)[r].as_py().rsplit("/", 1)[-1].split("-")[1])
                first = place = 0
                for doc_ids, counts, ids in decode_sections(batch.column(1)[r].as_py()):
                    ends = np.cumsum(counts.astype(np.int64)).tolist()
                    raw = memoryview(ids.astype("<u4").tobytes())
                    for doc, n, b in zip(doc_ids.tolist(), counts.tolist(), ends, strict=True):
                        yield {"file": name, "place": place, "doc_id": doc, "n_tokens": n, "ids_crc32": zlib.crc32(raw[4 * (b - n) : 4 * b]), "first": first + b - n}
                        place += 1
                    first += len(ids)

    return map_arrow(files, rows, "file bigint, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, first bigint", 5000)


def token_file_index(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file): each document's place in the order of all files, read from them.

    The ids before a file are a running sum over one row per file.
    """
    documents = scratch.keep(read_token_files(spark, path), "read_back")
    totals = sorted((r["file"], r["n"]) for r in documents.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before, sums = 0, []
    for file, n in totals:
        sums.append((file, before))
        before += n
    offsets = spark.createDataFrame(sums, "file bigint, before bigint")
    joined = documents.join(offsets, "file")
    return joined.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file")
