"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are cut into windows of consecutive normalised words; all windows form one automaton,
which scans each normalised document once. Normalising keeps byte positions (it maps bytes to bytes), so each
hit goes back to word numbers and to code-point offsets of the original text. Documents never shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, filter_rows, for_worker, map_arrow, texts_of

#: Consecutive words of a window.
WINDOW = 10
#: Items and bytes of benchmark text of one automaton (which has about ten nodes for a byte); a larger benchmark takes
#: further passes, each over what the one before wrote.
ITEMS_PER_PASS, BYTES_PER_PASS = 100_000, 1 << 20

#: Bytes to bytes: A-Z to lower case, other ASCII than letters and digits to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased; none for null."""
    return text.encode().translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """The windows of an item; an item of fewer words than ``size``, but not none, is one window."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Scanner:
    """The automaton over the windows of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(normal_words(text), size):
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word((b" " + b" ".join(window) + b" ").decode("latin-1"), (len(window), ids))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of word numbers (start, end exclusive; sorted, merged) and the items that occur."""
        if self.empty or not words:
            return [], set()
        joined = b" " + b" ".join(words) + b" "
        found = [(end, *value) for end, value in self.automaton.iter(joined.decode("latin-1"))]
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _, _ in found])
        ranges = sorted((int(e) - size, int(e)) for e, (_, size, _) in zip(last, found, strict=True))
        return merged(ranges), set().union(*(ids for _, _, ids in found))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def code_point_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code-point offsets of the original text."""
    raw = text.encode()
    normal = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], normal, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in ranges]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Returns (id, n_words, n_hit, items, spans[, text]), a row per document.

    ``spans`` are the hit passages as code-point offsets, ``items`` the sorted ids (as strings) of items of
    which a window occurs. Null and empty texts have no words and no hits; repeated rows are judged each
    by itself. A null item id counts as the empty string, a null item text has no window; items with
    equal texts all count. An empty benchmark hits nothing. Other columns, whatever their names, are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<int>)").alias("_ranges"), F.expr("cast(array() as array<string>)").alias("items"))
    scratch = Scratch(docs.sparkSession, "contamination")
    parts = _blocks(benchmark)
    for b, items in enumerate(parts):
        last = b == len(parts) - 1
        out = _scanned(out, items(), kind, size, last, keep_text)
        if not last:
            out = scratch.keep(out, f"pass{b}")
            scratch.drop(f"pass{b - 1}")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_text", text_col)


def _blocks(benchmark: DataFrame) -> list[Callable[[], list[tuple[str, str | None]]]]:
    """For each pass, a function that collects its (item id, text) pairs, of about as many bytes as a pass may have."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    part = lambda b: rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
    return [lambda b=b: [tuple(r) for r in part(b).collect()] for b in range(blocks)]


def _scanned(df: DataFrame, items: list[tuple[str, str | None]], kind: str, size: int, last: bool, keep_text: bool) -> DataFrame:
    name = _name(items, size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = for_worker(("scanner", name), lambda: Scanner(items, size))
        for batch in batches:
            ids, before, owned = (batch.column(i).to_pylist() for i in (0, 3, 4))
            for at, texts in texts_of(batch, "_text"):
                for i, text in enumerate(texts, at):
                    words = normal_words(text)
                    ranges, found = scanner.scan(words)
                    flat = before[i]
                    ranges = merged(sorted([*ranges, *zip(flat[::2], flat[1::2], strict=True)])) if flat else ranges
                    row = {"_id": ids[i], "n_words": len(words), "items": sorted(found.union(owned[i]))}
                    if last:
                        row |= {"n_hit": sum(b - a for a, b in ranges), "spans": code_point_spans(text, ranges) if ranges else []}
                    else:
                        row["_ranges"] = [x for r in ranges for x in r]
                    if keep_text or not last:
                        row["_text"] = text
                    yield row

    if not last:
        return map_arrow(df, rows, f"_id {kind}, _text string, n_words bigint, _ranges array<int>, items array<string>", 500, keeps=True)
    schema = f"_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    return map_arrow(df, rows, schema + ", _text string" * keep_text, 500, keeps=True)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns, whatever their names.

    Null and empty texts stay; equal texts stay or go alike, repeated rows and null ids stay by their texts. An
    empty benchmark drops nothing, an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    parts = _blocks(benchmark)
    for b, items in enumerate(parts):
        docs = _clean(docs, items(), text_col, size)
        if b < len(parts) - 1:
            docs = scratch.keep(docs, f"pass{b}")
            scratch.drop(f"pass{b - 1}")
    return docs


def _name(items: list[tuple[str, str | None]], size: int) -> str:
    return hashlib.sha256(repr((size, sorted(items, key=repr))).encode()).hexdigest()


def _clean(docs: DataFrame, items: list[tuple[str, str | None]], text_col: str, size: int) -> DataFrame:
    name = _name(items, size)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bool]]]:
        scanner = for_worker(("scanner", name), lambda: Scanner(items, size))
        for batch in batches:
            yield batch, [not scanner.scan(normal_words(t))[0] for _, texts in texts_of(batch, text_col) for t in texts]

    return filter_rows(docs, keep, keeps=True)
