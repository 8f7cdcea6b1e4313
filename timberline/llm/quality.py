"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams.

Trusted documents are counted into n-grams (as integers, so exactly), lower orders into continuation
counts. All documents are cut into chunks; a chunk asks for the probabilities of its distinct n-grams. The
asked n-grams meet the counts of each order in sharded joins, go back to their chunks, and each chunk
scores its documents. Documents whose perplexity is above a quantile of the trusted ones of their language
are of low quality. Neither counts nor probabilities pass through the driver; it sees four counts-of-counts
for each order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow, small_batches

ORDER = 4
#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK = 8 << 20
#: Cells of a chunk's table of probabilities at most, and bytes of a text that are looked up at once.
TABLE_CELLS, PIECE = 1 << 24, 1 << 18
#: A document is kept if its perplexity is at most this quantile of its language's trusted documents; chosen on held-out labels (README).
QUANTILE = 0.985
UNKNOWN = "und"


def padded_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ORDER - 1 zero bytes, and the mask of the texts' own bytes."""
    gap = bytes(ORDER - 1)
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), np.uint8)
    own = np.ones(len(data), bool)
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts[:-1])])
    for k in range(ORDER - 1):
        own[starts + k] = False
    return data, own


def ngram_codes(texts: list[bytes]) -> np.ndarray:
    """The n-gram that ends at each byte of each text, as an integer of ORDER bytes."""
    if not texts:
        return np.zeros(0, np.uint32)
    data, own = padded_bytes(texts)
    code = np.zeros(len(data), np.uint32)
    for k in range(ORDER):
        code[ORDER - 1 :] |= data[ORDER - 1 - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return code[own]


def count_ngrams(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(g, c) over all texts; counted within runs of about CHUNK bytes before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            g, c = np.unique(ngram_codes(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(0)[i].as_py() or "").encode()
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    small_batches(texts.sparkSession)
    part = texts.select(text_col).mapInArrow(rows, "g bigint, c bigint")
    return part.groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney, from the counts-of-counts n1 to n4."""
    n = [x or 0 for x in counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * y
        out.append(min(max(d, 0.1), i - 0.05))
    return tuple(out)


def model_tables(counts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (g, lead) discounted probability mass, and (h, rest) weight of the lower order, by context."""
    levels = [scratch.keep(counts, f"counts{ORDER}")]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[0].select(F.col("g").bitwiseAND((1 << 8 * order) - 1).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
        levels.insert(0, scratch.keep(shorter, f"counts{order}"))
    out = []
    for order, c in enumerate(levels, 1):
        d = discounts(c)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = c.withColumn("h", F.shiftright("g", 8)).groupBy("h").agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        context = scratch.keep(context.select("h", "total", (F.col("off") / F.col("total")).alias("rest")), f"contexts{order}")
        lead = c.withColumn("h", F.shiftright("g", 8)).join(context, "h").select("g", ((F.col("c") - off) / F.col("total")).alias("lead"))
        out.append((scratch.keep(lead, f"leads{order}"), context.select("h", "rest")))
    return out


def probabilities(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """(g, logp) for distinct asked n-grams of ORDER bytes, by a join with the counts of each order in turn."""
    known: DataFrame | None = None
    for order, (lead, context) in enumerate(tables, 1):
        want = asked.select(F.col("g").bitwiseAND((1 << 8 * order) - 1).alias("g")).distinct()
        joined = want.withColumn("h", F.shiftright("g", 8)).join(context, "h", "left").join(lead, "g", "left")
        if known is None:
            lower = F.lit(1 / 256)
        else:
            joined = joined.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(known.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
            lower = F.col("lower")
        known = scratch.keep(joined.select("g", (F.coalesce("lead", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * lower).alias("p")), f"p{order}")
    return known.select("g", F.log("p").alias("logp"))


def cut_chunks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(chunk, ids, langs, sizes, payload, asked): texts as one compressed string, and their distinct n-grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import zstandard

        part, number = TaskContext.get().partitionId(), 0
        ids, langs, held, size = [], [], [], 0

        def closed() -> dict:
            return {"chunk": part << 32 | number, "ids": ids, "langs": langs, "sizes": [len(t) for t in held], "payload": zstandard.ZstdCompressor(3).compress(b"".join(held)), "asked": np.unique(ngram_codes(held)).tolist()}

        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode()
                ids.append(batch.column(0)[i].as_py())
                langs.append(batch.column(2)[i].as_py())
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield closed()
                    number, ids, langs, held, size = number + 1, [], [], [], 0
        if held:
            yield closed()

    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"))
    return map_arrow(narrow, rows, "chunk bigint, ids array<bigint>, langs array<string>, sizes array<bigint>, payload binary, asked array<bigint>", 1)


def chunk_scores(texts: list[bytes], codes: np.ndarray, logp: np.ndarray) -> list[float | None]:
    """The mean log probability of each text's bytes; None for empty texts.

    The chunk's probabilities are laid out as a table of contexts by last byte; contexts are found by
    direct address after their bytes were renumbered without gaps. Where the table would have more than
    TABLE_CELLS cells (many scripts in one chunk), n-grams are found by binary search, a piece of the text at a time.
    """
    flat = ngram_codes(texts)
    if not len(flat):
        return [None] * len(texts)
    rank = np.zeros(256, np.int64)
    seen = np.unique(codes[:, None] >> (8 * np.arange(ORDER)) & 255)
    rank[seen] = np.arange(len(seen))

    def context(c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c), np.int64)
        for k in range(ORDER - 1, 0, -1):
            out = out * len(seen) + rank[c >> c.dtype.type(8 * k) & c.dtype.type(255)]
        return out

    contexts, place = np.unique(context(codes), return_inverse=True)
    if len(contexts) * len(seen) <= TABLE_CELLS:
        dense = np.zeros(len(seen) ** (ORDER - 1), np.int32)
        dense[contexts] = np.arange(len(contexts), dtype=np.int32)
        table = np.zeros((len(contexts), len(seen)), np.float64)
        table[place, rank[codes & 255]] = logp
        found = lambda part: table[dense[context(part)], rank[part & np.uint32(255)]]
    else:
        order = np.argsort(codes)
        known, values = codes[order].astype(np.uint32), logp[order]
        found = lambda part: values[np.searchsorted(known, part)]
    out: list[float | None] = []
    at = 0
    for t in texts:
        total = sum(float(found(flat[a : min(a + PIECE, at + len(t))]).sum()) for a in range(at, at + len(t), PIECE))
        at += len(t)
        out.append(total / len(t) if t else None)
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns (id, lang, n_bytes, perplexity), a row per document, per byte; null for null and empty texts.

    ``trusted`` holds the ids whose texts train the model. Without any, all bytes are equally likely. Null
    ids are never trusted; a null language is ``und``; repeated rows stay and count each time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    ids = scratch.keep(trusted.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct(), "trusted")
    good = _texts_of_ids(docs, ids, id_col, text_col)
    tables = model_tables(count_ngrams(good, "text"), scratch)
    name = f"timberline_chunks_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bucketed by chunk, so that the texts themselves need not move when the probabilities come.
    cut_chunks(docs, id_col, text_col, lang_col).write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", scratch.path("chunks")).saveAsTable(name)
    chunks = spark.table(name)
    asked = chunks.select("chunk", F.explode("asked").alias("g"))
    known = probabilities(scratch.keep(asked.select("g").distinct(), "asked"), tables, scratch)
    known = scratch.keep(known, "logp")
    answers = asked.join(known, "g").groupBy("chunk").agg(F.collect_list(F.struct("g", "logp")).alias("answers"))
    answers = answers.select("chunk", F.col("answers.g").alias("codes"), F.col("answers.logp").alias("logp"))
    both = chunks.select("chunk", "ids", "langs", "sizes", "payload").join(answers, "chunk", "left").select("ids", "langs", "sizes", "payload", "codes", "logp")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import zstandard

        for batch in batches:
            for r in range(batch.num_rows):
                numbers, langs, sizes = (batch.column(i)[r].as_py() for i in range(3))
                raw = zstandard.ZstdDecompressor().decompress(batch.column(3)[r].as_py()) if sum(sizes) else b""
                ends = np.cumsum(sizes).tolist()
                texts = [raw[b - n : b] for n, b in zip(sizes, ends, strict=True)]
                codes, logp = (batch.column(i)[r].values for i in (4, 5))
                empty = codes is None
                scores = chunk_scores(texts, np.zeros(0, np.int64) if empty else codes.to_numpy(), np.zeros(0) if empty else logp.to_numpy())
                for doc, lang, n, s in zip(numbers, langs, sizes, scores, strict=True):
                    yield {"_id": doc, "lang": lang, "n_bytes": n, "perplexity": None if s is None else float(np.exp(-s))}

    out = map_arrow(both, rows, "_id bigint, lang string, n_bytes bigint, perplexity double", 5000)
    return out.withColumnRenamed("_id", id_col)


def _texts_of_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the given ids. A Bloom filter of bounded size spares most others the shuffle; the join is exact.

    The ids grow with the corpus, so they are never broadcast, however few they are.
    """
    from timberline.llm.neardup import _bloom, _bloom_places

    words, bits = _bloom(ids, "id")
    held = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = held.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for i in range(3):
                p = batch.column(2 + i).to_numpy()
                hit &= (filled[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(pa.array(hit))

    key = F.col(id_col).cast("bigint")
    narrow = docs.where(F.col(id_col).isNotNull()).select(key.alias("id"), F.col(text_col).alias("text"), *(p.alias(f"_p{i}") for i, p in enumerate(_bloom_places(key, bits))))
    return narrow.mapInArrow(rows, "id bigint, text string").join(ids.hint("merge"), "id").select("text")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Returns (id, lang, n_bytes, perplexity, threshold, kept), a row per document.

    Trusted are documents labelled quality 1 and toxic 0 (null labels are not; of several labels the worst
    counts). A language without trusted documents has the threshold of all trusted ones; without any
    trusted document all texts are kept. Null and empty texts have no perplexity and are not kept.
    """
    marks = labels.groupBy(F.col(id_col).cast("bigint").alias(id_col)).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    trusted = marks.where("q = 1 and t = 0").select(id_col)
    scratch = Scratch(docs.sparkSession, "judged")
    trusted = scratch.keep(trusted, "trusted")
    scored = scratch.keep(perplexities(docs, trusted, id_col, text_col, lang_col), "scored")
    good = scored.where("perplexity is not null").join(trusted, id_col)
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by_lang = scratch.keep(good.groupBy("lang").agg(cut.alias("own")), "by_lang")
    overall = good.agg(cut.alias("c")).first()["c"]
    threshold = F.coalesce(F.col("own"), F.lit(overall).cast("double"), F.lit(float("inf")))
    out = scored.join(by_lang, "lang", "left").withColumn("threshold", threshold)
    return out.select(id_col, "lang", "n_bytes", "perplexity", "threshold", (F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))).alias("kept"))
