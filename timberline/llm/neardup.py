"""Near-duplicate documents by bottom-k sketches of one hash function, with exact verification.

1. Each text becomes its set of hashed word shingles; documents with equal sets are one class.
2. A class whose few smallest hashes hardly occur elsewhere cannot have a link and goes no further.
3. Inverted lists of the retained (k smallest) hashes generate pairs. A link shares at least T of the k smallest
   hashes of the union, so it suffices that each class enters the lists of its k - T + 1 rarest ones.
4. Pairs from short lists are filtered by the estimate from the union's sketch, then verified on full sets.
   In long lists each member is verified against a few pivots first, and what these link is contracted. Only
   members of different components are compared further: in blocks, by one exact matrix product for a pair of
   blocks, of which only a spanning forest leaves the task. So a group of copies costs as much as it has members.
5. Links are contracted to components by alternating stars.

T comes from the binomial tail: at the threshold similarity a pair shares fewer than T with a probability of at
most MISS; classes with no more than k shingles are compared by exact bounds. Hashes have 63 bits, and equal
hashes count as equal shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow, texts_of

#: Words of a shingle.
SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Retained hashes of the first filter, of the inverted lists, and of the estimate.
FIRST_K, LIST_K, ESTIMATE_K = 32, 256, 64
#: Probability that a link at the threshold shares fewer than T retained hashes.
MISS = 1e-10
#: Lists with more classes are compared in blocks of about BLOCK classes and BLOCK_HASHES hashes.
LONG_LIST, BLOCK, BLOCK_HASHES = 40, 400, 131_072
#: Members of a long list that all others are verified against first, and pairs of one pivot for each copy of its set.
PIVOTS, PIVOT_PAIRS = 3, 500
#: Bits of the Bloom filter for classes whose sets are wanted; at most this many, whatever the input.
BLOOM_BITS = 1 << 27

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P))), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P_INVERSE))), dtype=np.uint64)
        return cls.up, cls.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of ``[^\\x20\\x09-\\x0D]+`` after A-Z were lower-cased.

    A word's hash is the difference of two prefix sums of byte values times powers of the base, shifted to
    the word's start; all words of a text are hashed at once.
    """
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes (63 bits); with fewer words, but not none, the whole sequence is one shingle."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    width = min(size, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h * _P + words[i : len(words) - width + 1 + i])
    h >>= np.uint64(1)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))].view(np.int64)


def fewest_shared(k: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The largest T such that a pair at the threshold shares fewer than T of k retained hashes with probability of at most ``miss``."""
    p, total = percent / 100, 0.0
    for t in range(k + 1):
        total += comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > miss:
            return max(1, t)
    return k


def shared_at_least(n, k: int, percent: int = PERCENT):
    """T as a column: by exact bounds for sets of up to k hashes, else by ``fewest_shared``.

    A set of n <= k hashes is its own sketch. A partner has at most n * 100 / percent hashes, and those
    beyond k are not retained.
    """
    exact = F.ceil(n * percent / 100.0 - 1e-9) - F.greatest(F.floor(n * 100 / percent + 1e-9) - k, F.lit(0))
    return F.when(n <= k, F.greatest(exact, F.lit(1))).otherwise(F.lit(fewest_shared(k, percent))).cast("int")


def fingerprint(found: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, size: int, key_col: str | None = None) -> DataFrame:
    """(id, key, n, cls, sketch): another column, set size, a fingerprint of the set, and its FIRST_K smallest hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, texts in texts_of(batch, "_text"):
                for i, text in enumerate(texts, at):
                    found = shingle_set(text, size)
                    yield {"_id": ids[i], "key": keys[i], "n": len(found), "cls": fingerprint(found), "sketch": found[:FIRST_K].tolist()}

    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.col(key_col or id_col).cast("bigint").alias("_key"))
    return map_arrow(narrow, rows, "_id bigint, key bigint, n bigint, cls binary, sketch array<bigint>", 2000)


def _candidates(reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(rep, cls) of the reps of which at least T retained hashes occur in another class too."""
    each = reps.select("rep", "n", F.explode("sketch").alias("v"))
    common = scratch.keep(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"), "common")
    shared = each.join(common, "v").groupBy("rep", "n").agg(F.count("*").alias("shared"))
    found = shared.where(F.col("shared") >= shared_at_least(F.col("n"), FIRST_K, percent)).select("rep").distinct()
    return scratch.keep(reps.select("rep", "cls").join(found, "rep"), "candidates")


def _bloom(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A Bloom filter of bounded size as 64-bit words, built by an aggregate over its words."""
    count = ids.count()
    bits = min(BLOOM_BITS, 1 << max(12, (16 * max(count, 1) - 1).bit_length()))
    places = F.explode(F.array(*_bloom_places(F.col(column), bits))).alias("p")
    words = ids.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(bits >> 6, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint64), bits


def _bloom_places(column, bits: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(seed), column), F.lit(bits)).cast("bigint") for seed in (1, 2, 3)]


def _sets_of(docs: DataFrame, wanted: DataFrame, scratch: Scratch, id_col: str, text_col: str, size: int) -> DataFrame:
    """(rep, n, hashes) of the wanted (rep, cls). The texts are read again where they lie; the Bloom filter spares most of them.

    What the filter lets through by chance leaves in the join with the wanted ones. The sets are the largest table of
    all, so they are kept in the form that all later steps read.
    """
    words, bits = _bloom(wanted, "rep")
    held = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        filled = held.value
        for batch in batches:
            places = [batch.column(2 + i).to_numpy() for i in range(3)]
            hit = np.ones(batch.num_rows, bool)
            for p in places:
                hit &= (filled[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for i in np.flatnonzero(hit).tolist():
                found = shingle_set(batch.column(1)[i].as_py(), size)
                if len(found):
                    yield {"rep": batch.column(0)[i].as_py(), "cls": fingerprint(found), "n": len(found), "hashes": found.tolist()}

    ids = F.col(id_col).cast("bigint")
    narrow = docs.where(F.col(id_col).isNotNull()).select(ids.alias("rep"), F.col(text_col).alias("_text"), *(p.alias(f"_p{i}") for i, p in enumerate(_bloom_places(ids, bits))))
    found = map_arrow(narrow, rows, "rep bigint, cls binary, n bigint, hashes array<bigint>", 200)
    # A repeated id has a set for each of its texts; its class's text is the one that counts, and once.
    return scratch.keep(found.join(wanted, ["rep", "cls"]).dropDuplicates(["rep", "cls"]).select("rep", "n", "hashes"), "sets")


def _listed(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(v, rep, n): each rep in the lists of its rarest retained hashes."""
    retained = F.least(F.col("n"), F.lit(LIST_K))
    each = sets.select("rep", "n", F.explode(F.slice("hashes", 1, LIST_K)).alias("v"))
    counts = scratch.keep(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "list_sizes")
    known = each.join(counts, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Hashes that occur once come first in the order from rare to common, and lead to no pair.
    room = retained - shared_at_least(F.col("n"), LIST_K, percent) + 1 - (retained - F.size("vs"))
    known = known.select("rep", "n", "vs", room.cast("int").alias("room")).where("room > 0")
    return scratch.keep(known.select("rep", "n", F.explode(F.slice("vs", F.lit(1), F.col("room"))).alias("s")).select("s.v", "rep", "n"), "listed")


def _alike_sizes(a, b, percent: int):
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def _short_links(listed: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    a, b = listed.select("v", F.col("rep").alias("a"), F.col("n").alias("na")), listed.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = scratch.keep(a.join(b, "v").where((F.col("a") < F.col("b")) & _alike_sizes(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), "pairs")
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    return _verified(pairs.join(left, "a").join(right, "b"), percent)


def _verified(both: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, na, ha, b, nb, hb) that are links: the union's sketch filters, the full sets decide."""
    ka, kb = F.slice("ha", 1, ESTIMATE_K), F.slice("hb", 1, ESTIMATE_K)
    union = F.slice(F.sort_array(F.array_union(ka, kb)), 1, ESTIMATE_K)
    hits = F.size(F.array_intersect(F.array_intersect(ka, kb), union))
    likely = (F.least("na", "nb") <= ESTIMATE_K) | (hits >= fewest_shared(ESTIMATE_K, percent))
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(likely).where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _pivot_links(long: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links between the members of long lists (v, rep, n) and PIVOTS members of each.

    Pivots come from one order for all lists, so a group of copies has the same ones in all of its lists. The sets of
    a pivot with many pairs are copied, and its pairs dealt to the copies.
    """
    order = [F.xxhash64(F.lit(i), F.col("rep")) for i in range(PIVOTS)]
    pivots = long.groupBy("v").agg(F.array_distinct(F.array(*(F.min_by("rep", o) for o in order))).alias("ps")).select("v", F.explode("ps").alias("b"))
    pairs = long.join(pivots, "v").where("rep <> b").select(F.col("rep").alias("a"), F.col("n").alias("na"), "b").distinct()
    pairs = scratch.keep(pairs, "pivot_pairs")
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_PAIRS).cast("int").alias("copies"))
    right = copies.join(sets, copies["b"] == sets["rep"]).select("b", "copies", F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies", "na")
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    both = dealt.join(left, "a").join(right, ["b", "copy"]).where(_alike_sizes(F.col("na"), F.col("nb"), percent))
    return scratch.keep(_verified(both, percent), "pivot_links")


def block_forest(reps: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT, component: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different sides (of all members if there is one side).

    Members of one ``component`` are not compared.

    Intersections are a product of 0/1 matrices over the hashes that at least two members have.
    """
    m = len(reps)
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[place] > 1
    owner, place = owner[often], place[often]
    _, place = np.unique(place, return_inverse=True)
    shared = np.zeros((m, m), np.float32)
    step = max(1, (1 << 22) // max(m, 1))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, width, step):
        a, b = np.searchsorted(place, [at, at + step])
        part = np.zeros((m, min(step, width - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        shared += part @ part.T
    inter = np.rint(shared).astype(np.int64)
    linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    if component is not None:
        linked &= component[:, None] != component[None, :]
    np.fill_diagonal(linked, False)
    out, seen = [], np.zeros(m, bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero(linked[at] & ~seen)
            seen[fresh] = True
            out.extend((reps[at], reps[k]) for k in fresh.tolist())
            todo.extend(fresh.tolist())
    return out


def _long_links(long: DataFrame, sets: DataFrame, known: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links within long lists (v, rep, n) between members of different components (node, root) that are ``known``.

    Of each list, the members outside its largest component meet each other and that component, in blocks;
    a list of one component has no such members. Blocks of others come first in the numbering.
    """
    named = long.join(known, long["rep"] == known["node"], "left").select("v", "rep", "n", F.coalesce("root", "rep").alias("component"))
    named = scratch.keep(named, "named_lists")
    parts = named.groupBy("v", "component").agg(F.count("*").alias("m"), F.sum("n").alias("hashes"))
    largest = F.max(F.struct("m", "component", "hashes")).alias("top")
    parts = parts.groupBy("v").agg(largest, F.sum("m").alias("m"), F.sum("hashes").alias("hashes")).where(F.col("m") > F.col("top.m"))
    count = lambda m, hashes: F.greatest(F.ceil(m / BLOCK), F.ceil(hashes / BLOCK_HASHES)).cast("int")
    others, first = count(F.col("m") - F.col("top.m"), F.col("hashes") - F.col("top.hashes")), count(F.col("top.m"), F.col("top.hashes"))
    parts = scratch.keep(parts.select("v", F.col("top.component").alias("top"), others.alias("others"), first.alias("first")), "open_lists")
    rows = named.join(parts, "v").withColumn("in_top", F.col("component") == F.col("top"))
    block = F.when(F.col("in_top"), F.col("others") + F.pmod(F.xxhash64("rep", "v"), F.col("first"))).otherwise(F.pmod(F.xxhash64("rep", "v"), F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("in_top"), F.col("others")).otherwise(F.col("others") + F.col("first")) - 1)
    rows = rows.select("v", "rep", "component", block.alias("mine"), F.explode(met).alias("other"))
    units = rows.select("v", "rep", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"))
    full = units.join(sets.select("rep", "hashes"), "rep")

    def forest(group: pa.Table) -> pa.Table:
        data = group.column("hashes").combine_chunks()
        if isinstance(data, pa.ChunkedArray):
            data = pa.concat_arrays(data.chunks)
        ends = data.offsets.to_numpy()
        values = data.values.to_numpy()
        members = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        edges = block_forest(group.column("rep").to_pylist(), members, np.array(group.column("side").to_pylist(), bool), percent, group.column("component").to_numpy())
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return full.groupBy("v", "i", "j").applyInArrow(forest, "a bigint, b bigint")


def find_links(docs: DataFrame, reps: DataFrame, scratch: Scratch, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b): links between reps; all of those from short lists, a spanning forest of each pair of blocks from long ones."""
    wanted = _candidates(reps, scratch, percent)
    sets = _sets_of(docs, wanted, scratch, id_col, text_col, size)
    listed = _listed(sets, scratch, percent)
    sizes = scratch.keep(listed.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    short = listed.join(sizes.where(F.col("m") <= LONG_LIST).select("v"), "v")
    links = scratch.keep(_short_links(short, sets, scratch, percent), "short_links")
    long = scratch.keep(listed.join(sizes.where(F.col("m") > LONG_LIST).select("v"), "v"), "long_lists")
    if not long.isEmpty():
        links = links.unionByName(_pivot_links(long, sets, scratch, percent))
        known = components(links, scratch, "known")
        links = links.unionByName(_long_links(long, sets, known, scratch, percent))
    return scratch.keep(links.distinct(), "links")


def components(links: DataFrame, scratch: Scratch, what: str = "") -> DataFrame:
    """(node, root): the smallest node reachable, for nodes that have links; by alternating large and small stars.

    Each round joins the edges with the least neighbour of each node, written before, so the edges of a hub
    can be split between tasks.
    """
    least_first = lambda a, b: (F.least(a, b).alias("root"), F.greatest(a, b).alias("node"))
    edges = scratch.keep(links.where("a <> b").select(*least_first("a", "b")).distinct(), f"{what}edges0")
    state, turn = None, 0
    while True:
        turn += 1
        both = edges.select(F.col("node").alias("u"), F.col("root").alias("w")).unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("w")))
        low = scratch.keep(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), f"{what}large{turn}")
        large = scratch.keep(both.where("w > u").join(low, "u").select(F.col("m").alias("root"), F.col("w").alias("node")).where("root <> node").distinct(), f"{what}wide{turn}")
        low = scratch.keep(large.groupBy(F.col("node").alias("u")).agg(F.min("root").alias("m")), f"{what}small{turn}")
        joined = large.withColumnRenamed("node", "u").join(low, "u")
        small = joined.select(F.col("m").alias("root"), F.col("root").alias("node")).where("root <> node").unionByName(low.select(F.col("m").alias("root"), F.col("u").alias("node")))
        new = scratch.keep(small.distinct(), f"{what}edges{turn}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first()
        scratch.drop(f"{what}edges{turn - 1}", f"{what}large{turn}", f"{what}wide{turn}", f"{what}small{turn}")
        edges = new
        if now == state:
            return edges.select("node", "root")
        state = now


def _decided(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, key_col: str | None = None) -> DataFrame:
    """(_id, key, n, linked, component) of each row; ``linked`` rows have shingles and an id."""
    scratch = Scratch(docs.sparkSession, "neardup")
    sketched = scratch.keep(sketch_documents(docs, id_col, text_col, size, key_col), "sketched")
    linked = (F.col("n") > 0) & F.col("_id").isNotNull()
    usable = sketched.where(linked)
    classes = scratch.keep(usable.groupBy("cls").agg(F.min("_id").alias("rep")), "classes")
    first = usable.join(classes, "cls").where(F.col("_id") == F.col("rep")).select("rep", "cls", "n", "sketch").dropDuplicates(["rep", "cls"])
    reps = scratch.keep(first, "reps")
    roots = components(find_links(docs, reps, scratch, id_col, text_col, size, percent), scratch)
    named = scratch.keep(classes.join(roots, classes["rep"] == roots["node"], "left").select("cls", F.coalesce("root", "rep").alias("component")), "named")
    out = sketched.select("_id", "key", "n", linked.alias("linked"), F.when(linked, F.col("cls")).alias("cls")).join(named, "cls", "left")
    return out.select("_id", "key", "n", "linked", F.coalesce("component", "_id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Returns (id, n_shingles, component_id, kept), a row per input row.

    Documents are linked if their shingle sets have 100 * intersection >= percent * union; the component is the
    smallest id reachable. Null and wordless texts have no shingles and are linked with nothing. Rows
    with a null id are linked with nothing either and keep a null component (kept is false). Equal rows
    share a component and are kept or dropped together; of rows with one id and different texts each has the
    component of its text. An empty table gives no rows. Other columns, whatever their names, are dropped.
    """
    out = _decided(docs, id_col, text_col, size, percent)
    kept = F.coalesce(F.col("_id") == F.col("component"), F.lit(False))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, and of that id the least text hash.

    Rows with one id and different texts are documents of their own here, so each text stays or goes by itself (a hash
    of id and text names them; two of n have the same with a probability of n * n / 2**65). Of equal rows one stays
    (of those that differ in other columns, the least by these). Rows without an id or without shingles, null
    texts among them, all stay. An empty table gives an empty one; columns keep names and order.
    """
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text_col)))
    named = docs.select(node.alias("_node"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    decided = _decided(named, "_node", "_text", size, percent, "_key").where("linked").groupBy("component", "_id").agg(F.count("*").alias("rows"), F.min("key").alias("key"))
    scratch = Scratch(docs.sparkSession, "dropped")
    decided = scratch.keep(decided, "decided")
    first = decided.groupBy("component").agg(F.min(F.struct("key", "_id")).alias("first"))
    marked = decided.join(first, "component").select(F.col("_id").alias("_m_node"), "rows", (F.col("_id") == F.col("first._id")).alias("_m_stays")).where("NOT _m_stays OR rows > 1")
    marked = scratch.keep(marked.select("_m_node", "_m_stays"), "marked")
    out = docs.join(marked, node == marked["_m_node"], "left_anti")
    again = marked.where("_m_stays")
    if not again.isEmpty():
        again = docs.join(again, node == again["_m_node"], "left_semi")
        one = again.groupBy(node.alias("_m_node")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_m_row"))
        out = out.unionByName(one.select("_m_row.*"))
    return out
