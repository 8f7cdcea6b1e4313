"""URL filter: a sort-merge range join between URLs and host/path rules.

A host is keyed by its labels in reverse order (``blog.example.com`` -> ``com.example.blog.``; no label holds the separator), so the
hosts below a rule's host are one interval of the key order, and intervals of different rules are either
nested or disjoint. URLs are range-partitioned and sorted by that key; each partition sweeps once over
its URLs and the sorted rules, keeping the stack of rule hosts whose interval is open. A rule's
path prefixes are looked up by length at each level of the stack, and the longest fit wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ASCII_LOWER, ASCII_UPPER, map_arrow

#: Rules held by one sweep; a larger rule table is swept in several blocks of about this many.
RULES_PER_SWEEP = 200_000


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


@dataclass
class _Level:
    """The rules of one host: verdict and text by path prefix."""

    key: str
    paths: dict[str, tuple[str, str]] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)


def build_levels(rules: list[tuple[str, str, str]]) -> list[_Level]:
    """Rules (host, path, verdict) grouped by host in key order.

    Of two rules with equal host and path the one whose verdict sorts first (``allow``) holds.
    """
    levels: dict[str, _Level] = {}
    for host, path, verdict in sorted(rules):
        level = levels.setdefault(host, _Level(host_key(host)))
        level.paths.setdefault(path, (f"{host}{path}", verdict))
    for level in levels.values():
        level.sizes = sorted({len(p) for p in level.paths}, reverse=True)
    return sorted(levels.values(), key=lambda x: x.key)


def sweep(keys: Iterator[tuple[str, str]], levels: list[_Level]) -> Iterator[tuple[str, str] | None]:
    """For (key, path) pairs sorted by key: the longest rule that fits and its verdict, or None."""
    stack: list[_Level] = []
    upcoming = 0
    for key, path in keys:
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        while upcoming < len(levels) and levels[upcoming].key <= key:
            if key.startswith(levels[upcoming].key):
                stack.append(levels[upcoming])
            upcoming += 1
        best = None
        for level in stack:
            for size in level.sizes:
                if size <= len(path) and (found := level.paths.get(path[:size])):
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        yield best


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for a null URL or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), "^[^?#]*", 0))
    return df.withColumn("host", F.translate("host", ASCII_UPPER, ASCII_LOWER)).drop("_rest")


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Returns (id, host, path, rule, verdict), a row per input row.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the path starts with
    the rule's path, and the longest wins. Null rule fields count as empty; an empty host fits all
    hosts. Rows without a fit get rule null and the ``default`` verdict. Null and relative URLs have
    empty host and path. Repeated rows stay. Other input columns, whatever their names, are dropped.
    An empty table gives an empty result.
    """
    narrow = split_url(urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url").drop("_url")
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", "\\.", -1)), "."), F.lit(".")))
    # The path and the id are part of the range key: one host with a third of all rows is cut into many ranges.
    narrow = narrow.withColumn("_key", key).repartitionByRange("_key", "path", "_id").sortWithinPartitions("_key", "path")
    rules = rules.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")))
    n_rules = rules.count()
    blocks = max(1, -(-n_rules // RULES_PER_SWEEP))
    kind = urls.schema[id_col].dataType.simpleString()
    out = narrow.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    for b in range(blocks):
        part = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b)
        out = _swept(out, [tuple(r) for r in part.collect()], kind)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")


def _swept(df: DataFrame, rules: list[tuple[str, str, str]], kind: str) -> DataFrame:
    levels = build_levels(rules)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pending: list[dict] = []

        def keys() -> Iterator[tuple[str, str]]:
            for batch in batches:
                for row in batch.to_pylist():
                    pending.append(row)
                    yield row["_key"], row["path"]

        for best in sweep(keys(), levels):
            row = pending.pop()
            if best and (row["rule"] is None or len(best[0]) > len(row["rule"])):
                row["rule"], row["verdict"] = best
            yield row

    return map_arrow(df, rows, f"_id {kind}, host string, path string, _key string, rule string, verdict string", 5000)
