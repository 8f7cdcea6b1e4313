"""The queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, table


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.chat import digest_conversations, format_conversations, turns_as_log

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"))
    formatted = Scratch(spark, "chat").keep(format_conversations(turns_as_log(turns)), "formatted")
    return digest_conversations(formatted)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Host, path and verdict of the rules that the query applies.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.url_rules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_chat": op3_chat,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_rules": op8_url_rules,
}

ORACLES: dict[str, str] = {}

ORACLES["op3_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 15 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op7_decontaminate"] = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bench WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)
), hits AS (SELECT p.doc_id, p.i, p.n, b.item FROM places p JOIN grams b ON p.n = b.n AND p.g = b.g),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit_words h ON l.doc_id = h.doc_id LEFT JOIN hit_items i ON l.doc_id = i.doc_id
"""

ORACLES["op8_url_rules"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r_host OR ends_with(h.host, '.' || r_host)) AND starts_with(h.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from timberline.llm.token_file import token_file_index, write_token_files

    scratch = Scratch(spark, "token_file")
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), scratch.path("files"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_file_index(spark, scratch.path("files"), scratch)


QUERIES["op1_token_file"] = op1_token_file


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from timberline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


QUERIES["op4_packing"] = op4_packing


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.secrets import find_secrets, secret_digests

    return secret_digests(find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.flac import store_media

    return store_media(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES |= {"op5_secrets": op5_secrets, "op6_flac": op6_flac}


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.langid import held_out, predict_languages, train, training_sample

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(training_sample(docs.where(~held_out())))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES["op2_langid"] = op2_langid


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES["op9_neardup"] = op9_neardup

ORACLES["op9_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * x >= 85 * (na.n + nb.n - x)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.node
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timberline.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES["op10_quality"] = op10_quality
