"""Five stages over ``documents``: language, near-duplicates, benchmark passages, secrets, packing.

Each stage gets what its predecessor wrote and works on all of it. The first three drop documents, the fourth
replaces secrets in texts, the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.llm.common import Scratch, discarding, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or whose prediction is rejected."""
    from timberline.llm.langid import drop_rejected, held_out, train, training_sample

    return drop_rejected(docs, train(training_sample(docs.where(~held_out()))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies: five-word shingles, a similarity of 0.8 or more."""
    from timberline.llm.neardup import drop_near_duplicates

    return drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    from timberline.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts."""
    from timberline.llm.secrets import redact_secrets

    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all texts into sequences; a row per piece."""
    import public_tokenizers

    from timberline.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminate),
    ("secrets", remove_secrets),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what each returns is written, and read again by the next.

    A stage's own scratch tables go once its result is written, and that result once the next stage's is.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with discarding(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
