"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a table; run() writes each
one as Parquet in the shared folder and reads it again for the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklex.llm import decontamination, lines, neardup, packing, quality
from sparklex.llm.queries import LOSS_TOKENS, PROMPT_SHARE, table, tokenizer_path
from sparklex.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a learned rule rejects go. The rules are learned from docs and the labels beside them."""
    name = next(n for n in (f"quality_{k}" for k in range(len(docs.columns) + 1)) if n not in [c.lower() for c in docs.columns])
    rules = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules, name).where(f"{name}.kept").drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines, and of single lines of MIN_WORDS words, are cut out; documents of which nothing is left go."""
    return lines.deduplicated(docs, min_words=lines.MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) that with the smallest id stays."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that occur in windows of benchmark items are cut out."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids."""
    return packing.pack(docs, tokenizer_path(), packing.Limits(loss_tokens=LOSS_TOKENS), prompt_share=PROMPT_SHARE)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Near-duplicates and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
