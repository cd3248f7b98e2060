"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=0.85)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.substrings import removed

    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm import warc

    return warc.read_warc(warc.convert(warc.write_arc(table(spark, sf_dir, "pages")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.lines import report

    found = report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A run of two or more lines with a word is the union of its windows of two.
LINE_RUNS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
w AS (SELECT doc_id, k, line, lead(line) OVER o AS line2, lead(k) OVER o AS k2 FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, k, k2, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, k) AS n FROM w WHERE line2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k2)) AS k FROM f WHERE n > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_removed, string_agg(CASE WHEN g.k IS NULL THEN line END, chr(10) ORDER BY l.k) AS rest
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm import tokenfiles

    return tokenfiles.read(tokenfiles.write(table(spark, sf_dir, "documents"), tokenizer_path()), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judged(docs, quality.learned(docs, table(spark, sf_dir, "labels")), "q")
    return found.select("doc_id", *[f"q.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")])


#: In op7 and the pipeline: the first quarter of a document's ids is its prompt, without loss; fewer loss-bearing tokens than tokens.
LOSS_TOKENS, PROMPT_SHARE = 1664, 0.25


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.packing import Limits, pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), Limits(loss_tokens=LOSS_TOKENS), prompt_share=PROMPT_SHARE).drop("ids")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.scoring import score

    return score(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklex.llm.decontamination import report

    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_line_runs": LINE_RUNS}
