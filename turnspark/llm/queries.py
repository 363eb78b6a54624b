"""One registered query for each operator, over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from turnspark.llm import (
    decontaminate,
    langid,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    prefix_trie,
    quality_rules,
    sharding,
    simhash,
    url_filter,
    vector_codes,
    warc,
)
from turnspark.llm import sql as twins
from turnspark.llm.registry import QUERIES, SQL, query
from turnspark.llm.tables import table


PIECES = "piece_bpe_32k.model"
TOKENS = "word_bpe_49k.json"


@query("op3_simhash_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line of the corpus."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENS))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("file", "place")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law of near equal bytes."""
    found = sharding.assigned(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.page_labels(pages, table(spark, sf_dir, "labels")))


@query("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, written to an archive and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op11_ngram_jaccard_join", twins.NGRAM_JOIN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).drop("file", "place")


@query("op12_conversation_prefix_trie", twins.PREFIX_TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all rebuilt conversations."""
    turns = prefix_trie.rebuilt(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns).drop("path", "parent")


@query("op13_vector_code_compression", twins.VECTOR_CODES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


__all__ = ["QUERIES", "SQL"]
