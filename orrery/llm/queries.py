"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, html_extract, language_id, media, minhash, packing, prefix_trie, quality, suffix_dedup, topk, toxicity, url_filters
from .common import held_out, stored, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, window=2048)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=200)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, similarity=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return toxicity.score_documents(docs, lexicon).withColumn("held_out", held_out("doc_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, ~held_out("doc_id"))).withColumn("held_out", held_out("doc_id"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    def head(conv: F.Column) -> F.Column:
        return F.crc32(conv.cast("string").cast("binary")) % 6

    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 100, head, longest_head=5)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.statistics(table(spark, sf_dir, "documents")))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = quality.fit(described, table(spark, sf_dir, "labels"), ~fold)
    return quality.score(described, model, threshold=0.3).withColumn("held_out", fold)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_html_extract": op7_html_extract,
    "op8_bpe": op8_bpe,
    "op9_topk": op9_topk,
    "op10_media": op10_media,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality": op12_quality,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filters": url_filters.oracle(URL_RULES), "op9_topk": topk.ORACLE, "op11_prefix_trie": prefix_trie.sql(), "op13_hard_negatives": hard_negatives.ORACLE}
