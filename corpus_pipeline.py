"""Cleaning of a text corpus in stages, each a table written and read again.

Every stage takes the documents that the one before has kept, with all their columns, and does its whole work on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import language_id, minhash, packing, suffix_dedup, toxicity
from orrery.llm.common import held_out, stored, table
from orrery.llm.queries import tokenizer_path

#: A document is rejected if its language is unknown or less sure than this, and if it is toxic at least so surely.
SURE, TOXIC = 0.5, 0.7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Text and lang of the learning fold train the network.

    Every row is judged by its own text, also one of a null or repeated id; null texts and texts without letters go. An
    empty table stays empty. Columns of any name and type stay as they are.
    """
    return language_id.recognised(docs, language_id.fit(docs, ~held_out("doc_id")), SURE)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't find toxic. Labels of the learning fold train it.

    Every row is judged by its own text, also one of a null or repeated id; null and empty texts stay. An empty table
    stays empty. Columns of any name and type stay as they are.
    """
    return toxicity.clean_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id")), TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id; a null id only if the group has no other.

    Of rows that repeat id and text one stays; rows of one id and different texts are documents of their own. Texts
    without words are no duplicates of anything and all stay. An empty table stays empty. Columns of any name and type
    stay as they are.
    """
    found = minhash.near_duplicates(docs, size=5, similarity=80).filter("chosen")
    found = found.groupBy(F.col("doc_id").alias("_chosen_id"), F.col("text_hash").alias("_chosen_hash")).agg((F.count("*") * F.max(F.sign("n_shingles"))).alias("_repeats"))
    at = docs["doc_id"].eqNullSafe(found["_chosen_id"]) & (F.xxhash64(docs["text"]) == found["_chosen_hash"])
    both = docs.join(found, at)
    again = both.filter("_repeats > 1").dropDuplicates(["_chosen_id", "_chosen_hash"])
    return both.filter("_repeats <= 1").unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a repeated string of 200 covers; characters that a cut tears apart go too.

    No row goes; a null text becomes an empty one. Repeated rows remove each other's text. An empty table stays empty.
    Other columns, of any name and type, stay as they are, but for n_chars, which is counted anew.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, keep="text", carry=carry)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept")} | {c: F.col("carried").getField(c) for c in carry}
    return cut.select(*(made[c].cast(t).alias(c) for c, t in docs.dtypes))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=1, window=2048)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("minhash", one_of_each), ("suffix_dedup", without_repeats), ("packing", packed)]

#: No stage but the last can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
