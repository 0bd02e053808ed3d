"""A corpus pipeline of four stages: language, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of documents, and no others.

Defined cases of all stages: texts are read whole, however long; an empty table gives an empty result; equal rows
are treated alike; columns whose names an operator uses for its results are kept as they came. Nulls, ties and
repeated rows are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidenza.llm.common import Scratch, arrow_batches, table
from evidenza.llm.language_id import UNKNOWN, held_out, identify, train
from evidenza.llm.ngram_join import ngram_join
from evidenza.llm.packing import pack_documents
from evidenza.llm.pii import redact

#: A document goes whose main language has less than this share of its words, or that has no letters.
LEAST_SHARE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing label is filled in with what was found.

    Null text and text without a letter go. Equal shares go to the language first in order; repeated rows stay as
    often as they stand. Where no document has a label, nothing can be learned, and only those without a letter go.
    """
    arrow_batches(spark)
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    if not model.labels:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    found = identify(docs.withColumnsRenamed({"lang_pred": "_1", "score": "_2"}), model)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    kept = kept.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"_1": "lang_pred", "_2": "score"}).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id. Rows without doc_id stay.

    Different texts that share a doc_id are documents of their own, told apart by a hash of both; of rows with equal
    id and text one stays. Of several texts with the smallest doc_id of a group, the one with the smallest hash stays.
    Null, empty and blank texts are near to nothing and stay.
    """
    arrow_batches(spark)
    keyed = docs.filter("doc_id is not null").withColumn("_row", F.xxhash64("doc_id", "text"))
    found = ngram_join(keyed.select(F.col("_row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = keyed.select("_row", "doc_id").distinct()
    first = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row")
    named = keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
    return named.union(docs.filter("doc_id is null").select(docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as often as they stand, personal data masked; null text stays null, n_chars is counted anew."""
    arrow_batches(spark)
    masked = redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as often as they stand, as pieces of token sequences, with their places; null text packs as empty.

    Ties between pieces of equal length are broken by doc_id, piece and start.
    """
    import public_tokenizers

    arrow_batches(spark)
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express none of the stages but the second; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
