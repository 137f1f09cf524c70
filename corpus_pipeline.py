"""A training corpus from ``documents`` in five stages, each of which reads what the one before it wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import delete, scratch, shared_dir, staged
from tessella.llm.exact_dedup import identities
from tessella.llm.ngram_join import ngram_links
from tessella.llm.packing import Capacity, pack_documents
from tessella.llm.quality import accepted
from tessella.llm.secret_scan import redacted


#: The name of the key that tells rows apart within a stage; no column of ``documents`` has it.
_ROW = "row_of_stage"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, written so that the key stays the same whenever it is read."""
    return staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "keyed")


def _only(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is in ``kept``, without the key; a merge join, as the keys grow with the rows."""
    return keyed.join(kept.select(_ROW).hint("merge"), _ROW, "left_semi").drop(_ROW)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts, those with a null or repeated id too; each is scored in place.

    Null and empty texts are scored like a text without words; long texts are read whole; of equal rows all stay or
    go; an empty table gives an empty one.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, one with the largest id; a null id stays only where no other row has the text.

    Rows of one id are judged apart; of those that share id and text one stays. A null text counts as empty. Texts of
    any length are compared whole; an empty table gives an empty one.
    """
    keyed = _keyed(docs)
    named = identities(keyed, F.col(_ROW), F.col("text"), {"doc_id": F.col("doc_id")})
    best = F.max(F.struct("doc_id", "key"))  # nulls sort below all ids
    return _only(keyed, named.groupBy("n_blocks", "name").agg(best.alias("best")).select(F.col("best.key").alias(_ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row with the smallest id; a null id stays only in a group without others.

    Rows of one id are judged apart: they are near copies only if their texts are. Null and empty texts, and those
    without words, are near copies of none and stay. An empty table gives an empty one.
    """
    keyed = _keyed(docs)
    links = ngram_links(keyed, id_col=_ROW, width=5, percent=80).select(F.col("doc_id").alias(_ROW), "component_id")
    known = links.join(keyed.select(_ROW, "doc_id"), _ROW)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", _ROW))
    return _only(keyed, known.groupBy("component_id").agg(best.alias("best")).select(f"best.{_ROW}"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, also those with a null or repeated id, with secrets masked; ``n_chars`` follows the new text.

    Null and empty texts stay as they are, with a null text's ``n_chars`` too; texts of any length are scanned whole.
    """
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return redacted(docs).withColumn("n_chars", F.coalesce(count, F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, also those with a null or repeated id, packed into sequences of 2048 ids.

    A null or empty text is one id; longer texts than a sequence are cut; an empty table gives no pieces.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), Capacity(tokens=2048))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    What the operators stage is deleted once a stage is written, and a stage's rows once the next one has read them;
    the last stage's table is the result and stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
