"""A training corpus from documents: toxicity filter, language filter, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspark.llm import bpe, langid, mixing, simhash, toxicity
from fieldspark.llm.common import crc_bucket, ensure_checkpoint_dir, fresh, table

#: Texts of this score or more go.
TOXIC = 0.3
#: Texts of which no language has this part of the letters go.
MIXED = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC by a model of the labels whose crc32 modulo 4 is not 2.

    Null and empty texts score as no evidence and stay; long texts are scored whole; repeated rows are judged alike; labels of
    null ids or values are not learnt from; an empty table stays empty.
    """
    (score,) = fresh(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 4) != 2))
    return toxicity.score(docs, model, out=score).filter(F.col(score) < TOXIC).drop(score)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which a language has at least MIXED, by a model of those whose crc32 modulo 5 is not 0.

    Null and empty texts and those without a letter go; of long texts all words count; repeated rows are judged alike; rows
    of null language are judged but not learnt from; without any language to learn, and so in an empty table, none stays.
    """
    (found,) = fresh(docs, "language")
    model = langid.fit(docs.filter(crc_bucket("doc_id", 5) != 0))
    keep = (F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= MIXED)
    return langid.predict(docs, model, out=found).filter(keep).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate component.

    Null ids stay only where a component has no other; ties of one id go by a hash of the row; repeated rows are one; null and
    empty texts are near-duplicates of each other; long texts are read whole; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its shards' order: a row for each time that a document is drawn; n_chars follows a text drawn in part.

    Null and empty texts are never drawn; null sources are one source; repeated rows are drawn alike; long texts are drawn whole,
    but for the last of a source; an empty table stays empty.
    """
    return mixing.appearances(docs, mixing.mix(docs)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every row.

    Null and empty texts have no ids; long texts are encoded whole; nulls elsewhere and repeated rows stay; an empty table
    stays empty.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Learned models and hash order have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between them is written to the session's checkpoint folder. A stage's table goes once
    the next one is written; the last remains, as the result reads it."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}-{name}")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
            if before:
                _remove(spark, before)
            before = f"{home}/{k}-{name}"
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
