"""Corpus pipeline: language ID, shingle near-duplicates, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm import langid, mixing, pieces, shingles
from clausegraph.llm.runtime import apart, checkpoint_root, crc_of, cut, small, stage

#: A text stays if its language is known with at least this posterior.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of an identified language (not ``und``, posterior of LEAST_SCORE or more). Null, empty and letterless
    texts go; null ids are learned from like crc 0, that is not at all; repeated rows stay; columns keep names and values."""
    docs, back = apart(docs, ("doc_id", "text", "lang"))
    model = langid.fit(docs.where(crc_of("doc_id") % langid.FOLDS != 0))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of texts that are linked by a five-word shingle similarity of 0.8 or more, verified on
    the whole texts: the row with the smallest doc_id, a null one last, then by text and by the other columns. Classes
    without ids, and texts that share an id, each keep their row; null and wordless texts are one class."""
    docs, back = apart(docs, ("doc_id", "text", "lang", "source"))
    rows = stage(shingles.with_nodes(docs))
    heads = cut(shingles.classes(rows))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"), F.xxhash64(*docs.columns), F.col("row")]
    narrow = rows.select("row", "node", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("place"))
    classed = cut(narrow.join(heads, "node", "left").select("row", "place", F.coalesce("head", "node").alias("head")))
    first = classed.groupBy("head").agg(F.min("place").alias("first"))
    gone = cut(classed.join(first, "head").where(F.col("place") != F.col("first")).select("row"))
    return rows.join(small(gone, gone.count()), "row", "left_anti").select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources reach their target weights. Wordless texts have size 0 and are not taken; a
    null source is a source; rows with one id, source and size share their number of copies."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document, with the digests of ids and of the decoded text; a null text is an empty one."""
    return pieces.encode(docs, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{number}-{name}")
        docs = spark.read.parquet(path)
    return docs


#: Language scores and merge encoding have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None
