"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import decontaminate, language, lines, near_dups, packing
from voxelframe.llm._store import written
from voxelframe.llm.queries import table, word_bpe


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those that no learned language can be told of go, null and empty texts among them.

    Each row is judged by its own whole text, so repeated rows stay or go together; equal scores go to the language first by name.
    """
    found = language.identify(docs, language.fit(docs))
    return found.where("lang_pred <> 'und'").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, and their new lengths; every document stays, null and empty texts as they are.

    Of a recurring line the first stays, by doc_id and place. Texts are taken whole, however long; rows of one doc_id are told apart by their texts, and identical rows keep
    or lose the same lines. An empty table gives an empty one, and columns of any other name are carried along.
    """
    found = lines.drop_template_lines(docs, depth=4, least_docs=3, literal=0.7)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; texts without words are in no group.

    Rows of one doc_id with different texts are judged apart. Identical rows, with one doc_id and one text, are one document here and stay or go together.
    """
    found = near_dups.near_duplicates(docs, size=5, percent=75)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    same = (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h"))
    return _keyed(docs).join(gone, same, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs; null and empty texts stay, and identical rows stay or go together."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    return _keyed(docs).join(hit, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of at most 4096 ids.

    Only longer documents are cut. Each row is packed, identical ones too; a null or empty text is one piece with the end id. Which of several equally good places a piece gets is open.
    """
    return packing.pack_documents(docs, word_bpe(), end_id=1, capacity=4096, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage reads what the one before it wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a fitted model and a packing have no SQL; tests compare each stage with brute force
