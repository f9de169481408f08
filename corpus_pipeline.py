"""A corpus from raw documents to packed sequences, as stages that each read what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and read again as the next one's
docs. All but the last return the columns they got, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import dart_minhash, langid, packing, substring, toxicity
from quillframe.llm.common import drop_scratch, materialize, table


def _beside_text(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one struct, so that none can clash with what a classifier adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _plain(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts stay unless an empty text scores so; repeated rows share a score."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return _plain(toxicity.score_texts(_beside_text(docs), model).where("score < 0.5"), docs)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null or without a letter, or whose language stays ambiguous, go; repeated rows share their fate."""
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(_beside_text(docs), model)
    return _plain(found.where((F.col("lang_pred") != langid.NONE) & ~F.col("ambiguous")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id stays, and one of rows with equal id and text.

    Of texts that share an id, the one of the smallest digest counts as the smallest. Null texts and those without words have no copies.
    """
    return dart_minhash.without_near_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id also holds are cut out, and n_chars follows; every document stays.

    Rows that share an id keep what they share; null texts and rows without an id stay as they are.
    """
    return substring.dedup_substrings(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text has the end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Of the tables that stages write in the shared folder, the last stage's input stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        docs = materialize(found)
        drop_scratch(found)  # what the stage before wrote, and tables of its own
    return STAGES[-1][1](spark, docs, sf_dir)
