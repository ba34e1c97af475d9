"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import common, langid, linededup, minhash, mixing, packing


#: With fewer different n-grams than this a text without any hit is too short to judge, and stays.
LEAST_GRAMS = 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found, or too short to judge; those without letters go, and longer ones without any n-gram of any language.

    Null and empty texts have no letters, and go.  Null lang, source and
    doc_id don't matter; repeated rows are judged each for itself, alike.  An
    empty table stays empty; other columns come along.
    """
    found = langid.identify(docs, n_grams=True).where(f"lang_pred <> 'und' and (score > 0 or n_grams < {LEAST_GRAMS})")
    return found.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines, n_chars brought up to date; documents that lose all their lines go.

    Null texts stay.  Of equal windows the first by (doc_id, text hash, line)
    stays, null doc_ids first; repeated rows are one document and edited
    alike.  An empty table stays empty; other columns come along.
    """
    edited = linededup.dedup_lines(docs).where("n_removed = 0 or text <> ''")
    return edited.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Repeated rows leave one; texts without words are linked with nothing, and
    stay; rows without doc_id stay once for each text.  An empty table stays
    empty; other columns come along.
    """
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each draw of a document, so that sources meet their target weights.

    A null source is a source of its own, texts without words are drawn with
    their block, repeated rows alike.  An empty table stays empty; other
    columns come along.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in full sequences.

    A null text is one end token; null doc_ids stay null; repeated rows, as
    mixing makes them, are packed each.  An empty table gives no pieces; other
    columns are left out.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Filters, mixing and token packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written before the next stage reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"pipeline-{k}")
    return docs
