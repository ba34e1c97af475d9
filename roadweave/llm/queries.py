"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ctw, langid, linededup, mainhtml, minhash, mixing, packing, runs, sharding, topk, vecdedup, vectorcodes, warc


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(common.table(spark, sf_dir, "documents"))


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = sharding.with_slots(placed.drop("text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(common.table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"))
    return warc.read_records(warc.read_chunks(files, data=False)).drop("uri")


def op9_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(common.table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mainhtml.main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.with_planted_runs(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_digest(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_mix_sources, op3_pack_documents, op4_top_k, op5_shard_documents, op6_near_vectors, op7_identify_language, op8_warc_round_trip, op9_dedup_lines, op10_score_documents, op11_main_text, op12_word_runs, op13_vector_codes)
}

ORACLES: dict[str, str] = {"op1_near_duplicates": minhash.near_duplicates_sql(75), "op4_top_k": topk.top_k_sql(100, 10), "op6_near_vectors": vecdedup.near_duplicates_sql(0.98), "op9_dedup_lines": linededup.line_cuts_sql(), "op13_vector_codes": vectorcodes.code_digest_sql()}
