"""The registered training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import new_path, table
from parcelflow.llm.decontaminate import find_leaks
from parcelflow.llm.kmeans import center_digest, cluster
from parcelflow.llm.language import identify
from parcelflow.llm.line_dedup import dedup_lines
from parcelflow.llm.quality import classify
from parcelflow.llm.quotes import as_mail, chat_lines, link_quotes
from parcelflow.llm.repair import repair_report
from parcelflow.llm.secret_scan import find_secrets, span_digest
from parcelflow.llm.sentencepiece_bpe import tokenize
from parcelflow.llm.simhash import simhash_groups
from parcelflow.llm.substring_dedup import dedup_substrings
from parcelflow.llm.vectors import vector_groups
from parcelflow.llm.warc import read_chunks, read_records, write_archives


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks: pairs of a document and a benchmark item, with the edits between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify(docs, F.coalesce(~held_out, F.lit(False)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text under merge-dropout: their number, their digest, and whether they decode to it."""
    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256")
    return out.select("doc_id", "n_pieces", digest, "lossless")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, put into the form of mail threads, with their quotes linked and taken out again."""
    mail = as_mail(table(spark, sf_dir, "conversations"))
    out = chat_lines(link_quotes(mail))
    chat = F.sha2("chat", 256).alias("chat_sha256")
    return out.select("conv_id", "turn", "role", "copies", "n_quotes", "n_linked", "reply_to", "root_turn", "depth", chat)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written to the shared folder and read back, one row per record."""
    folder = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_records(read_chunks(spark, folder)).withColumnRenamed("id", "page_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that each document is bad or toxic, with its host and path; ``keep`` if neither is likely."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep_text=False)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every rule in every whole text; the base kinds are counted and digested apart."""
    return span_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return center_digest(cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, whose module lies at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_secret_scan": op11_secret_scan,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}
