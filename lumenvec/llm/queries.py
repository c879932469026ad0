"""The queries op1_* to op10_* and pipeline, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup, media, ngramjoin, oracles, packing, pii, quality, substring, suffixdedup, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = media.parse_sequences(media.document_html(docs), "doc_id", keep=("n_bytes",)).where("kind = 'image'")
    features = media.media_features(media.store_media(media.payloads(docs)))
    return media.resolve(items, features).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removed_lines(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_bpe_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring.removed_spans(substring.repeated_units(table(spark, sf_dir, "documents")))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return spans.select("doc_id", "n_units", "n_chars", text.alias("spans"), F.array_min("kept_ids").alias("kept_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_media, op3_line_dedup, op4_decontamination, op5_warc, op6_packing, op7_quality,
        op8_ngram_join, op9_suffix_dedup, op10_substring_dedup, pipeline,
    )
}

#: The others have no SQL: they fit models, search by edits, tokenise, make images or match spans with checksums.
ORACLES: dict[str, str] = {"op3_line_dedup": oracles.OP3, "op5_warc": oracles.OP5, "op8_ngram_join": oracles.OP8, "op9_suffix_dedup": oracles.OP9}
