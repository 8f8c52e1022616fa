"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gifmedia, html_extract, ngram_join, packing, pseudonyms, quality, repeats, toxicity, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.repeated_bytes(_table(spark, sf_dir, "documents"))
    # A cut can fall inside a character, so the kept text has U+FFFD there; the digest is of the bytes.
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_report(_table(spark, sf_dir, "documents"), pseudonyms.session_key(spark))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary()), vocabulary(), digests=True)


#: In chain order: category -> expression over the labels table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), CATEGORIES))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), scratch=Scratch(spark, "warc"))
    read = warc.read_archives(spark, archives)
    return read.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", warc.page_number("refers_to").alias("refers_to"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gifmedia.media_digests(gifmedia.to_media(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_packing, op3_html, op4_suffix_dedup, op5_quality, op6_pii, op7_bpe, op8_toxicity, op9_warc, op10_gif)
}

SQL: dict[str, str] = {"op1_ngram_join": ngram_join.sql(4, 85), "op5_quality": quality.SQL, "op9_warc": warc.SQL}
