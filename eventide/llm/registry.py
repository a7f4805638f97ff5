"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe_table, centroids, chat, divergence, exact_dedup, langid, line_dedup, merkle, packing, simhash, token_counts, url_rules, warc
from eventide.llm.base import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    net = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs, net, held_out=held_out)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    log = chat.message_events(_table(spark, sf_dir, "conversations")).union(chat.message_events(extra))
    return chat.read_back(chat.format_conversations(log))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.round_trip_documents(_table(spark, sf_dir, "documents"))


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialise(warc.write_archives(_table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(chunks)


#: Fixed by contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, doc_id, label of pages whose document is labelled; a page's document is the number in its URL. Toxic or of low quality: block."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.select("doc_id", F.when(bad, url_rules.BLOCK).otherwise(url_rules.ALLOW).alias("label"))
    return pages.select("page_id", "url", url_rules.document_number(F.col("url")).alias("doc_id")).join(known, "doc_id")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    mined = url_rules.mine(labelled_pages(pages, _table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, URL_RULES, mined)


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_chunks", "removed_chunks", "removed_chars")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_language_id, op2_chat_format, op3_bpe_roundtrip, op4_warc_roundtrip, op5_merkle_fingerprints, op6_exact_dedup, op7_packing,
    op8_url_rules, op9_line_dedup, op10_simhash, op11_token_counts, op12_centroid_clusters, op13_source_divergence,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_SPACE = "'[ \\t\\n\\x0b\\f\\r]+'"

ORACLES: dict[str, str] = {
    "op4_warc_roundtrip": warc.ORACLE,
    "op5_merkle_fingerprints": merkle.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_centroid_clusters": centroids.oracle(),
    "op13_source_divergence": divergence.ORACLE,
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SPACE}, ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
