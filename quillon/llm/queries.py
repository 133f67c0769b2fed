"""The queries opN_<name> over whole tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, iblt, langid, licenses, linededup, lm, mixing, packing, simhash, warc
from .common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"))
    matches = F.transform("matches", lambda m: F.concat_ws(":", m["n"], m["of_doc"], m["of_n"]))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.length("text").alias("n_chars_kept"), F.md5("text").alias("text_md5"), F.array_join(matches, " ").alias("matches"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(coalesce(url, '')) AS u FROM pages),
h AS (SELECT page_id, u, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
        regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#]*)([^#]*)', 1) AS host,
        regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#]*)([^#]*)', 2) AS rest FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest AS urlkey,
  strftime(make_timestamp((1577836800 + page_id % 315360000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM f"""


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op5_iblt": op5_iblt, "op8_licenses": op8_licenses, "op7_lm": op7_lm, "op6_warc": op6_warc, "op4_linededup": op4_linededup, "op10_mixing": op10_mixing, "op1_compression": op1_compression, "op3_langid": op3_langid, "op9_packing": op9_packing, "op2_simhash": op2_simhash}
ORACLE_SQL = {"op8_licenses": licenses.oracle_sql(), "op6_warc": OP6_SQL}
