"""The queries opN_<name> over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, licenses, lines, manifest, media, mixing, neardup, pitman_yor, quality, secrets, toxicity, warc
from .common import crc_bucket, shared_folder, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_bundles(warc.revisits(table(spark, sf_dir, "pages")), path)
    bundles = spark.read.schema(warc.BUNDLES).parquet(path)
    return warc.described(warc.read_bundles(bundles))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), bpe.default_path(), ["doc_id"], decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 3) != 1)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 5) != 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.verdicts(quality.statistics(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"), ["doc_id"])
    return media.described(media.fingerprint(stored), ["doc_id"])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]), ["doc_id"])


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


# The columns of four operators that SQL can express, from the same operators.

def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secrets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_lines": op5_lines,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_minhash": op9_minhash,
    "op10_secrets": op10_secrets,
    "op11_fim": op11_fim,
    "op12_licenses": op12_licenses,
    "op13_manifest": op13_manifest,
    "licenses_base": licenses_base,
    "quality_base": quality_base,
    "media_payload": media_payload,
    "secrets_counts": secrets_counts,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN NULL ELSE last END AS refers_to
        FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000""",
    "op5_lines": lines.ORACLE,
    "quality_base": """
        WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
        g AS (SELECT doc_id, i, ws[i:i + 7] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, range(8) r(k) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        s AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words
              FROM w LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s""",
    "media_payload": """
        WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, strlen(COALESCE(text, '')) AS n_bytes FROM documents), p AS (SELECT *, greatest(64, (n_bytes + 63) // 64 * 64) AS payload_bytes FROM d)
        SELECT doc_id, n_bytes, payload_bytes, sha256(text || repeat(chr(0), payload_bytes - n_bytes)) AS payload_sha256 FROM p""",
    "secrets_counts": f"""
        WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(text, '({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
               len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d""",
    "op9_minhash": neardup.ORACLE,
    "op11_fim": fim.ORACLE,
    "op13_manifest": manifest.oracle(),
    "licenses_base": licenses.ORACLE_BASE,
}
