"""The operators on the test tables, one query each, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import (
    alignment, chat, conversation_repair, decontamination, jaccard, language_id, license_scan, packing, quality,
    secrets, substring_dedup, token_files, toxicity,
)
from fleetlens.llm.common import bucket, table
from fleetlens.session import shared_folder

SEQUENCE_IDS = 4096
TOXIC_SCORE = 0.7


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(buckets: int, rest: int):
    return F.coalesce(bucket("doc_id", buckets) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels, bucket("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(3, 1), "score", predicted, "evidence", "passages")


def learned_language(docs: DataFrame):
    return language_id.learn_dictionaries(docs, bucket("doc_id", 4) != 2)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), learned_language(docs))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", "margin", "rejected")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *base, "base_failed", "kept", "posterior")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_components(table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "token-files")
    token_files.write_token_files(
        table(spark, folder, "documents"), out, tokenizer_path("byte_bpe_50k.json"), 2
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
         ("ids_crc32", pa.int64())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], schema=schema
            )

    rows = token_files.read_token_files(spark, out)
    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.token_packing(docs, tokenizer_path("word_bpe_49k.json"), 1, SEQUENCE_IDS)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["doc_id", "start", "n_chars", "secret_sha256", "probability", "is_secret"]
    return secrets.scan(table(spark, folder, "documents")).select(columns)


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(table(spark, folder, "conversations"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, folder, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_words", "n_removed", digest)


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.drop("matches")


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    paths = [tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment(docs, *paths)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversation_repair.report(conversation_repair.damaged(turns), turns, "copies")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
_WORDS = r"""
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"

SQL: dict[str, str] = {
    "op5_jaccard_join": f"""
        WITH RECURSIVE words AS ({_WORDS.format(text=_LOWERED)}),
        runs AS (
          SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS s
          FROM words, unnest(range(1, greatest(len(w) - 1, 2))) t(k) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
        links AS (
          SELECT p.a, p.b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM runs x JOIN runs y ON x.s = y.s AND x.doc_id < y.doc_id
            GROUP BY 1, 2) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
          WHERE 100 * c >= 90 * (m.n + n.n - c)),
        either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a)
        SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.b) AS component_id
        FROM words w JOIN reach r ON r.a = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY 1, 2""",
    "op10_substring_dedup": f"""
        WITH words AS ({_WORDS.format(text="text")}),
        edges AS (
          SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS s
          FROM words, unnest(range(1, len(w) - 18)) t(k) WHERE len(w) >= 20),
        again AS (
          SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS rn FROM edges)
          WHERE rn > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(k, k + 20)) t(p)),
        placed AS (SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) t(p)),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
          FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(text, '')) AS kept_sha256
        FROM words w LEFT JOIN kept USING (doc_id)""",
    "op11_license_scan": license_scan.sql(),
}
