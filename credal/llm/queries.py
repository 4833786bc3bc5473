"""The registered queries of this subpackage: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, line_dedup, mixing, neighbours, ngram_join, packing, quality, token_counts, token_io
from .runtime import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The contract's additional conversation.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def crc_remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def fit_quality(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """A fit on the labelled rows that the contract allows: crc32 of the id as text modulo 3 is not 1. A null id has none."""
    return quality.fit(docs.where(crc_remainder() != 1), labels.where(crc_remainder() != 1))


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_remainder() == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, target_entropy=0.97, max_epochs=4.0)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "slot")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.edited_fingerprints(table(spark, sf_dir, "documents"), percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select(
        "doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", "first_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op9_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    written = token_io.write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), vocabulary=50257, end_id=0).collect()
    return token_io.read(spark, path, written).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under three edits: a deletion in the middle, a replacement in the first quarter, an addition at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    made = lambda at, delete, insert: F.struct(at.cast("long").alias("position"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    edits = F.array(made(n / 2, 40, ""), made(n / 4, 7, " new words,"), made(n, 0, "\nAn added line."))
    return token_counts.count_edited(docs.withColumn("edits", edits), tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id", "n_tokens", "n_edits", "edited_tokens", "edited_chars", "encoded_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_format, op2_ann_search, op3_ngram_join, op4_packing, op5_quality_qda, op6_mixing, op7_spotsigs, op8_line_dedup, op9_token_io, op10_token_counts)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Only for what SQL expresses over whole tables; the others are tested against brute force."""
    return {
        "op1_chat_format": f"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
            ), e AS (
                SELECT *, regexp_replace(text, '<\\|(\\\\*)(im_start|im_end)\\|>', '<|\\\\\\1\\2|>', 'g') AS escaped FROM t
            )
            SELECT conv_id, count(*)::BIGINT AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                sum(length(role) + length(escaped) + 24)::BIGINT AS formatted_chars,
                sum(CASE WHEN escaped <> text THEN 1 ELSE 0 END)::BIGINT AS n_escaped
            FROM e GROUP BY conv_id""",
        "op2_ann_search": """
            WITH v AS (
                SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                GROUP BY vec_id
            ), p AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                    list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
                FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            )
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
            WHERE rank <= 5""",
    }
