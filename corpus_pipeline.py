"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the shared folder
and reads it back for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credal.llm import line_dedup, mixing, ngram_join, packing, quality
from credal.llm.queries import fit_quality, table, tokenizer_path
from credal.llm.runtime import materialise
from credal.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the allowed labelled rows of this stage's own input.

    Null text is scored as empty, rows of a null id are never fitted on; equal texts fare alike, so do repeated rows. A score of exactly
    0.5 stays. Columns of any name are kept. An empty table, or one without labelled rows, loses nothing.
    """
    ship(spark)
    model = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).where("score >= 0.5").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; no document goes, so one of each copy stays whole.

    Null text stays null, of equal ids the smaller hash is first, repeated rows are cut alike. Columns of any name are kept, n_chars follows
    the text. An empty table stays empty.
    """
    ship(spark)
    return line_dedup.dedup(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "n_chars")).select(
        *[F.col(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`") for c in docs.columns]
    )


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays: the smallest id.

    Null and empty texts link with nothing and stay, so do null ids. Of the rows that repeat an id one stays, with the smallest text by
    hash. Columns of any name are kept. An empty table stays empty.
    """
    ship(spark)
    groups = ngram_join.link(docs, width=5, percent=80)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text", *docs.columns).alias("hash"))
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("other"))
    left = rows.join(gone, F.col("id") == F.col("other"), "left_anti")
    single = left.join(again, F.col("id") == F.col("other"), "left_anti").select("row")
    several = left.join(again, F.col("id") == F.col("other"), "left_semi").groupBy("id").agg(F.min_by("row", "hash").alias("row"))
    return single.unionByName(several.select("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; those of small sources are repeated, up to two passes.

    Null text has no words and stays once, a null source is a source, null ids and repeated rows are rows like others, and equal ids of a
    source are kept or left together. Columns of any name are kept. An empty table stays empty.
    """
    ship(spark)
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), target_entropy=1.0, max_epochs=2.0)
    return mixed.select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2,048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty, and an empty text is its end token; null ids and repeated rows are packed like others; which of equally long pieces
    goes first is open. Further columns are ignored. An empty table gives no pieces.
    """
    ship(spark)
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", join_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: The classifier, the joins and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
