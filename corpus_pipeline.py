"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language ID drops documents without a language; near-dedup keeps one document of each group; decontamination drops copies of
benchmark items; mixing brings sources to their target weights; the last stage writes token ids and returns their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as _clean
from graphloom.llm import language_id, mixing, near_dedup, repair_tokens
from graphloom.llm.common import TEXTS, bundled, materialise, table, unbundled


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a language is recognised (those without any letter are rejected). Each row is judged by its own text:
    rows with a null doc_id are judged too, and of a repeated doc_id only the rows without a language go."""
    known = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(bundled(docs), *known, carry=["given", "text"]).filter("lang_pred <> 'und'")
    return unbundled(found, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id (null comes last; equal doc_ids by a hash of text, lang
    and source, and rows that are equal in these as they come). Rows, not doc_ids, are compared: rows of a repeated or null doc_id
    stay if their texts aren't near duplicates, and so do all rows without words."""
    rows = materialise(bundled(docs), "dedup-given", TEXTS)
    told = [F.col("text"), *(F.col(f"given.`{c}`") for c in ("lang", "source") if c in docs.columns)]
    judged = near_dedup.by_row(rows.select("row", F.col("given.doc_id").cast("long").alias("doc_id"), F.xxhash64(*told).alias("tie"), "text"))
    return unbundled(rows.join(judged.filter("first").select("row"), "row", "left_semi"), docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark. Each row is judged by its own text, whatever its doc_id; rows without text stay."""
    return _clean.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix, by row and pass. Sources that are above their target lose blocks of words, others are taken up to
    twice; rows without words go. A row is a document of its own, whatever its doc_id; a null source is a source."""
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token shards: doc_id, start, n_tokens, ids_crc32, a row for each row of docs. A null doc_id sorts first, rows
    of one doc_id by text; null and empty texts hold the end id only."""
    return repair_tokens.read_tokens(repair_tokens.write_tokens(docs))


STAGES = [
    ("language_id", detect_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_copies),
    ("mix_sources", mix_sources),
    ("token_output", write_token_ids),
]
#: Hashed draws, language models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run_counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """The result, and (stage, rows before, rows after) for each stage. Tables are written anyway, so rows are counted from their footers."""
    docs, counts = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = counts[-1][2] if counts else docs.count()
        docs = materialise(stage(spark, docs, sf_dir), name)
        counts.append((name, before, docs.count()))
    return docs, counts


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_counted(spark, sf_dir)[0]
