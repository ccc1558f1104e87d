"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

All stages take documents with any further columns, whatever their names, and all but the last return the columns they get.
Empty tables give empty tables; texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, linededup, simhash
from tessera.llm.common import table, written
from tessera.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows go on; those without letters, or between languages, are rejected.

    A null or empty text has no letters and is rejected. Ties in loss are between languages. Repeated rows go on, or not, alike.
    Where no row has a lang to learn from, nothing can be told, and all documents go on.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs
    told = langid.identify(docs.withColumn("__tsr_row", F.struct("*")), model)
    return told.where(~F.col("ambiguous") & (F.col("lang_pred") != langid.UND)).select("__tsr_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate across sites are cut; n_chars is that of the text that is left.

    No row goes. A null text stays null; a null source is no site; a row with null doc_id never keeps the line. Rows that lose
    nothing keep their n_chars, null or wrong as it may be. Repeated rows are cut alike.
    """
    out = linededup.dedup_lines(docs)
    cut = F.col("lines_removed") > 0
    return out.select(*[F.when(cut, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Null, empty and blank texts have one fingerprint, and are one group. Of repeated rows with one doc_id, one stays. Rows with
    null doc_id all stay.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; so do all where there is no item. Repeated rows, and rows with null doc_id, are
    judged by their text.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens, as ids, and digests of these and of the text decoded from them.

    A null text has no tokens, as the empty one. No row goes. Columns that bear the names of these results are replaced.
    """
    out = bpe.tokens(docs, vocabulary_path())
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")], "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return written(STAGES[-1][1](spark, docs, sf_dir), "tokens")


#: Trained models, SimHash groups and merges have no SQL: tests hold run() against plain Python instead.
ORACLE_SQL = None
