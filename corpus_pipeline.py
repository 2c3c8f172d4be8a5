"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

Stages but the last return the columns of documents. Each result is written as Parquet to the
shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, langid, minhash_dedup, packing, secrets
from gridloom.llm.common import stage, table
from gridloom.llm.queries import tokenizer_path

#: Posterior below which a text's language counts as undecided.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and texts whose language stays open; corrects nothing else.

    Repeated rows go or stay alike, a null id doesn't matter, words and texts of any length count
    whole, further columns keep their values whatever their names, and an empty table stays empty.
    """
    model = langid.fit(docs.select("text", "lang"), tokenizer_path("piece_bpe_32k.model"))
    judged = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    sure = (F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(sure).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near-duplicates; rows that repeat an id are one document.

    Null and empty texts and rows without an id stay, very long texts are compared whole, further
    columns stay whatever their names, and an empty table stays empty.
    """
    dropped = minhash_dedup.classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget.

    Null and empty texts and rows without an id stay, very long texts are searched whole, rows that
    repeat an id go together, null and empty items match nothing, further columns stay whatever their
    names, and an empty table of either kind drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mask; no document goes.

    Null and empty texts stay as they are, repeated rows change alike, very long texts are scanned
    whole, n_chars follows a changed text, further columns keep their values whatever their names, and
    an empty table stays empty.
    """
    model = secrets.fit(secrets.labelled_samples(docs))
    found = secrets.scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), model.ratios, model.least_mean)
    masked = found.select("row", "spans", secrets.redact(F.col("text"), F.col("spans")).alias("masked"))
    n_chars = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("masked"), "n_chars": n_chars}
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null texts are empty, rows without an id and repeated rows are packed as they are, very long texts
    are cut, further columns are dropped, and an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("sequence_packing", sequence_packing),
]

#: Piece probabilities, sketches and tokenizers have no SQL form; brute-force twins are in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
