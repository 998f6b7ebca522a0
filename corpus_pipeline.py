"""The corpus pipeline: language ID, quality, near-dedup, secret redaction, packing.

Every stage takes the session, the documents its predecessor kept and the folder of the given
tables. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atrium.llm import language_id, near_dup, packing, quality, registry, secrets
from atrium.scratch import Scratch

#: A document stays if one language has at least this share of it.
LEAST_SHARE = 0.5


def identify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without a language, or without one that has half of the text.

    The model learns from all rows with a label; a null or letterless text is dropped. All columns stay
    as they are, and ``lang``, where it is null, is filled with the prediction.
    """
    names = docs.columns
    model = language_id.fit_language_model(docs)
    found = language_id.identify_languages(docs, model, columns=())
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    columns = [F.coalesce("doc.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in names]
    return kept.select(*columns)


def assess(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that the quality scorer rejects; null and wordless texts are among them.

    A score at the threshold is kept. Repeated rows are scored alike and all stay or go; their texts train once. With no
    clear text of either class, as in an empty table, the labellers' posterior is the score.
    """
    scored = quality.score_quality(docs, quality.fit_quality(docs))
    return scored.where("kept").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8).

    The smallest doc_id of a group stays; of rows that repeat it the first by text. Null and wordless texts and rows
    with a null doc_id are in no group and stay. An empty table stays empty.
    """
    return near_dup.keep_one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace the secrets in every text; all documents stay, repeated rows too.

    A null text stays null, an empty table empty. Of words that equally many texts hold, the first by letters ranks first.
    """
    return secrets.redact_secrets(docs, ranks=secrets.word_ranks(docs))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Tokenize and pack what is left into sequences of 2048 tokens.

    A null or empty text is one piece of one id; repeated rows are packed each; of equal costs the earlier sequence, of
    equal pieces the earlier one goes first. An empty table gives no piece.
    """
    return packing.pack_documents(docs, registry.vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify),
    ("quality_classifier", assess),
    ("minhash_near_dedup", dedup),
    ("secret_scans", redact),
    ("packing", pack),
]

#: SQL has no form for expectation-maximisation, trained scorers or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
