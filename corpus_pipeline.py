"""From raw documents to a tokenised mixture: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Stages are written as Parquet to the
shared folder and read again, so that each starts from true sizes and a lost executor costs tasks
of one stage only. The language model learns, the others count and compare over their whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, language_id, line_dedup, minhash, mixing
from newsloom.session import arrow_batches, materialize

#: No stage after the first has an SQL form that meets the model's decisions; see tests/llm.
ORACLE_SQL = None


#: Texts that go to the network at once.
BATCH_BYTES = 4_000_000
#: Texts whose words are encoded at once.
BLOCK_BYTES = 16_000_000


def packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row beside them: no name of a table's own can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters, or scored too low by the network for their length.

    Where there is nothing to learn from, documents with letters stay. Every document is predicted once:
    the thresholds come from the predictions of all held-out ones.
    """
    network = language_id.learn(docs)
    if not network.labels:
        network = language_id.Network(["any"], {})
    predicted = language_id.predict(packed(docs), network).select("document", "lang_pred", "score")
    with arrow_batches(spark, BATCH_BYTES):
        predicted = materialize(predicted, "language-predicted")
    predicted = predicted.select("document", "document.doc_id", "document.text", "document.lang", "lang_pred", "score")
    score = language_id.least_score(language_id.thresholds(predicted, network))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= score)
    return predicted.filter(known).select("document.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that another document holds first out of the texts; n_chars follows the text."""
    cut = line_dedup.cut_lines(packed(docs), line_dedup.open_store(docs))
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[own.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents with 80 % of their five-word shingles in common."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target weight; a source repeated in a second epoch has its rows twice."""
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes whole texts and decodes them again: token counts and digests per document."""
    return bpe.round_trip(docs, BLOCK_BYTES)


STAGES = [
    ("language", keep_known_languages),
    ("lines", cut_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
