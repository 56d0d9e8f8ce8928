"""A training-corpus pipeline: classify, drop repeated lines, drop near copies, mix sources, tokenise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import cotraining, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from larkspur.llm.common import discard, durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns beyond COLUMNS under names that no stage uses, and what gives them their own names back."""
    more = [c for c in docs.columns if c not in COLUMNS]
    named = docs.select(*COLUMNS, *[F.col(f"`{c}`").alias(f"extra {i}") for i, c in enumerate(more)])
    return named, lambda out: out.select(*COLUMNS, *[F.col(f"`extra {i}`").alias(c) for i, c in enumerate(more)])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts (a probability of 0.5 or more).

    Null texts, sources, languages and ids are judged like others; rows that repeat are judged alike. Without
    labels of both classes all stay. Extra columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d, back = _apart(docs)
    return back(cotraining.with_scores(d, labels).where("_p >= 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; those left without a word go.

    Rows that repeat an id are one document. Null ids keep their lines; null and empty texts stay as they are.
    n_chars is counted anew. Extra columns pass through.
    """
    d, back = _apart(docs)
    out = line_dedup.drop_lines(d).withColumn("n_chars", F.char_length("text").cast("long"))
    return back(out.where(F.col("_n_dropped").eqNullSafe(0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles or more): that of smallest id.

    Of rows that repeat id and text one stays; of an id with several texts only the copies go. Null ids and
    texts without words stay. Extra columns pass through.
    """
    d, back = _apart(docs)
    return back(minhash_dedup.keep_one(d, width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; null is a source of its own.

    Copies are decided by id and text alone, so reruns and repeated rows agree. Documents of a source
    without words have no copies. Extra columns pass through.
    """
    d, back = _apart(docs)
    return back(mixing.emit(d))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with `ids`, their SentencePiece ids, `n_tokens`, and `round_trip`: whether decoding gives the text back.

    Null text is encoded as the empty one. Extra columns pass through but those of these three names.
    """
    d, back = _apart(docs.drop("ids", "n_tokens", "round_trip"))
    out = sentencepiece_codec.tokenized(d, ids_col="ids", decoded_col="decoded")
    out = out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))))
    names = back(d).columns
    return out.select(*[F.col(c).alias(n) for c, n in zip(out.columns, names, strict=False)], "ids", "n_tokens", "round_trip")


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("MinHash near-dedup", drop_copies), ("source mixing", mix_sources), ("SentencePiece", tokenize)]

#: The stages learn, hash and tokenise: SQL has no words for them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, "stage")
            discard(before)  # no later stage reads it
    return docs
