"""The corpus pipeline: documents through five of the operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, line_dedup, ngram_join, pieces, toxicity
from quarry.llm.common import Workspace, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the rest as they were.

    Null and empty texts score as empty ones, equal texts alike; null and repeated ids are no matter. Without
    documents or labels nothing goes but by a constant score. Extra columns stay.
    """
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the texts and their lengths are new, a null text stays null.

    An empty text stays empty, and a document whose lines all go stays with an empty text. Null ids come last;
    rows of one id keep a line or lose it alike. No documents, no rows. Extra columns stay.
    """
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return out.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, null ids last, ties by text.

    Null and empty texts and those of white space stay all; of equal rows one stays. Extra columns stay.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows alike; null and empty texts stay. Extra columns stay."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and the scores of the four best segmentations.

    Null and empty texts have no ids; every row stays, with all its columns.
    """
    return pieces.encode(docs, pieces.vocabulary()).drop("others")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
