"""Line dedup: lines that several documents hold stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, keyed_ordinal, lower_ascii, rank_of, text_of


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with lists ``lines`` and ``kept_lines``, ``n_lines``, ``n_dropped`` and the joined ``kept``.

    Lines are exploded as 128-bit hashes of their keys with the document's id. For each hash the
    smallest and the largest id and a count are combined before the shuffle, so a line that all
    documents hold costs a row per task. Only the hashes to drop meet the documents' own (AQE splits a
    hot hash), and come back as one set per document, by which the text is filtered in place.

    A null or empty text is one empty line. Keys shorter than min_chars are never dropped. A null
    doc_id sorts last. Rows of one doc_id count as one document and each keeps its lines or loses them
    alike. Extra columns pass through; helper columns give way to names that exist.
    """
    ord_, drop, lines, kl, nl, nd, kept = fresh(docs, "ord", "drop", "lines", "kept_lines", "n_lines", "n_dropped", "kept")
    split = lambda: F.split(text_of(), "\n", -1)
    long_keys = docs.select(keyed_ordinal().alias("o"), F.explode(F.array_distinct(F.transform(split(), line_key))).alias("key")).where(F.length("key") >= min_chars)
    keys = long_keys.select("o", F.unhex(F.md5("key")).alias("k"))
    if min_docs == 2:
        shared = keys.groupBy("k").agg(F.min(rank_of("o")).alias("lo"), F.max(rank_of("o")).alias("hi")).where("lo < hi")
    else:
        shared = keys.select(rank_of("o").alias("o"), "k").distinct().groupBy("k").agg(F.min("o").alias("lo"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    gone = keys.join(shared.select("k", "lo"), "k").where(rank_of("o") > F.col("lo")).groupBy("o").agg(F.collect_set("k").alias(drop)).withColumnRenamed("o", ord_)
    out = docs.withColumn(ord_, keyed_ordinal()).join(gone, ord_, "left")
    stays = lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col(drop), F.unhex(F.md5(line_key(x))))
    out = out.withColumn(lines, split()).withColumn(kl, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.filter(F.col(lines), stays)))
    return out.withColumns({nl: F.size(lines).cast("long"), nd: (F.size(lines) - F.size(kl)).cast("long"), kept: F.array_join(kl, "\n")}).drop(ord_, drop)
