"""Corpus statistics, vocabularies, features and TF-IDF weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..session import broadcast_if_small, cut

#: Features kept of a corpus by default.
VOCABULARY = 4000


def tokenize(texts: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", stop_words: Sequence[str] | DataFrame = STOP_WORDS) -> DataFrame:
    """``(doc_id, token)``, a row per occurrence, without stop words. A stop list may be a table ``(word)``; it is joined as an anti join."""
    words = texts.select(F.col(id_column).alias("doc_id"), F.explode(tokens(F.col(text_column))).alias("token"))
    if isinstance(stop_words, DataFrame):
        return words.join(stop_words.select(F.col("word").alias("token")).distinct(), "token", "left_anti").select("doc_id", "token")
    return words.filter(~F.col("token").isin(list(stop_words))) if stop_words else words


def term_frequency(words: DataFrame) -> DataFrame:
    """``(doc_id, token, tf)``."""
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary_counts(tf: DataFrame, term: str = "token") -> DataFrame:
    """``(term, ctf, df)``: occurrences in the collection and records holding the term."""
    return tf.groupBy(term).agg(F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df"))


def top_vocabulary(counts: DataFrame, by: str = "ctf", size: int = VOCABULARY) -> DataFrame:
    """``(token, idx)``: the ``size`` tokens of largest ``by`` (ties: token order), numbered from 0 in token order."""
    kept = counts.orderBy(F.desc(by), "token").limit(size)
    # at most ``size`` rows reach the numbering task
    return kept.withColumn("idx", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("token")) - 1).cast("int")).select("token", "idx")


def encode(words: DataFrame, dictionary: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The rows of ``words`` whose token is in the dictionary, with its ``idx`` in place of the token."""
    return words.join(broadcast_if_small(dictionary, size, 48), "token").drop("token")


def features(tf: DataFrame, dictionary: DataFrame, *, docs: DataFrame | None = None, bias: bool = True, size: int = VOCABULARY) -> DataFrame:
    """``(doc_id, idx, val)`` of ``tf(doc_id, token, tf)``: counts by feature, index 0 being the bias 1 of every document of ``docs``, others token index + 1."""
    counts = encode(tf, dictionary, size).select("doc_id", (F.col("idx") + 1).alias("idx"), F.col("tf").cast("double").alias("val"))
    if not bias:
        return counts
    of = (docs if docs is not None else tf).select("doc_id").distinct()
    return counts.unionByName(of.select("doc_id", F.lit(0).alias("idx"), F.lit(1.0).alias("val")))


def tfidf(tf: DataFrame, *, term: str = "token", by: str = "df", floor: bool = False, n_docs: int | None = None) -> DataFrame:
    """``(doc_id, term, weight)``: tf * ln(N / x + 1), x being the term's df or ctf (``by``); ``floor`` rounds N / x down first.

    N is the number of records in ``tf`` unless given; ``tf`` is then written once, since it is read three times.
    """
    if n_docs is None:
        tf = cut(tf, "tf")
        n_docs = tf.agg(F.count_distinct("doc_id")).first()[0]
    counts = vocabulary_counts(tf, term)
    ratio = F.lit(float(n_docs)) / F.col(by)
    weight = F.col("tf") * F.log((F.floor(ratio) if floor else ratio) + 1)
    return tf.join(counts, term).select("doc_id", term, weight.alias("weight"))


def document_terms(vectors: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)`` of sparse vectors: distinct rows with a term and a freq above 0, summed by record and term."""
    rows = vectors.filter(F.col("doc_id").isNotNull() & F.col("term").isNotNull() & (F.col("freq") > 0)).distinct()
    return rows.groupBy("doc_id", "term").agg(F.sum(F.col("freq").cast("long")).alias("tf"))


def corpus_summary(tf: DataFrame, term: str = "term") -> DataFrame:
    """One row: documents, words, distinct terms, and terms div documents."""
    s = tf.agg(F.count_distinct("doc_id").alias("docs"), F.sum("tf").alias("words"), F.count_distinct(term).alias("terms"))
    return s.withColumn("vocab_per_doc", F.try_divide(F.col("terms") - F.col("terms") % F.col("docs"), F.col("docs")).cast("long"))


def first_document_stats(tf: DataFrame, *, freq: int = 2) -> DataFrame:
    """One row for the smallest doc_id: its distinct terms, and those occurring ``freq`` times."""
    first = tf.agg(F.min("doc_id").alias("doc_id"))
    return tf.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("tf") == freq).alias("terms_with_freq"))


def label_histogram(rows: DataFrame, label: str) -> DataFrame:
    """``(label, n)``; null is a label like others."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
