"""Queries on texts and sparse vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens_sql
from ..operators import text as T
from ..session import cut, table


def _words(spark: SparkSession, folder: str, stop_words=STOP_WORDS) -> DataFrame:
    return T.tokenize(table(spark, folder, "documents"), stop_words=stop_words)


def _tf(spark, folder):
    return T.term_frequency(_words(spark, folder))


def _dv(spark, folder):
    return T.document_terms(table(spark, folder, "docvectors"))


def _rounded(df: DataFrame, column: str = "weight") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def _features(spark, folder):
    tf = cut(_tf(spark, folder), "tf")
    return T.features(tf, T.top_vocabulary(T.vocabulary_counts(tf), "ctf"), docs=table(spark, folder, "documents"))


QUERIES = {
    "corpus_summary": lambda s, d: T.corpus_summary(_dv(s, d)),
    "doc_first_stats": lambda s, d: T.first_document_stats(_dv(s, d)),
    "tokenize_documents": lambda s, d: _words(s, d, ()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_distinct")),
    "stopword_filter": lambda s, d: _words(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens")),
    "term_freq": _tf,
    "term_ctf": lambda s, d: T.vocabulary_counts(_tf(s, d)).select("token", "ctf"),
    "term_df": lambda s, d: T.vocabulary_counts(_tf(s, d)).select("token", "df"),
    "vector_ctf_df": lambda s, d: T.vocabulary_counts(_dv(s, d), "term"),
    "dictionary_words": lambda s, d: table(s, d, "termdict").filter("word IS NOT NULL").select("word", "term_id").distinct().join(T.vocabulary_counts(_dv(s, d), "term").withColumnRenamed("term", "term_id"), "term_id"),
    "vocab_topk_ctf": lambda s, d: T.top_vocabulary(T.vocabulary_counts(_tf(s, d)), "ctf"),
    "vocab_topk_df": lambda s, d: T.top_vocabulary(T.vocabulary_counts(_tf(s, d)), "df"),
    "features_bias": _features,
    "tfidf_ctf": lambda s, d: _rounded(T.tfidf(_dv(s, d), term="term", by="ctf")),
    "tfidf_df": lambda s, d: _rounded(T.tfidf(_tf(s, d))),
    "tfidf_df_floor": lambda s, d: _rounded(T.tfidf(_tf(s, d), floor=True)),
    "label_histogram": lambda s, d: T.label_histogram(table(s, d, "documents"), "stars"),
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_W = f"WITH w AS (SELECT doc_id, token FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) WHERE token NOT IN ({_STOP})), tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), v AS (SELECT token, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM tf GROUP BY token)"
_D = "WITH tf AS (SELECT doc_id, term, CAST(sum(freq) AS BIGINT) AS tf FROM (SELECT DISTINCT * FROM docvectors) WHERE doc_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY ALL), v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM tf GROUP BY term)"
_TOP = "SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS idx FROM (SELECT token FROM v ORDER BY {by} DESC, token LIMIT 4000)"

SQL = {
    "corpus_summary": _D + " SELECT count(DISTINCT doc_id) AS docs, CAST(sum(tf) AS BIGINT) AS words, count(DISTINCT term) AS terms, count(DISTINCT term) // count(DISTINCT doc_id) AS vocab_per_doc FROM tf",
    "doc_first_stats": _D + " SELECT doc_id, count(*) AS terms, count(*) FILTER (tf = 2) AS terms_with_freq FROM tf WHERE doc_id = (SELECT min(doc_id) FROM tf) GROUP BY doc_id",
    "tokenize_documents": f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY doc_id",
    "stopword_filter": _W + " SELECT doc_id, count(*) AS n_tokens FROM w GROUP BY doc_id",
    "term_freq": _W + " SELECT * FROM tf",
    "term_ctf": _W + " SELECT token, ctf FROM v",
    "term_df": _W + " SELECT token, df FROM v",
    "vector_ctf_df": _D + " SELECT term, ctf, df FROM v",
    "dictionary_words": _D + " SELECT word, term_id, ctf, df FROM (SELECT DISTINCT word, term_id FROM termdict WHERE word IS NOT NULL) JOIN v ON term = term_id",
    "vocab_topk_ctf": _W + " " + _TOP.format(by="ctf"),
    "vocab_topk_df": _W + " " + _TOP.format(by="df"),
    "features_bias": _W + f", k AS ({_TOP.format(by='ctf')}) SELECT doc_id, idx + 1 AS idx, CAST(count(*) AS DOUBLE) AS val FROM w JOIN k USING (token) GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, 0, 1.0 FROM documents",
    "tfidf_ctf": _D + " SELECT doc_id, term, round(tf * ln((SELECT count(DISTINCT doc_id) FROM tf) / ctf + 1), 6) AS weight FROM tf JOIN v USING (term)",
    "tfidf_df": _W + " SELECT doc_id, token, round(tf * ln((SELECT count(DISTINCT doc_id) FROM tf) / df + 1), 6) AS weight FROM tf JOIN v USING (token)",
    "tfidf_df_floor": _W + " SELECT doc_id, token, round(tf * ln((SELECT count(DISTINCT doc_id) FROM tf) // df + 1), 6) AS weight FROM tf JOIN v USING (token)",
    "label_histogram": "SELECT stars, count(*) AS n FROM documents GROUP BY stars",
}
