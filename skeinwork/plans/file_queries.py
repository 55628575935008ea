"""Queries that write a table in a text format by its sink and read it back by its reader, whole and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import text as T
from ..operators import topk
from ..sources import files, sinks
from ..session import cut, scratch_path, table
from . import graph_queries as G
from .ratings_queries import ITEM, RATINGS_SQL, USER, ratings
from .text_queries import _D, _TOP, _W


def _ratings_with_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Clean ratings in the order of their lines, with a prediction from a fixed formula."""
    r = ratings(spark, folder)
    return r.select("pos", "user_id", "item_id", "score", ((F.col("user_id") * 7 + F.col("item_id") * 3) % 41 / 10.0 + 1).alias("predicted"))


def _zipped(spark, folder) -> DataFrame:
    """The query, prediction and gold files of the ratings, written and zipped line by line."""
    r = cut(_ratings_with_gold(spark, folder), "predicted")
    pairs, predicted, gold = (scratch_path(spark, n) for n in ("pairs", "predicted", "gold"))
    sinks.write_lines(r, pairs, F.concat_ws(",", "item_id", "user_id"), ["pos"])
    sinks.write_scores(r, predicted, "predicted")
    sinks.write_scores(r, gold, "score")
    return files.zipped(spark, pairs, predicted, gold)


def _letor(spark, folder):
    """Scores of some pairs joined back to the query file, 0 for the others."""
    r = cut(_ratings_with_gold(spark, folder), "predicted")
    path = scratch_path(spark, "letor")
    sinks.write_letor(r.filter("score >= 3").withColumn("score", F.col("predicted")), path, r)
    return files.values(spark, path).select("pos", F.round("value", 6).alias("value"))


def _user_pairs(spark, folder):
    path = scratch_path(spark, "user-pairs")
    rows = table(spark, folder, "train").filter("movieid IS NOT NULL AND userid IS NOT NULL").select("pos", "movieid", "userid").distinct()
    sinks.write_lines(rows, path, F.concat_ws(",", "movieid", "userid"), ["pos"])
    return files.user_pairs(spark, path).groupBy("user_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("pairs"))


def _edges(spark, folder):
    path = scratch_path(spark, "edges")
    sinks.write_lines(G.edges(spark, folder), path, F.concat_ws(" ", "src", "dst", F.lit(1)), ["src", "dst"])
    return files.edges(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _document_topics(spark, folder):
    path = scratch_path(spark, "doc-topics")
    sinks.write_lines(table(spark, folder, "part"), path, F.concat_ws(" ", "p_partkey", F.col("p_size").cast("int")), ["p_partkey"])
    return files.document_topics(spark, path)


def _reviews(labelled: bool):
    def query(spark, folder):
        path = scratch_path(spark, "reviews")
        columns = ["stars", "text", "review_id"] if labelled else ["text", "review_id"]
        docs = table(spark, folder, "documents").select("doc_id", *columns)
        sinks.write_lines(docs, path, F.to_json(F.struct(*columns)), ["doc_id"])
        return files.reviews(spark, path)

    return query


def _gold(spark, folder):
    path = scratch_path(spark, "gold")
    sinks.write_lines(table(spark, folder, "documents"), path, F.coalesce("source", F.lit("unlabeled")), ["doc_id"])
    return files.gold(spark, path)


def _assignment(spark, folder):
    return T.document_terms(table(spark, folder, "docvectors")).groupBy("doc_id").agg(F.min("term").cast("long").alias("cluster_id"))


def _clusters(spark, folder):
    path = scratch_path(spark, "clusters")
    sinks.write_clusters(_assignment(spark, folder), path)
    return files.clusters(spark, path)


def _dictionary(by: str):
    def query(spark, folder):
        path = scratch_path(spark, "dictionary")
        tf = T.term_frequency(T.tokenize(table(spark, folder, "documents")))
        sinks.write_dictionary(T.top_vocabulary(T.vocabulary_counts(tf), by), path)
        return files.dictionary(spark, path)

    return query


def _document_frequencies(spark, folder):
    path = scratch_path(spark, "df")
    counts = T.vocabulary_counts(T.document_terms(table(spark, folder, "docvectors")), "term")
    sinks.write_lines(counts, path, F.concat_ws(":", "term", "df"), ["term"])
    return files.document_frequencies(spark, path)


def _stop_list(spark, folder):
    path = scratch_path(spark, "stop-list")
    sinks.write_lines(table(spark, folder, "nation"), path, F.lower(F.concat_ws(" ", "n_name", F.lit("the"), "n_name")), ["n_nationkey"])
    return files.stop_list(spark, path)


def _stopped_by_table(spark, folder):
    """Tokens of the texts that are no word of the dictionary table, by an anti join."""
    words = table(spark, folder, "termdict").filter("word IS NOT NULL AND term_id % 2 = 0").select(F.lower("word").alias("word"))
    return T.tokenize(table(spark, folder, "documents"), stop_words=words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def _cleaned(spark, folder):
    path = scratch_path(spark, "cleaned")
    docs = table(spark, folder, "documents").filter("stars IS NOT NULL").withColumnRenamed("doc_id", "pos")
    sinks.write_cleaned(docs, path)
    return files.cleaned(spark, path)


def _coded_rows(spark, folder):
    tf = T.document_terms(table(spark, folder, "docvectors"))
    ids = F.array_sort(F.collect_list(F.col("term").cast("int")))
    return tf.groupBy(F.col("doc_id").alias("pos")).agg(ids.alias("ids")).withColumn("stars", (F.col("pos") % 5 + 1).cast("int"))


def _coded(spark, folder):
    path = scratch_path(spark, "coded")
    sinks.write_coded(_coded_rows(spark, folder), path)
    return files.coded(spark, path).select("pos", "stars", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def _first_tokens(spark, folder):
    """The first 10 tokens of each text, in their order."""
    from ..functions.text import tokens

    words = table(spark, folder, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("place", "token"))
    return topk.top_k(words, ["doc_id"], 10, [F.col("place").asc()]).select("doc_id", "rank", "token")


def _classes(spark, folder):
    path = scratch_path(spark, "classes")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 5 + 1).cast("int").alias("hard"), (F.col("doc_id") % 41 / 10.0 + 1).alias("soft"))
    sinks.write_classes(docs, path)
    return files.classes(spark, path)


def _rank_dump(spark, folder):
    path = scratch_path(spark, "rank")
    sinks.write_rank(table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").cast("double").alias("r")), path)
    return files.rank_dump(spark, path)


def _report(spark, folder):
    from ..operators import ratings as R

    path = scratch_path(spark, "report")
    stats = R.rating_stats(ratings(spark, folder), USER, ITEM)
    sinks.write_report(stats.select(*(F.format_string("%.4f", c).alias(c) if c.endswith("average") else F.col(c) for c in ("items", "users", "all_rated_1", "all_rated_3", "all_rated_5", "all_average"))), path)
    return files.lines(spark, path).withColumnRenamed("value", "line")


def _run_lists(spark, folder):
    """Retrieval lists as one file a query, scanned as a folder."""
    rows = table(spark, folder, "relevance").filter("query_name IS NOT NULL AND docid IS NOT NULL AND run IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('inf')")
    ranked = rows.select("query_name", F.col("docid").alias("doc_id"), "run", "score", "rank_no").distinct()
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_name").orderBy(F.desc("score"), "doc_id", "run", F.col("rank_no").asc_nulls_last())))
    line = F.concat_ws(" ", F.lit("0"), F.lit("Q0"), "doc_id", "rank", "score", "run")
    path = scratch_path(spark, "lists")
    sinks.write_run_lists(ranked.select("query_name", "rank", line.alias("line")), path)
    return files.run_lists(spark, path)


def _named(spark, folder):
    """Two score files of which one has the prefix asked for."""
    path = scratch_path(spark, "named")
    regions = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("pos"), "r_name")
    sinks.write_lines(regions, f"{path}/exp1.txt", F.col("r_name"), ["pos"])
    sinks.write_lines(regions, f"{path}/other.txt", F.lower("r_name"), ["pos"])
    return files.named(spark, path, "exp")


def _exists(spark, folder):
    path = scratch_path(spark, "exists")
    before = files.exists(spark, path)
    sinks.write_lines(table(spark, folder, "region"), path, F.col("r_name"), ["r_regionkey"])
    return spark.createDataFrame([(before, files.exists(spark, path))], "before boolean, after boolean")


def _cached(spark, folder):
    path = scratch_path(spark, "cache")
    matrix = ratings(spark, folder).select("user_id", "item_id", F.col("x").cast("double").alias("x"))
    return matrix if files.exists(spark, path) else sinks.write_table(matrix, path)


def _lines(spark, folder):
    path = scratch_path(spark, "lines")
    sinks.write_lines(table(spark, folder, "documents"), path, F.concat_ws("|", "doc_id", "lang"), [F.desc("doc_id")])
    return files.lines(spark, path)


def _row_range(spark, folder):
    """Rows 1 to 49999 of the documents in their order, row 0 left out as in the original slice."""
    placed = topk.positions(table(spark, folder, "documents").select("doc_id", "stars"), ["doc_id"])
    return placed.filter("pos BETWEEN 1 AND 49999").groupBy("stars").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def _f1_counts(spark, folder):
    d = table(spark, folder, "documents")
    counts = M.cluster_counts(d.filter("lang IS NOT NULL").select("doc_id", F.col("lang").alias("cluster_id")), d.select("doc_id", F.col("source").alias("label")))
    return counts.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


QUERIES = {
    "file_lines": _lines,
    "file_user_pairs": _user_pairs,
    "file_zip": lambda s, d: _zipped(s, d).select("pos", "item_id", "user_id", F.round("predicted", 6).alias("predicted"), "actual"),
    "file_rmse": lambda s, d: M.rmse(_zipped(s, d), "predicted", "actual").select(F.round("rmse", 6).alias("rmse")),
    "file_ndcg": lambda s, d: M.ndcg_mean(M.ndcg(_zipped(s, d))).select(*(F.round(c, 6).alias(c) for c in ("ndcg_10", "ndcg_20", "ndcg_30"))),
    "file_letor": _letor,
    "file_edges": _edges,
    "file_document_topics": _document_topics,
    "file_reviews": _reviews(True),
    "file_reviews_unlabelled": _reviews(False),
    "file_gold": _gold,
    "file_clusters": _clusters,
    "file_dictionary_ctf": _dictionary("ctf"),
    "file_dictionary_df": _dictionary("df"),
    "file_document_frequencies": _document_frequencies,
    "file_stop_list": _stop_list,
    "stopword_table": _stopped_by_table,
    "file_cleaned": _cleaned,
    "file_coded": _coded,
    "file_classes": _classes,
    "file_rank_dump": _rank_dump,
    "file_report": _report,
    "file_run_lists": _run_lists,
    "file_named": _named,
    "file_exists": _exists,
    "file_cache": _cached,
    "constant_matrix": lambda s, d: files.constant_matrix(s, 30, 40, 0.5),
    "first_tokens": _first_tokens,
    "row_range": _row_range,
    "cluster_f1_counts": _f1_counts,
}

_Z = f"WITH {RATINGS_SQL}, o AS (SELECT userid, movieid, max(pos) AS pos FROM train WHERE movieid > 0 AND userid > 0 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 1 AND 5 GROUP BY ALL), z AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, item_id, user_id, round((user_id * 7 + item_id * 3) % 41 / 10.0 + 1, 6) AS predicted, score AS actual FROM r JOIN o ON userid = user_id AND movieid = item_id)"
_NDCG = ", o2 AS (SELECT user_id, 2 ** actual - 1 AS g, row_number() OVER (PARTITION BY user_id ORDER BY predicted DESC, pos) AS p, row_number() OVER (PARTITION BY user_id ORDER BY actual DESC, pos) AS q FROM z), n AS (SELECT user_id, " + ", ".join(f"sum(CASE WHEN p <= {k} THEN g / ln(p + 1) ELSE 0 END) / nullif(sum(CASE WHEN q <= {k} THEN g / ln(q + 1) ELSE 0 END), 0) AS ndcg_{k}" for k in (10, 20, 30)) + " FROM o2 GROUP BY user_id)"


def _reviews_sql(stars: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, {stars} AS stars, text, review_id FROM documents"


SQL = {
    "file_lines": "SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos, concat_ws('|', doc_id, lang) AS value FROM documents",
    "file_user_pairs": "SELECT userid AS user_id, min(n) AS first, count(*) AS pairs FROM (SELECT userid, row_number() OVER (ORDER BY pos) - 1 AS n FROM (SELECT DISTINCT pos, movieid, userid FROM train WHERE movieid IS NOT NULL AND userid IS NOT NULL)) GROUP BY userid",
    "file_zip": _Z + " SELECT pos, item_id, user_id, predicted, actual FROM z",
    "file_rmse": _Z + " SELECT round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse FROM z",
    "file_ndcg": _Z + _NDCG + " SELECT " + ", ".join(f"round(avg(ndcg_{k}), 6) AS ndcg_{k}" for k in (10, 20, 30)) + " FROM n",
    "file_letor": _Z + " SELECT pos, CASE WHEN actual >= 3 THEN predicted ELSE 0.0 END AS value FROM z",
    "file_edges": "WITH" + G._CELLS + " SELECT src, dst, count(*) AS n FROM raw GROUP BY ALL",
    "file_document_topics": "SELECT p_partkey AS doc_id, CAST(p_size AS INT) AS topic_id FROM part",
    "file_reviews": f"SELECT * FROM ({_reviews_sql('stars')}) WHERE stars IS NOT NULL OR text IS NOT NULL OR review_id IS NOT NULL",
    "file_reviews_unlabelled": f"SELECT * FROM ({_reviews_sql('CAST(NULL AS INT)')}) WHERE text IS NOT NULL OR review_id IS NOT NULL",
    "file_gold": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, source AS label FROM documents QUALIFY source IS NOT NULL",
    "file_clusters": _D + " SELECT doc_id, CAST(min(term) AS BIGINT) AS cluster_id FROM tf GROUP BY doc_id",
    "file_dictionary_ctf": _W + " SELECT token AS word, idx FROM (" + _TOP.format(by="ctf") + ")",
    "file_dictionary_df": _W + " SELECT token AS word, idx FROM (" + _TOP.format(by="df") + ")",
    "file_document_frequencies": _D + " SELECT term, CAST(df AS INT) AS df FROM v",
    "file_stop_list": "SELECT DISTINCT unnest(string_split(lower(n_name) || ' the', ' ')) AS word FROM nation",
    "file_cleaned": r"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, stars, regexp_replace(coalesce(text, ''), '[\t\r\n]', ' ', 'g') AS text FROM documents WHERE stars IS NOT NULL",
    "file_coded": _D + " SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(doc_id % 5 + 1 AS INT) AS stars, string_agg(CAST(term AS VARCHAR), ' ' ORDER BY term) AS ids FROM tf GROUP BY doc_id",
    "file_classes": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(doc_id % 5 + 1 AS INT) AS hard, doc_id % 41 / 10.0 + 1 AS soft FROM documents",
    "file_rank_dump": "SELECT row_number() OVER (ORDER BY CAST(c_acctbal AS DOUBLE) DESC, c_custkey) - 1 AS pos, c_custkey AS doc_id, CAST(c_acctbal AS DOUBLE) AS r FROM customer",
    "file_report": f"WITH {RATINGS_SQL}, s AS (SELECT count(DISTINCT item_id) AS a, count(DISTINCT user_id) AS b, count_if(score = 1) AS c, count_if(score = 3) AS d, count_if(score = 5) AS e, avg(score) AS f FROM r) SELECT unnest(range(6)) AS pos, unnest(['items: ' || a, 'users: ' || b, 'all_rated_1: ' || c, 'all_rated_3: ' || d, 'all_rated_5: ' || e, 'all_average: ' || printf('%.4f', f)]) AS line FROM s",
    "file_run_lists": "SELECT query_name, doc_id, CAST(row_number() OVER (PARTITION BY query_name ORDER BY score DESC, doc_id, run, rank_no NULLS LAST) AS INT) AS rank, score, run FROM (SELECT DISTINCT query_name, docid AS doc_id, run, score, rank_no FROM relevance WHERE query_name IS NOT NULL AND docid IS NOT NULL AND run IS NOT NULL AND score IS NOT NULL AND isfinite(score))",
    "file_named": "SELECT 'exp1.txt' AS file, r_name AS value FROM region",
    "file_exists": "SELECT FALSE AS before, TRUE AS after",
    "file_cache": f"WITH {RATINGS_SQL} SELECT user_id, item_id, x FROM r",
    "constant_matrix": "SELECT i, j, CAST(0.5 AS DOUBLE) AS value FROM range(30) a(i) CROSS JOIN range(40) b(j)",
    "row_range": "SELECT stars, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, stars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos BETWEEN 1 AND 49999 GROUP BY stars",
    "cluster_f1_counts": "WITH g AS (SELECT doc_id, source AS label FROM documents WHERE source IS NOT NULL AND source <> 'unlabeled'), s AS (SELECT doc_id, lang AS c FROM documents WHERE lang IS NOT NULL), gl AS (SELECT label, count(*) AS n FROM g GROUP BY label), sc AS (SELECT c, count(*) AS n FROM s GROUP BY c), h AS (SELECT label, c, count(*) AS tp FROM g JOIN s USING (doc_id) GROUP BY ALL) SELECT label, c AS cluster_id, tp, sc.n - tp AS fp, gl.n - tp AS fn, round(tp / sc.n, 6) AS precision, round(tp / gl.n, 6) AS recall, round(2.0 * tp / (gl.n + sc.n), 6) AS f1 FROM h JOIN gl USING (label) JOIN sc USING (c)",
}


def _token_sql() -> dict[str, str]:
    from ..functions.text import tokens_sql

    return {
        "first_tokens": f"SELECT doc_id, CAST(k AS INT) AS rank, t[k] AS token FROM (SELECT doc_id, t, unnest(range(1, least(len(t), 10) + 1)) AS k FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL))",
        "stopword_table": f"SELECT doc_id, count(*) AS n_tokens FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) WHERE token NOT IN (SELECT lower(word) FROM termdict WHERE word IS NOT NULL AND term_id % 2 = 0) GROUP BY doc_id",
    }


SQL |= _token_sql()
