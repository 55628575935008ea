"""Queries on clusters of sparse records and their evaluation. Query records are those divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import knn as K
from ..operators import metrics as M
from ..operators import text as T
from ..operators import topk
from ..session import cut, table

CLUSTERS, THRESHOLD, STOP_ROUNDS = 20, 10, 6
DRAWS = [(k * 0.37 + 0.11) % 1 for k in range(CLUSTERS - 1)]


def _tf(spark, folder):
    return T.document_terms(table(spark, folder, "docvectors")).withColumn("weight", F.col("tf").cast("double"))


def _vectors(entries: DataFrame) -> DataFrame:
    return K.long_to_vectors(entries, "doc_id", "term", "weight")


def _tfidf(spark, folder):
    return T.tfidf(T.document_terms(table(spark, folder, "docvectors")), term="term", by="ctf").withColumn("weight", F.round("weight", 9))


def _run(spark, folder, *, euclidean=False, iterations=3, tfidf=False):
    v = cut(_vectors((_tfidf if tfidf else _tf)(spark, folder)), "vectors")
    return v, C.kmeans(v, C.seeds_from(v, C.first_ids(v, CLUSTERS)), CLUSTERS, euclidean=euclidean, iterations=iterations, threshold=-1)


def _stopped(spark, folder):
    """At most STOP_ROUNDS rounds, ended by the first in which THRESHOLD assignments or fewer change."""
    v = cut(_vectors(_tf(spark, folder)), "vectors")
    return C.kmeans(v, C.seeds_from(v, C.first_ids(v, CLUSTERS)), CLUSTERS, iterations=STOP_ROUNDS, threshold=THRESHOLD).select(F.col("id").alias("doc_id"), "cluster_id")


def _assigned(**options):
    return lambda s, d: _run(s, d, **options)[1].select(F.col("id").alias("doc_id"), "cluster_id")


def _centroids(spark, folder):
    v, a = _run(spark, folder, iterations=1)
    return C.centroids_of(v, a).select("cluster_id", F.col("key").alias("term"), F.round("weight", 6).alias("weight"))


def _pairs(spark, folder):
    e = cut(_tf(spark, folder).select("doc_id", "term", "weight"), "entries")
    return C.pair_similarities(e, e.filter("doc_id % 20 = 0").select("doc_id"))


def _embeddings(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda x: x.cast("long")).alias("keys"), F.col("embedding").cast("array<double>").alias("values"))
    return K.top_similar(e, e.filter("id % 20 = 0").select("id"), 11, cosine=True).withColumn("s", F.round("s", 6))


def _plus_plus(spark, folder):
    v = cut(_vectors(_tf(spark, folder)), "vectors")
    return C.weighted_pick(C._distances(v, C.first_ids(v, 1)[0]), DRAWS[0])


def _plus_plus_ids(spark, folder):
    v = cut(_vectors(_tf(spark, folder)), "vectors")
    return spark.createDataFrame(list(enumerate(C.plus_plus_ids(v, CLUSTERS, DRAWS))), "cluster_id long, doc_id long")


def _seeded(kind: str):
    def query(spark, folder):
        v = cut(_vectors(_tf(spark, folder)), "vectors")
        ids = C.random_ids(v, CLUSTERS, 7) if kind == "random" else C.plus_plus_ids(v, CLUSTERS, DRAWS)
        return C.kmeans(v, C.seeds_from(v, ids), CLUSTERS, euclidean=kind == "euclid", iterations=3).select(F.col("id").alias("doc_id"), "cluster_id")

    return query


def _f1(spark, folder):
    d = table(spark, folder, "documents")
    system = d.filter("lang IS NOT NULL").select("doc_id", F.col("lang").alias("cluster_id"))
    return M.macro_f1(system, d.select("doc_id", F.col("source").alias("label"))).withColumn("best_f1", F.round("best_f1", 6))


QUERIES = {
    "doc_cosine": lambda s, d: _pairs(s, d).select("a", "b", F.round("cosine", 6).alias("cosine")),
    "doc_euclid_sim": lambda s, d: _pairs(s, d).select("a", "b", F.round("inverse_distance", 6).alias("inverse_distance")),
    "emb_cosine": _embeddings,
    "kmeans_assign": _assigned(iterations=1),
    "kmeans_centroids": _centroids,
    "kmeans_iter3": _assigned(),
    "kmeans_iter3_euclid": _assigned(euclidean=True),
    "kmeans_iter3_tfidf": _assigned(tfidf=True),
    "kmeanspp_pick": _plus_plus,
    "kmeans_stop": _stopped,
    "kmeans_random_ids": lambda s, d: topk.sample(_tf(s, d).select("doc_id").distinct(), "doc_id", CLUSTERS, 7),
    "kmeans_plus_plus_ids": _plus_plus_ids,
    "kmeans_random_seeded": _seeded("random"),
    "kmeans_plus_plus": _seeded("cosine"),
    "kmeans_plus_plus_euclid": _seeded("euclid"),
    "macro_f1": _f1,
    "macro_f1_mean": lambda s, d: M.macro_mean(_f1(s, d)).withColumn("macro_f1", F.round("macro_f1", 6)),
}

_E = "WITH e AS MATERIALIZED (SELECT doc_id, term, CAST(sum(freq) AS DOUBLE) AS w FROM (SELECT DISTINCT * FROM docvectors) WHERE doc_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY ALL), n AS MATERIALIZED (SELECT doc_id, sum(w * w) AS n FROM e GROUP BY doc_id)"
_T = "WITH t AS (SELECT doc_id, term, CAST(sum(freq) AS BIGINT) AS tf FROM (SELECT DISTINCT * FROM docvectors) WHERE doc_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY ALL), c AS (SELECT term, sum(tf) AS ctf FROM t GROUP BY term), e AS MATERIALIZED (SELECT doc_id, term, round(tf * ln((SELECT count(DISTINCT doc_id) FROM t) / ctf + 1), 9) AS w FROM t JOIN c USING (term)), n AS MATERIALIZED (SELECT doc_id, sum(w * w) AS n FROM e GROUP BY doc_id)"
_PAIRS = _E + ", p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS d FROM e x JOIN e y ON x.term = y.term AND x.doc_id <> y.doc_id WHERE x.doc_id % 20 = 0 GROUP BY ALL), q AS (SELECT a, b, d, l.n AS na, r.n AS nb FROM p JOIN n l ON l.doc_id = a JOIN n r ON r.doc_id = b)"


_FIRST = f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM e ORDER BY doc_id LIMIT {CLUSTERS})"
_LOT = "(((doc_id % 2147483647) * 48271 + 8 * 69621) % 2147483647 * 1103515245) % 2147483647"
_RANDOM = f"SELECT doc_id, row_number() OVER (ORDER BY {_LOT}, doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM e) QUALIFY k < {CLUSTERS}"


def _plus_plus_sql() -> str:
    steps = ["s0 AS MATERIALIZED (SELECT min(doc_id) AS doc_id FROM e)"]
    for i, u in enumerate(DRAWS):
        steps.append(f"f{i} AS MATERIALIZED (SELECT term, w FROM e WHERE doc_id = (SELECT doc_id FROM s{i}))")
        steps.append(f"g{i} AS MATERIALIZED (SELECT n.doc_id, n.n - 2 * coalesce(x.d, 0) + (SELECT sum(w * w) FROM f{i}) AS d2 FROM n LEFT JOIN (SELECT doc_id, sum(e.w * f.w) AS d FROM e JOIN f{i} f USING (term) GROUP BY doc_id) x USING (doc_id))")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, sum(d2) OVER (ORDER BY doc_id) AS c FROM g{i}) WHERE c > {u!r}::DOUBLE * (SELECT sum(d2) FROM g{i}))")
    steps.append("pp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, doc_id FROM s{k}" for k in range(CLUSTERS)) + ")")
    return ",\n".join(steps)


def _kmeans_sql(head: str, rounds: int, euclidean: bool = False, seeds: str = _FIRST) -> str:
    steps = [head, f"c0 AS (SELECT k AS cluster_id, term, w FROM e JOIN ({seeds}) USING (doc_id))"]
    for i in range(rounds):
        s = "-(n.n + m.n - 2 * coalesce(d, 0))" if euclidean else "coalesce(d, 0) / sqrt(n.n * m.n)"
        steps.append(f"m{i} AS (SELECT cluster_id, sum(w * w) AS n FROM c{i} GROUP BY cluster_id)")
        steps.append(f"d{i} AS (SELECT e.doc_id, c.cluster_id, sum(e.w * c.w) AS d FROM e JOIN c{i} c USING (term) GROUP BY ALL)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT doc_id, cluster_id FROM (SELECT n.doc_id, m.cluster_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY round({s}, 9) DESC, m.cluster_id) AS k FROM n CROSS JOIN m{i} m LEFT JOIN d{i} d ON d.doc_id = n.doc_id AND d.cluster_id = m.cluster_id) WHERE k = 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster_id, term, sum(w) / any_value(z) AS w FROM a{i} JOIN e USING (doc_id) JOIN (SELECT cluster_id, count(*) AS z FROM a{i} GROUP BY cluster_id) USING (cluster_id) GROUP BY cluster_id, term)")
    return ",\n".join(steps)


_F1 = "WITH g AS (SELECT doc_id, source AS label FROM documents WHERE source IS NOT NULL AND source <> 'unlabeled'), s AS (SELECT doc_id, lang AS c FROM documents WHERE lang IS NOT NULL), gl AS (SELECT label, count(*) AS n FROM g GROUP BY label), sc AS (SELECT c, count(*) AS n FROM s GROUP BY c), h AS (SELECT label, c, count(*) AS tp FROM g JOIN s USING (doc_id) GROUP BY ALL), f AS (SELECT label, round(coalesce(max(2.0 * tp / (gl.n + sc.n)), -1), 6) AS best_f1 FROM gl LEFT JOIN h USING (label) LEFT JOIN sc USING (c) GROUP BY label)"

SQL = {
    "doc_cosine": _PAIRS + " SELECT a, b, round(d / (sqrt(na) * sqrt(nb)), 6) AS cosine FROM q",
    "doc_euclid_sim": _PAIRS + " SELECT a, b, CASE WHEN na + nb - 2 * d > 0 THEN round(1 / sqrt(na + nb - 2 * d), 6) ELSE CAST('inf' AS DOUBLE) END AS inverse_distance FROM q",
    "emb_cosine": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS z FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.e, b.e) / (a.z * b.z), 12) AS s FROM v a CROSS JOIN v b WHERE a.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM p) SELECT query, id, round(s, 6) AS s, rank FROM k WHERE rank <= 11",
    "kmeans_assign": _kmeans_sql(_E, 1) + " SELECT doc_id, cluster_id FROM a0",
    "kmeans_centroids": _kmeans_sql(_E, 1) + " SELECT cluster_id, term, round(w, 6) AS weight FROM c1",
    "kmeans_iter3": _kmeans_sql(_E, 3) + " SELECT doc_id, cluster_id FROM a2",
    "kmeans_iter3_euclid": _kmeans_sql(_E, 3, True) + " SELECT doc_id, cluster_id FROM a2",
    "kmeans_iter3_tfidf": _kmeans_sql(_T, 3) + " SELECT doc_id, cluster_id FROM a2",
    "kmeans_stop": _kmeans_sql(_E, STOP_ROUNDS) + ", z AS (" + " UNION ALL ".join(f"SELECT {i} AS i, count(*) AS changed FROM a{i} x JOIN a{i - 1} y USING (doc_id) WHERE x.cluster_id <> y.cluster_id" for i in range(1, STOP_ROUNDS)) + f"), b AS (SELECT coalesce(min(i), {STOP_ROUNDS - 1}) AS i FROM z WHERE changed <= {THRESHOLD}) " + " UNION ALL ".join(f"SELECT doc_id, cluster_id FROM a{i} WHERE {i} = (SELECT i FROM b)" for i in range(STOP_ROUNDS)),
    "kmeans_random_ids": f"{_E} SELECT doc_id FROM ({_RANDOM})",
    "kmeans_plus_plus_ids": f"{_E}, {_plus_plus_sql()} SELECT k AS cluster_id, doc_id FROM pp",
    "kmeans_random_seeded": _kmeans_sql(_E, 3, seeds=_RANDOM) + " SELECT doc_id, cluster_id FROM a2",
    "kmeans_plus_plus": _kmeans_sql(f"{_E}, {_plus_plus_sql()}", 3, seeds="SELECT doc_id, k FROM pp") + " SELECT doc_id, cluster_id FROM a2",
    "kmeans_plus_plus_euclid": _kmeans_sql(f"{_E}, {_plus_plus_sql()}", 3, True, seeds="SELECT doc_id, k FROM pp") + " SELECT doc_id, cluster_id FROM a2",
    "kmeanspp_pick": _E + f", f AS (SELECT term, w FROM e WHERE doc_id = (SELECT min(doc_id) FROM e)), d AS (SELECT n.doc_id, n.n - 2 * coalesce(x.d, 0) + (SELECT sum(w * w) FROM f) AS d2 FROM n LEFT JOIN (SELECT doc_id, sum(e.w * f.w) AS d FROM e JOIN f USING (term) GROUP BY doc_id) x USING (doc_id)), c AS (SELECT doc_id, sum(d2) OVER (ORDER BY doc_id) AS c FROM d) SELECT min(doc_id) AS id FROM c WHERE c > {DRAWS[0]} * (SELECT sum(d2) FROM d)",
    "macro_f1": _F1 + " SELECT * FROM f",
    "macro_f1_mean": _F1 + " SELECT round(avg(best_f1), 6) AS macro_f1, count(*) AS labels FROM f",
}
