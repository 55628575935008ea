"""Queries on star prediction: texts with 1 to 5 stars, counts of the 4000 most frequent words and a bias."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learners as ML
from ..operators import metrics as M
from ..operators import softmax as S
from ..operators import text as T
from ..operators.topk import positions
from ..session import cut, table
from .text_queries import _TOP, _W

RATE, PENALTY, STEPS, SLICES, CLASSES = 1e-5, 1.0, 3, 4, 5
STOP, STOP_STEPS = 0.3, 7
FEATURES = T.VOCABULARY + 1


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("stars BETWEEN 1 AND 5")
    tf = cut(T.term_frequency(T.tokenize(docs)), "tf")
    return cut(S.rows_of(T.features(tf, T.top_vocabulary(T.vocabulary_counts(tf), "ctf"), docs=docs), docs.select("doc_id", (F.col("stars") - 1).alias("label"))), "rows")


def _fitted(spark, folder, steps: int = STEPS, penalty: float = PENALTY):
    rows = _rows(spark, folder)
    return rows, S.fit(rows, FEATURES, CLASSES, rate=RATE, penalty=penalty, iterations=steps, error=None)


def _stopped(spark, folder):
    """The objective where the relative change first lies below STOP, or after STOP_STEPS steps."""
    rows = _rows(spark, folder)
    w = S.fit(rows, FEATURES, CLASSES, rate=RATE, penalty=PENALTY, iterations=STOP_STEPS, error=STOP)
    return spark.createDataFrame([(round(S.objective(S.gradient(rows, w)[1], w, PENALTY), 4),)], "objective double")


def _weights(spark, w: np.ndarray) -> DataFrame:
    return S.weights_table(spark, w).withColumn("w", F.round("w", 9) + 0.0).filter("w <> 0")


def _objective(spark, folder):
    rows, w = _fitted(spark, folder)
    return spark.createDataFrame([(round(S.objective(S.gradient(rows, w)[1], w, PENALTY), 4),)], "objective double")


def _predict(spark, folder):
    rows, w = _fitted(spark, folder)
    return S.predict(rows, w, first_class=1)


def _sliced(spark, folder):
    rows = _rows(spark, folder)
    placed = positions(rows, ["doc_id"])
    n = rows.count()
    return _weights(spark, S.fit_slices(placed, F.col("pos"), -(-n // SLICES), n, FEATURES, CLASSES, rate=RATE, penalty=PENALTY))


def _sweep(spark, folder):
    rows, out = _rows(spark, folder), None
    for penalty in (0.1, 1.0, 10.0):
        w = S.fit(rows, FEATURES, CLASSES, rate=RATE, penalty=penalty, iterations=STEPS, error=None)
        scored = S.predict(rows, w, first_class=1).join(rows.select("doc_id", (F.col("label") + 1).alias("stars")), "doc_id")
        one = M.accuracy(scored, "hard", "stars").join(F.broadcast(M.rmse(scored, "soft", "stars"))).select(F.lit(penalty).alias("penalty"), F.round("accuracy", 6).alias("accuracy"), F.round("rmse", 6).alias("rmse"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def _learner(kind: str):
    def query(spark, folder):
        docs = table(spark, folder, "documents").filter("stars BETWEEN 1 AND 5")
        label = F.col("stars") - 1 if kind != "svc" else (F.col("stars") >= 4).cast("int")
        rows = cut(ML.count_vectors(docs.select("doc_id", "text", label.alias("label"))), "vectors")
        model = {"logistic": ML.logistic, "svc": ML.linear_svc, "ovr": ML.linear_svc_classes}[kind](rows, iterations=10)
        return model.transform(rows).select("doc_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))

    return query


QUERIES = {
    "softmax_step": lambda s, d: _weights(s, _fitted(s, d, 1)[1]),
    "softmax_iter3": lambda s, d: _weights(s, _fitted(s, d)[1]),
    "softmax_objective": _objective,
    "softmax_stop": _stopped,
    "softmax_hard": lambda s, d: _predict(s, d).select("doc_id", "hard"),
    "softmax_soft": lambda s, d: _predict(s, d).select("doc_id", F.round("soft", 6).alias("soft")),
    "softmax_minibatch": _sliced,
    "softmax_sgd": lambda s, d: _weights(s, S.fit_one_by_one(_rows(s, d), FEATURES, CLASSES, rate=RATE, penalty=PENALTY)),
    "grid_sweep": _sweep,
    "ml_logistic": _learner("logistic"),
    "ml_linear_svc_binary": _learner("svc"),
    "ml_linear_svc_ovr": _learner("ovr"),
}

_X = _W.replace("FROM documents)", "FROM documents WHERE stars BETWEEN 1 AND 5)") + f""", k AS ({_TOP.format(by="ctf")}),
x AS MATERIALIZED (SELECT doc_id, idx + 1 AS idx, CAST(count(*) AS DOUBLE) AS val FROM w JOIN k USING (token) GROUP BY ALL UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE stars BETWEEN 1 AND 5),
y AS MATERIALIZED (SELECT doc_id, stars - 1 AS label, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE stars BETWEEN 1 AND 5), cls AS (SELECT unnest(range(5)) AS c),
w0 AS (SELECT idx, c, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT idx FROM x) CROSS JOIN cls)"""


def _steps_sql(n: int, sliced: bool = False, penalty: float = PENALTY, tag: str = "") -> str:
    out, before = [], "w0"
    for i in range(n):
        t = f"{tag}{i}"
        only = f" WHERE pos // (((SELECT count(*) FROM y) + {SLICES - 1}) // {SLICES}) = {i}" if sliced else ""
        out.append(f"s{t} AS (SELECT doc_id, c, sum(val * w) AS s FROM x JOIN {before} USING (idx) JOIN y USING (doc_id){only} GROUP BY doc_id, c)")
        out.append(f"p{t} AS MATERIALIZED (SELECT doc_id, c, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id) AS p FROM s{t})")
        out.append(f"g{t} AS (SELECT idx, c, sum(val * (CASE WHEN label = c THEN 1 ELSE 0 END - p)) AS g FROM x JOIN p{t} USING (doc_id) JOIN y USING (doc_id) GROUP BY idx, c)")
        out.append(f"w{t}_ AS MATERIALIZED (SELECT b.idx, b.c, w + {RATE}::DOUBLE * (coalesce(g, 0) - {penalty}::DOUBLE * w) AS w FROM {before} b LEFT JOIN g{t} g ON g.idx = b.idx AND g.c = b.c)")
        before = f"w{t}_"
    out.append(f"q{tag} AS MATERIALIZED (SELECT doc_id, c, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, c, sum(val * w) AS s FROM x JOIN {before} USING (idx) GROUP BY ALL))")
    return ",\n".join(out)


def _weights_sql(n: int, sliced: bool = False) -> str:
    return f"{_X},\n{_steps_sql(n, sliced)} SELECT CAST(idx AS INT) AS idx, CAST(c AS INT) AS class, round(w, 9) + 0.0 AS w FROM w{n - 1}_ WHERE round(w, 9) <> 0"


def _objective_sql(i: int) -> str:
    w = "w0" if i == 0 else f"w{i - 1}_"
    return f"SELECT {i} AS i, (SELECT sum(ln(p)) FROM (SELECT doc_id, c, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, c, sum(val * w) AS s FROM x JOIN {w} USING (idx) GROUP BY ALL)) JOIN y USING (doc_id) WHERE label = c) - {PENALTY} / 2 * (SELECT sum(w * w) FROM {w}) AS o"


_HARD = "SELECT doc_id, CAST(arg_min(c, k) AS INT) + 1 AS hard FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 12) DESC, c) AS k FROM {q}) GROUP BY doc_id"
_SOFT = "SELECT doc_id, sum((c + 1) * p) AS soft FROM {q} GROUP BY doc_id"
_FIT = f"{_X},\n{_steps_sql(STEPS)}"

SQL = {
    "softmax_step": _weights_sql(1),
    "softmax_iter3": _weights_sql(STEPS),
    "softmax_objective": _FIT + f" SELECT round((SELECT sum(ln(p)) FROM q JOIN y USING (doc_id) WHERE label = c) - {PENALTY} / 2 * (SELECT sum(w * w) FROM w{STEPS - 1}_), 4) AS objective",
    # before step i the weights are those after i steps; the rule looks at objectives 1, 2, ... against the one before and the first
    "softmax_stop": f"{_X},\n{_steps_sql(STOP_STEPS)}, o AS (" + " UNION ALL ".join(_objective_sql(i) for i in range(STOP_STEPS + 1)) + f"), seen AS (SELECT i, o, lag(o) OVER (ORDER BY i) AS last, first_value(o) OVER (ORDER BY i) AS first FROM o) SELECT round(o, 4) AS objective FROM seen WHERE i = (SELECT coalesce(min(i), {STOP_STEPS}) FROM seen WHERE i BETWEEN 1 AND {STOP_STEPS - 1} AND o <> first AND abs((o - last) / (o - first)) < {STOP})",
    "softmax_hard": f"{_FIT} {_HARD.format(q='q')}",
    "softmax_soft": f"{_FIT} SELECT doc_id, round(soft, 6) AS soft FROM ({_SOFT.format(q='q')})",
    "softmax_minibatch": _weights_sql(SLICES, True),
    "grid_sweep": _X + ",\n" + ",\n".join(_steps_sql(STEPS, penalty=p, tag=t) for p, t in ((0.1, "a"), (1.0, "b"), (10.0, "d")))
    + " " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS penalty, round(avg(CASE WHEN hard = label + 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sqrt(avg((soft - label - 1) ** 2)), 6) AS rmse FROM ({_HARD.format(q='q' + t)}) JOIN ({_SOFT.format(q='q' + t)}) USING (doc_id) JOIN y USING (doc_id)" for p, t in ((0.1, "a"), (1.0, "b"), (10.0, "d"))),
}
