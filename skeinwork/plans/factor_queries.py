"""Queries on matrix factors, pair samples, pairwise wins and rank measures, over every rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import letor as L
from ..operators import metrics as M
from ..operators import pmf as P
from ..session import cut
from .ratings_queries import RATINGS_SQL, ratings

D, RATE, PENALTY, STEPS = 5, 1e-3, 1e-4, 3
STOP, STOP_STEPS = 0.999, 6
COEFFICIENTS = [1.0, 0.5, -0.25, 0.75, 1.25]


def _start(spark, folder):
    r = cut(ratings(spark, folder), "ratings")
    return r, P.hashed_factors(r, "user_id", "u", D), P.hashed_factors(r, "item_id", "v", D)


def _fitted(spark, folder, steps: int = STEPS):
    r, u, v = _start(spark, folder)
    return r, *P.descend(r, u, v, D, rate=RATE, penalty=PENALTY, iterations=steps, precision=None)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def _factors(side: str, steps: int):
    def query(spark, folder):
        _, u, v = _fitted(spark, folder, steps)
        return _rounded(u if side == "u" else v, *P._names(side, D))

    return query


def _objective(spark, folder):
    r, u, v = _fitted(spark, folder)
    return P.objective(r, u, v, D, penalty=PENALTY).withColumn("objective", F.round("objective", 3))


def _pairs(r: DataFrame) -> DataFrame:
    return r.select("user_id", "item_id", "score")


def _predict(spark, folder):
    r, u, v = _fitted(spark, folder)
    return P.predict(_pairs(r), u, v, D)


def _stopped(spark, folder):
    """The objective where the descent stops: at the first step that reaches STOP of the objective of the start, or after STOP_STEPS."""
    r, u, v = _start(spark, folder)
    least = P.objective(r, u, v, D, penalty=PENALTY).first()[0] * STOP
    u, v = P.descend(r, u, v, D, rate=RATE, penalty=PENALTY, iterations=STOP_STEPS, precision=least)
    return P.objective(r, u, v, D, penalty=PENALTY).withColumn("objective", F.round("objective", 3))


def _pair_features(spark, folder):
    r, u, v = _start(spark, folder)
    return _rounded(L.pair_samples(r, u, v, D), *(f"x{k}" for k in range(D)))


def _wins(spark, folder):
    r, u, v = _start(spark, folder)
    return L.pairwise_wins(_pairs(r), u, v, COEFFICIENTS)


def _ndcg(spark, folder):
    rows = _wins(spark, folder).select("user_id", F.col("item_id").alias("pos"), F.col("wins").alias("predicted"), F.col("score").alias("actual"))
    return M.ndcg(rows)


def _rmse(predicted: DataFrame) -> DataFrame:
    return _rounded(M.rmse(predicted, "predicted", "score"), "rmse")


def _accuracy(predicted: DataFrame) -> DataFrame:
    return _rounded(M.accuracy(predicted.withColumn("predicted", F.round(F.round("predicted", 9))), "predicted", "score"), "accuracy")


def _sweep(factors: tuple[int, ...]):
    """Error after the steps for several numbers of factors."""

    def query(spark, folder):
        r, out = cut(ratings(spark, folder), "ratings"), None
        for d in factors:
            u, v = P.descend(r, P.hashed_factors(r, "user_id", "u", d), P.hashed_factors(r, "item_id", "v", d), d, rate=RATE, penalty=PENALTY, iterations=STEPS, precision=None)
            one = _rmse(P.predict(_pairs(r), u, v, d)).select(F.lit(d).alias("factors"), "rmse")
            out = one if out is None else out.unionByName(one)
        return out

    return query


SWEEP = (2, 5, 10)
#: Both sets of numbers of factors of SURVEY AL-34.
SWEEP_ALL = (2, 5, 10, 20, 50, 100)
CUTS = ["ndcg_10", "ndcg_20", "ndcg_30"]
QUERIES = {
    "factor_sweep": _sweep(SWEEP),
    "factor_sweep_all": _sweep(SWEEP_ALL),
    "pmf_stop": _stopped,
    "pmf_step": _factors("v", 1),
    "pmf_iter3_users": _factors("u", STEPS),
    "pmf_iter3_items": _factors("v", STEPS),
    "pmf_objective": _objective,
    "pmf_predict": lambda s, d: _rounded(_predict(s, d), "predicted").select("user_id", "item_id", "predicted"),
    "pair_features": _pair_features,
    "pair_sample_stats": lambda s, d: L.sample_stats(ratings(s, d)),
    "pair_user_samples": lambda s, d: L.user_samples(ratings(s, d)),
    "pairwise_wins": lambda s, d: _wins(s, d).select("user_id", "item_id", "wins"),
    "ndcg_at_k": lambda s, d: _rounded(_ndcg(s, d), *CUTS),
    "ndcg_mean": lambda s, d: _rounded(M.ndcg_mean(_ndcg(s, d)), *CUTS),
    "rmse": lambda s, d: _rmse(_predict(s, d)),
    "accuracy": lambda s, d: _accuracy(_predict(s, d)),
}

_F = range(D)


def _dot(d: int) -> str:
    return " + ".join(f"u{k} * v{k}" for k in range(d))


_DOT = _dot(D)


def _init(key: str, p: str, d: int = D) -> str:
    return f"SELECT {key}, " + ", ".join(f"(({key} * 7919 + {k * 104729}) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE AS {p}{k}" for k in range(d)) + f" FROM (SELECT DISTINCT {key} FROM r)"


def _steps_sql(n: int, d: int = D) -> str:
    s = [f"WITH {RATINGS_SQL}", f"ua AS MATERIALIZED ({_init('user_id', 'u', d)})", f"va AS MATERIALIZED ({_init('item_id', 'v', d)})"]
    u, v = "ua", "va"
    for i in range(n):
        s.append(f"e{i} AS MATERIALIZED (SELECT *, x - ({_dot(d)}) AS e FROM r JOIN {u} USING (user_id) JOIN {v} USING (item_id))")
        for key, p, o, old in (("user_id", "u", "v", u), ("item_id", "v", "u", v)):
            sums = ", ".join(f"sum(e * {o}{k}) AS g{k}" for k in range(d))
            new = ", ".join(f"{p}{k} - {RATE}::DOUBLE * (2 * {PENALTY}::DOUBLE * {p}{k} - 2 * g{k}) AS {p}{k}" for k in range(d))
            s.append(f"{p}{i} AS MATERIALIZED (SELECT {key}, {new} FROM {old} JOIN (SELECT {key}, {sums} FROM e{i} GROUP BY {key}) USING ({key}))")
        u, v = f"u{i}", f"v{i}"
    s.append(f"uz AS (SELECT * FROM {u})")
    s.append(f"vz AS (SELECT * FROM {v})")
    return ",\n".join(s)


def _out(key: str, p: str) -> str:
    return f" SELECT {key}, " + ", ".join(f"round({p}{k}, 6) + 0.0 AS {p}{k}" for k in _F) + f" FROM {p}z"


def _objective_sql(step: int) -> str:
    """The objective after ``step`` steps from 0; -1 for the start."""
    u, v = ("ua", "va") if step < 0 else (f"u{step}", f"v{step}")
    lengths = [" + ".join(f"sum({p}{k}) ** 2" for k in _F) for p in "uv"]
    return f"SELECT {step} AS i, (SELECT sum((x - ({_DOT})) ** 2) FROM r JOIN {u} USING (user_id) JOIN {v} USING (item_id)) + {PENALTY}::DOUBLE * ((SELECT {lengths[0]} FROM {u}) + (SELECT {lengths[1]} FROM {v})) AS o"


_PRED = _steps_sql(STEPS) + f", p AS (SELECT user_id, item_id, score, {_DOT} + 3 AS predicted FROM r JOIN uz USING (user_id) JOIN vz USING (item_id))"
_ZERO = _steps_sql(0)
_WINS = _ZERO + ", w AS (SELECT user_id, item_id, score, rank() OVER (PARTITION BY user_id ORDER BY round(" + " + ".join(f"{c} * u{k} * v{k}" for k, c in enumerate(COEFFICIENTS)) + ", 12)) - 1 AS wins FROM r JOIN uz USING (user_id) JOIN vz USING (item_id))"
_NDCG = _WINS + ", o AS (SELECT user_id, 2 ** score - 1 AS g, row_number() OVER (PARTITION BY user_id ORDER BY wins DESC, item_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS q FROM w), n AS (SELECT user_id, " + ", ".join(f"sum(CASE WHEN p <= {k} THEN g / ln(p + 1) ELSE 0 END) / nullif(sum(CASE WHEN q <= {k} THEN g / ln(q + 1) ELSE 0 END), 0) AS ndcg_{k}" for k in (10, 20, 30)) + " FROM o GROUP BY user_id)"
_PAIRS = f"f AS (SELECT h.user_id, h.item_id AS hi, l.item_id AS lo FROM r h JOIN r l ON h.user_id = l.user_id AND h.score - l.score = 4)"

SQL = {
    "factor_sweep": " UNION ALL ".join(f"(SELECT * FROM ({_steps_sql(STEPS, d)} SELECT {d} AS factors, round(sqrt(avg(({_dot(d)} + 3 - score) ** 2)), 6) AS rmse FROM r JOIN uz USING (user_id) JOIN vz USING (item_id)))" for d in SWEEP),
    "pmf_step": _steps_sql(1) + _out("item_id", "v"),
    "pmf_iter3_users": _steps_sql(STEPS) + _out("user_id", "u"),
    "pmf_iter3_items": _steps_sql(STEPS) + _out("item_id", "v"),
    "pmf_objective": _steps_sql(STEPS) + f" SELECT round((SELECT sum((x - ({_DOT})) ** 2) FROM r JOIN uz USING (user_id) JOIN vz USING (item_id)) + {PENALTY} * ((SELECT " + " + ".join(f"sum(u{k}) ** 2" for k in _F) + " FROM uz) + (SELECT " + " + ".join(f"sum(v{k}) ** 2" for k in _F) + " FROM vz)), 3) AS objective",
    "pmf_predict": _PRED + " SELECT user_id, item_id, round(predicted, 6) AS predicted FROM p",
    "pair_features": _ZERO + f", {_PAIRS}, g AS (SELECT user_id, hi AS item_i, lo AS item_j, 1 AS label FROM f UNION ALL SELECT user_id, lo, hi, 0 FROM f) SELECT g.user_id, item_i, item_j, " + ", ".join(f"round(u{k} * (a.v{k} - b.v{k}), 6) + 0.0 AS x{k}" for k in _F) + ", label FROM g JOIN uz USING (user_id) JOIN vz a ON a.item_id = item_i JOIN vz b ON b.item_id = item_j",
    "pair_sample_stats": f"WITH {RATINGS_SQL}, {_PAIRS} SELECT (SELECT count(*) FROM r) AS observed, 2 * count(*) AS samples, count(*) AS positive, count(*) AS negative, count(*) / nullif(count(*), 0) AS ratio FROM f",
    "pair_user_samples": f"WITH {RATINGS_SQL}, {_PAIRS} SELECT user_id, 2 * count(*) AS samples FROM f GROUP BY user_id",
    "pairwise_wins": _WINS + " SELECT user_id, item_id, wins FROM w",
    "ndcg_at_k": _NDCG + " SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in CUTS) + " FROM n",
    "ndcg_mean": _NDCG + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in CUTS) + " FROM n",
    "rmse": _PRED + " SELECT round(sqrt(avg((predicted - score) ** 2)), 6) AS rmse FROM p",
    "accuracy": _PRED + " SELECT round(avg(CASE WHEN round(round(predicted, 9)) = score THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p",
    "pmf_stop": _steps_sql(STOP_STEPS) + ", o AS (" + " UNION ALL ".join(_objective_sql(i) for i in range(-1, STOP_STEPS)) + f") SELECT round(o, 3) AS objective FROM o WHERE i = (SELECT coalesce(min(i), {STOP_STEPS - 1}) FROM o WHERE i >= 0 AND o <= {STOP} * (SELECT o FROM o WHERE i = -1))",
}
