"""Queries on ratings: statistics, normalised matrices, neighbours and predicted scores. Query users and items are those divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn as K
from ..operators import ratings as R
from ..session import cut, table

USER, ITEM, NEAR = 305, 30, 10


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return R.clean_ratings(table(spark, folder, "train").select("pos", "movieid", "userid", "score"))


def _asked(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key) % 20 == 0).select(F.col(key).alias("id")).distinct()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})  # no negative zeros


def _stats(spark, folder):
    s = R.rating_stats(ratings(spark, folder), USER, ITEM)
    return _rounded(s, *(c for c in s.columns if c.endswith("average")))


def _unit(make):
    return lambda s, d: _rounded(make(ratings(s, d)).select("user_id", "item_id", "unit"), "unit")


def _item_similarity(kind: str):
    def query(spark, folder):
        r = ratings(spark, folder)
        if kind == "std":
            r = R.standardised(r)
        elif kind == "cos":
            r = R.normalised(r, "item_id")
        r = cut(r, "ratings")
        return _rounded(K.item_similarity(r, _asked(r, "item_id"), "x" if kind == "dot" else "unit"), "s")

    return query


def _top(spark, folder, by: str, cosine: bool, k: int = NEAR + 1, standardise: bool = False):
    r = cut(ratings(spark, folder), "ratings")
    own, other = ("user_id", "item_id") if by == "user" else ("item_id", "user_id")
    source, value = (R.standardised(r), "unit") if standardise else (r, "x")
    return r, own, K.top_similar(K.long_to_vectors(source, own, other, value), _asked(r, own), k, cosine=cosine)


def _neighbours(by: str, cosine: bool, standardise: bool = False):
    return lambda s, d: _rounded(_top(s, d, by, cosine, standardise=standardise)[2], "s")


def _report(by: str, cosine: bool):
    return lambda s, d: K.report(_top(s, d, by, cosine, 6)[2])


def _scores(by: str, cosine: bool, standardise: bool = False):
    def query(spark, folder):
        r, own, top = _top(spark, folder, by, cosine, standardise=standardise)
        pairs = r.filter(F.col(own) % 20 == 0).select("user_id", "item_id")
        return _rounded(K.predict(top, r, pairs, NEAR, by=by), "average", "weighted")

    return query


SWEEP = (10, 100, 500)


def _sweep(spark, folder):
    r = cut(ratings(spark, folder), "ratings")
    pairs = r.filter("user_id % 20 = 0").select("user_id", "item_id", "score")
    scored = K.predict_sweep(K.long_to_vectors(r, "user_id", "item_id", "x"), r, pairs, SWEEP, cosine=True)
    error = lambda k, c: F.sqrt(F.avg(F.when(F.col("k") == k, F.pow(F.col(c) - F.col("score"), 2))))
    one = scored.agg(F.array(*(F.struct(F.lit(k).alias("k"), error(k, "average").alias("rmse_average"), error(k, "weighted").alias("rmse_weighted")) for k in SWEEP)).alias("e"))
    return _rounded(one.select(F.inline("e")), "rmse_average", "rmse_weighted")


QUERIES = {
    "knn_sweep": _sweep,
    "rating_stats": _stats,
    "rating_user_norm": _unit(lambda r: R.normalised(r, "user_id")),
    "rating_item_norm": _unit(lambda r: R.normalised(r, "item_id")),
    "rating_item_std": _unit(R.standardised),
    "rating_item_std_as_written": _unit(lambda r: R.standardised(r, as_written=True)),
    "item_sim_dot": _item_similarity("dot"),
    "item_sim_cos": _item_similarity("cos"),
    "item_sim_std": _item_similarity("std"),
    "user_sim_dot": _neighbours("user", False),
    "user_sim_cos": _neighbours("user", True),
    "knn_topk_item": _neighbours("item", True),
    "knn_report_user": _report("user", True),
    "knn_report_item": _report("item", False),
    "knn_user_scores": _scores("user", False),
    "knn_user_scores_cos": _scores("user", True),
    "knn_item_scores": _scores("item", True),
    "knn_std_scores": _scores("item", False, standardise=True),
}

RATINGS_SQL = """r AS MATERIALIZED (SELECT userid AS user_id, movieid AS item_id, arg_max(score, pos) AS score, arg_max(score, pos) - 3 AS x FROM train
  WHERE movieid > 0 AND userid > 0 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 1 AND 5 GROUP BY ALL)"""
_R = f"WITH {RATINGS_SQL}"


def _unit_sql(key: str) -> str:
    return f"z AS (SELECT {key}, sqrt(sum(x * x)) AS z FROM r GROUP BY {key}), u AS MATERIALIZED (SELECT user_id, item_id, CASE WHEN z > 0 THEN x / z ELSE x END AS unit FROM r JOIN z USING ({key}))"


_STD = """m AS (SELECT item_id, avg(score) AS m FROM r GROUP BY item_id), c AS (SELECT user_id, item_id, round(score - m, 12) AS c FROM r JOIN m USING (item_id)),
  z AS (SELECT item_id, sqrt(sum(c * c)) AS z FROM c GROUP BY item_id), u AS MATERIALIZED (SELECT user_id, item_id, CASE WHEN z > 0 THEN c / z ELSE c END AS unit FROM c JOIN z USING (item_id))"""
_AS_WRITTEN = """o AS (SELECT userid AS user_id, movieid AS item_id, max(pos) AS pos FROM train WHERE movieid > 0 AND userid > 0 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 1 AND 5 GROUP BY ALL),
  l AS (SELECT count(*) AS n FROM r WHERE item_id = (SELECT item_id FROM o ORDER BY pos DESC, user_id DESC, item_id DESC LIMIT 1)),
  m AS (SELECT item_id, sum(score) AS m, max(abs(x)) AS live FROM r GROUP BY item_id), c AS (SELECT user_id, item_id, round(CASE WHEN live > 0 THEN score - m / (SELECT n FROM l) - 3 ELSE x END, 12) AS c FROM r JOIN m USING (item_id)),
  z AS (SELECT item_id, sqrt(sum(c * c)) AS z FROM c GROUP BY item_id), u AS MATERIALIZED (SELECT user_id, item_id, CASE WHEN z > 0 THEN c / z ELSE c END AS unit FROM c JOIN z USING (item_id))"""
_ITEM_SIM = " SELECT p.item_id AS a, q.item_id AS b, round(sum(p.{v} * q.{v}), 6) + 0.0 AS s FROM {t} p JOIN {t} q ON p.user_id = q.user_id AND p.item_id <> q.item_id WHERE p.item_id % 20 = 0 AND p.{v} <> 0 AND q.{v} <> 0 GROUP BY ALL"


def _top_sql(by: str, t: str, v: str, k: int) -> str:
    own, other = ("user_id", "item_id") if by == "user" else ("item_id", "user_id")
    return f"""ids AS (SELECT DISTINCT {own} AS id FROM r), l AS (SELECT p.{own} AS query, q.{own} AS id, sum(p.{v} * q.{v}) AS s FROM {t} p JOIN {t} q USING ({other}) WHERE p.{own} % 20 = 0 AND p.{v} <> 0 AND q.{v} <> 0 GROUP BY ALL),
  f AS (SELECT a.id AS query, b.id, round(coalesce(l.s, 0), 12) AS s FROM ids a CROSS JOIN ids b LEFT JOIN l ON l.query = a.id AND l.id = b.id WHERE a.id % 20 = 0),
  top AS MATERIALIZED (SELECT * FROM (SELECT query, id, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM f) WHERE rank <= {k})"""


_TOP = " SELECT query, id, round(s, 6) AS s, rank FROM top"
_REPORT = " SELECT query, string_agg(id || ':' || printf('%.6f', s), ' ' ORDER BY rank) AS neighbours FROM top WHERE rank BETWEEN 2 AND 6 GROUP BY query"


def _scores_sql(by: str, t: str, v: str) -> str:
    own, other = ("user_id", "item_id") if by == "user" else ("item_id", "user_id")
    return f"""{_top_sql(by, t, v, NEAR + 1)},
  y AS (SELECT p.user_id, p.item_id, sum(coalesce(x.x, 0)) AS a, sum(s * coalesce(x.x, 0)) AS w, sum(abs(s)) AS m FROM r p JOIN top ON query = p.{own} AND id <> query LEFT JOIN r x ON x.{own} = id AND x.{other} = p.{other} WHERE p.{own} % 20 = 0 GROUP BY ALL),
  b AS (SELECT {other}, sum(x) / ((SELECT count(DISTINCT {own}) FROM r) - 1) AS b FROM r GROUP BY {other})
SELECT user_id, item_id, round(CASE WHEN m > 0 THEN a / {NEAR} ELSE b END + 3, 6) AS average, round(CASE WHEN m > 0 THEN w / m ELSE b END + 3, 6) AS weighted FROM y JOIN b USING ({other})"""


def _sweep_sql() -> str:
    parts = []
    for k in SWEEP:
        parts.append(f"""SELECT {k} AS k, round(sqrt(avg((CASE WHEN m > 0 THEN a / {k} ELSE b END + 3 - score) ** 2)), 6) AS rmse_average, round(sqrt(avg((CASE WHEN m > 0 THEN w / m ELSE b END + 3 - score) ** 2)), 6) AS rmse_weighted
FROM (SELECT p.user_id, p.item_id, any_value(p.score) AS score, sum(coalesce(x.x, 0)) AS a, sum(s * coalesce(x.x, 0)) AS w, sum(abs(s)) AS m FROM r p JOIN top ON query = p.user_id AND id <> query AND rank <= {k + 1} LEFT JOIN r x ON x.user_id = id AND x.item_id = p.item_id WHERE p.user_id % 20 = 0 GROUP BY ALL) JOIN b USING (item_id)""")
    return f"{_R}, {_unit_sql('user_id')}, {_top_sql('user', 'u', 'unit', max(SWEEP) + 1)}, b AS (SELECT item_id, sum(x) / ((SELECT count(DISTINCT user_id) FROM r) - 1) AS b FROM r GROUP BY item_id) " + " UNION ALL ".join(parts)


def _figures_sql(prefix: str, condition: str, with_counts: bool) -> str:
    f = [f"count(*) FILTER ({condition} AND score = {k}) AS {prefix}_rated_{k}" for k in (1, 3, 5)]
    f += [f"count(*) FILTER ({condition}) AS {prefix}_ratings"] if with_counts else []
    return ", ".join([*f, f"round(avg(score) FILTER ({condition}), 6) AS {prefix}_average"])


SQL = {
    "knn_sweep": _sweep_sql(),
    "rating_stats": f"{_R} SELECT count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, {_figures_sql('all', 'true', False)}, {_figures_sql('user', f'user_id = {USER}', True)}, {_figures_sql('item', f'item_id = {ITEM}', True)} FROM r",
    "rating_user_norm": f"{_R}, {_unit_sql('user_id')} SELECT user_id, item_id, round(unit, 6) AS unit FROM u",
    "rating_item_norm": f"{_R}, {_unit_sql('item_id')} SELECT user_id, item_id, round(unit, 6) AS unit FROM u",
    "rating_item_std": f"{_R}, {_STD} SELECT user_id, item_id, round(unit, 6) AS unit FROM u",
    "rating_item_std_as_written": f"{_R}, {_AS_WRITTEN} SELECT user_id, item_id, round(unit, 6) + 0.0 AS unit FROM u",
    "item_sim_dot": _R + _ITEM_SIM.format(t="r", v="x"),
    "item_sim_cos": f"{_R}, {_unit_sql('item_id')}" + _ITEM_SIM.format(t="u", v="unit"),
    "item_sim_std": f"{_R}, {_STD}" + _ITEM_SIM.format(t="u", v="unit"),
    "user_sim_dot": f"{_R}, {_top_sql('user', 'r', 'x', NEAR + 1)}{_TOP}",
    "user_sim_cos": f"{_R}, {_unit_sql('user_id')}, {_top_sql('user', 'u', 'unit', NEAR + 1)}{_TOP}",
    "knn_topk_item": f"{_R}, {_unit_sql('item_id')}, {_top_sql('item', 'u', 'unit', NEAR + 1)}{_TOP}",
    "knn_report_user": f"{_R}, {_unit_sql('user_id')}, {_top_sql('user', 'u', 'unit', 6)}{_REPORT}",
    "knn_report_item": f"{_R}, {_top_sql('item', 'r', 'x', 6)}{_REPORT}",
    "knn_user_scores": f"{_R}, {_scores_sql('user', 'r', 'x')}",
    "knn_user_scores_cos": f"{_R}, {_unit_sql('user_id')}, {_scores_sql('user', 'u', 'unit')}",
    "knn_item_scores": f"{_R}, {_unit_sql('item_id')}, {_scores_sql('item', 'u', 'unit')}",
    "knn_std_scores": f"{_R}, {_STD}, {_scores_sql('item', 'u', 'unit')}",
}
