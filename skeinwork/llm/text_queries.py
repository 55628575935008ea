"""Queries on texts: token ids, leaked evaluation items, pieces of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .bpe import decode, encode
from .leaks import leaked_items
from .split import split_texts


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return decode(encode(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "evalitems")).filter("kind = 'exact'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "evalitems"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), with_text=False, only_split=True).filter("piece = 0").select("doc_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_pieces": p10_pieces}

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": r"""
WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS s FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM evalitems WHERE text IS NOT NULL),
     n AS (SELECT DISTINCT item_id, ' ' || array_to_string(a[k : k + least(10, len(a)) - 1], ' ') || ' ' AS p
           FROM (SELECT item_id, a, unnest(range(1, greatest(len(a) - 10, 0) + 2)) AS k FROM i WHERE len(a) > 0))
SELECT DISTINCT doc_id, item_id FROM w JOIN n ON contains(w.s, n.p)
""",
}
