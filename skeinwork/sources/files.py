"""Readers of the text formats: every one gives a DataFrame with the columns its docstring names.

Line formats are parsed from ``(pos, value)`` tables, so a reader and a parser of lines already at hand are the same code. Lines that lack a
field or hold no number where one belongs are left out by the typed readers, as are blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)``: lines numbered from 0 in file order, files in order of their paths.

    Large files are read in blocks, each by one task in its order; a line's number is the lines of the blocks before its own plus its place there. Only one row a
    block is shuffled, never a line.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    counts = cut(raw.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")), "blocks")
    before = counts.select("f", "b", "first", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a block
    return raw.join(broadcast_if_small(before, counts.count(), 256), ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("pos"), "value")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _field(parts: Column | str, k: int, kind: str) -> Column:
    return F.get(parts, k).try_cast(kind)


def _parts(rows: DataFrame, separator: str) -> DataFrame:
    return rows.withColumn("p", F.split(F.trim("value"), separator))


def parse_ratings(rows: DataFrame) -> DataFrame:
    """``(pos, item_id, user_id, score)`` of 'movie,user,score[,...]'."""
    out = _parts(rows, ",").select("pos", _field("p", 0, "long").alias("item_id"), _field("p", 1, "long").alias("user_id"), _field("p", 2, "double").alias("score"))
    return out.filter("item_id IS NOT NULL AND user_id IS NOT NULL AND score IS NOT NULL")


def parse_pairs(rows: DataFrame) -> DataFrame:
    """``(pos, item_id, user_id)`` of 'movie,user[,...]'."""
    return _parts(rows, ",").select("pos", _field("p", 0, "long").alias("item_id"), _field("p", 1, "long").alias("user_id")).filter("item_id IS NOT NULL AND user_id IS NOT NULL")


def parse_user_pairs(rows: DataFrame) -> DataFrame:
    """``(pos, user_id, item_id)`` of the same lines, users first: the users in order of first appearance are those of :func:`topk.first_appearance`."""
    return parse_pairs(rows).select("pos", "user_id", "item_id")


def parse_vectors(rows: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)`` of 'term:freq term:freq ...', doc_id being the line number."""
    entries = rows.select(F.col("pos").alias("doc_id"), F.explode(F.split(F.trim("value"), r"\s+")).alias("e")).withColumn("p", F.split("e", ":"))
    return entries.select("doc_id", _field("p", 0, "int").alias("term"), _field("p", 1, "int").alias("tf")).filter("term IS NOT NULL AND tf IS NOT NULL")


def parse_dictionary(rows: DataFrame) -> DataFrame:
    """``(word, idx)`` of 'word index'."""
    return _parts(rows, r"\s+").select(F.get("p", 0).alias("word"), _field("p", 1, "int").alias("idx")).filter("idx IS NOT NULL")


def parse_document_frequencies(rows: DataFrame) -> DataFrame:
    """``(term, df)`` of 'term:df'."""
    return _parts(rows, ":").select(_field("p", 0, "int").alias("term"), _field("p", 1, "int").alias("df")).filter("term IS NOT NULL AND df IS NOT NULL")


def parse_clusters(rows: DataFrame) -> DataFrame:
    """``(doc_id, cluster_id)`` of 'doc cluster'."""
    return _parts(rows, r"\s+").select(_field("p", 0, "long").alias("doc_id"), _field("p", 1, "long").alias("cluster_id")).filter("doc_id IS NOT NULL AND cluster_id IS NOT NULL")


def parse_gold(rows: DataFrame, unlabelled: str = "unlabeled") -> DataFrame:
    """``(doc_id, label)``, a label a line; unlabelled lines are left out but still count."""
    return rows.select(F.col("pos").alias("doc_id"), F.trim("value").alias("label")).filter((F.col("label") != unlabelled) & (F.col("label") != ""))


def parse_edges(rows: DataFrame) -> DataFrame:
    """``(src, dst)`` of 'src dst ...'; repeated lines stay."""
    return _parts(rows, r"\s+").select(_field("p", 0, "long").alias("src"), _field("p", 1, "long").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def parse_distribution(rows: DataFrame) -> DataFrame:
    """``(query_name, user_id, query_id, topic_id, p)`` of 'user query 1:p 2:p ...'; the topic is the place, from 1, whatever its label."""
    head = _parts(rows, r"\s+").withColumn("user_id", _field("p", 0, "int")).withColumn("query_id", _field("p", 1, "int")).filter("size(p) > 2 AND user_id IS NOT NULL AND query_id IS NOT NULL")
    topics = head.select("user_id", "query_id", F.posexplode(F.expr("slice(p, 3, size(p) - 2)")).alias("k", "e"))
    return topics.select(F.concat_ws("-", "user_id", "query_id").alias("query_name"), "user_id", "query_id", (F.col("k") + 1).alias("topic_id"), F.get(F.split("e", ":"), 1).try_cast("double").alias("p"))


def parse_run(rows: DataFrame) -> DataFrame:
    """``(query_name, doc_id, rank, score, run)`` of 'query Q0 doc rank score run'; ``rows(value)`` may bring their own ``query_name``, as result files do in their names."""
    parts = _parts(rows, r"\s+")
    name = F.col("query_name") if "query_name" in rows.columns else F.get("p", 0)
    return parts.select(name.alias("query_name"), _field("p", 2, "long").alias("doc_id"), _field("p", 3, "int").alias("rank"), _field("p", 4, "double").alias("score"), F.get("p", 5).alias("run")).filter("doc_id IS NOT NULL")


def parse_document_topics(rows: DataFrame) -> DataFrame:
    """``(doc_id, topic_id)`` of 'doc topic'."""
    return _parts(rows, r"\s+").select(_field("p", 0, "long").alias("doc_id"), _field("p", 1, "int").alias("topic_id")).filter("doc_id IS NOT NULL AND topic_id IS NOT NULL")


def parse_values(rows: DataFrame) -> DataFrame:
    """``(pos, value)`` of one number a line."""
    return rows.select("pos", F.trim("value").try_cast("double").alias("value"))


def parse_classes(rows: DataFrame) -> DataFrame:
    """``(pos, hard, soft)`` of 'hard soft'."""
    return _parts(rows, r"\s+").select("pos", _field("p", 0, "int").alias("hard"), _field("p", 1, "double").alias("soft")).filter("hard IS NOT NULL AND soft IS NOT NULL")


def parse_rank(rows: DataFrame) -> DataFrame:
    """``(pos, doc_id, r)`` of 'doc score'."""
    return _parts(rows, r"\s+").select("pos", _field("p", 0, "long").alias("doc_id"), _field("p", 1, "double").alias("r")).filter("doc_id IS NOT NULL AND r IS NOT NULL")


def parse_stop_list(rows: DataFrame) -> DataFrame:
    """``(word)``: distinct words separated by white space."""
    return rows.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter("word <> ''").distinct()


def parse_cleaned(rows: DataFrame) -> DataFrame:
    """``(pos, stars, text)`` of 'stars<TAB>text'."""
    return rows.withColumn("p", F.split("value", "\t", 2)).select("pos", _field("p", 0, "int").alias("stars"), F.get("p", 1).alias("text")).filter("stars IS NOT NULL")


def parse_coded(rows: DataFrame) -> DataFrame:
    """``(pos, stars, ids)`` of 'stars<TAB>id id ...'."""
    ids = F.filter(F.transform(F.split(F.coalesce(F.get("p", 1), F.lit("")), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return rows.withColumn("p", F.split("value", "\t", 2)).select("pos", _field("p", 0, "int").alias("stars"), ids.alias("ids")).filter("stars IS NOT NULL")


def _reader(parse):
    def read(spark: SparkSession, path: str, **options) -> DataFrame:
        return parse(lines(spark, path), **options)

    read.__doc__ = parse.__doc__
    return read


ratings, query_pairs, user_pairs, vectors = _reader(parse_ratings), _reader(parse_pairs), _reader(parse_user_pairs), _reader(parse_vectors)
dictionary, document_frequencies, clusters, gold = _reader(parse_dictionary), _reader(parse_document_frequencies), _reader(parse_clusters), _reader(parse_gold)
edges, distribution, document_topics, values = _reader(parse_edges), _reader(parse_distribution), _reader(parse_document_topics), _reader(parse_values)
stop_list, cleaned, coded = _reader(parse_stop_list), _reader(parse_cleaned), _reader(parse_coded)
classes, rank_dump = _reader(parse_classes), _reader(parse_rank)


def zipped(spark: SparkSession, pairs: str, predicted: str, gold: str) -> DataFrame:
    """``(pos, item_id, user_id, predicted, actual)``: the query file and both lists of values, line by line; lines without a number in either list are left out."""
    p, g = values(spark, predicted).withColumnRenamed("value", "predicted"), values(spark, gold).withColumnRenamed("value", "actual")
    return query_pairs(spark, pairs).join(p, "pos").join(g, "pos").filter("predicted IS NOT NULL AND actual IS NOT NULL").select("pos", "item_id", "user_id", "predicted", "actual")


def named(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """``(file, value)``: the lines of the files in ``folder`` whose name, or that of the folder Spark wrote them to, begins with ``prefix``."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("f"))
    name = F.regexp_extract("f", r"/([^/]+?)(?:/part-[^/]*)?$", 1)
    return raw.select(name.alias("file"), "value").filter(F.col("file").startswith(prefix))


def run_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_name, doc_id, rank, score, run)`` of a folder of '<user>-<query>.results.txt' files, or folders of that name as Spark writes them; the name comes from there."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]*=)?([^/=]*?)\.results\.txt(?:/part-[^/]*)?$", 1)
    raw = spark.read.option("recursiveFileLookup", True).text(folder).select("value", name.alias("query_name"))
    return parse_run(raw.filter("query_name <> ''"))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, stars, text, review_id)`` of JSON lines; missing keys are null, lines that are no JSON are left out."""
    parsed = lines(spark, path).withColumn("j", F.from_json("value", "stars int, text string, review_id string"))
    return parsed.select("pos", "j.stars", "j.text", "j.review_id").filter("stars IS NOT NULL OR text IS NOT NULL OR review_id IS NOT NULL")


def constant_matrix(spark: SparkSession, rows: int, columns: int, value: float = 0.0) -> DataFrame:
    """``(i, j, value)``."""
    return spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"), F.lit(value).alias("value"))


def random_matrix(spark: SparkSession, rows: int, columns: int, *, density: float = 1.0, low: float = -0.5, high: float = 0.5, seed: int = 0) -> DataFrame:
    """``(i, j, value)`` uniform in low to high; with a density below 1 only that share of cells is kept. The same for a seed however it is partitioned."""
    cells = constant_matrix(spark, rows, columns).select("i", "j", (F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u"), (F.pmod(F.xxhash64("j", "i", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)).alias("keep"))
    return cells.filter(F.col("keep") < density).select("i", "j", (F.lit(low) + F.col("u") * (high - low)).alias("value"))
