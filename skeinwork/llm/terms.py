"""Term statistics and term weights of text and of sparse record vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut
from .radix import PARTIAL, radix_counts
from .words import word_lists

#: Distinct terms a map task holds before it passes its counts on.
FLUSH_TERMS = 400_000
_PARTIAL_ARROW = pa.schema([("fieldname", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("records", pa.int64())])


def clean_entries(vectors: DataFrame) -> DataFrame:
    """``(doc_id, term, f)``: distinct rows with a term and a freq above 0, freq summed by record and term.

    Null terms, null, zero and negative freqs are left out, as are rows with a null doc_id; extra columns count in telling rows apart.
    """
    kept = vectors.filter(F.col("doc_id").isNotNull() & F.col("term").isNotNull() & (F.col("freq") > 0)).distinct()
    return kept.groupBy("doc_id", "term").agg(F.sum(F.col("freq").cast("long")).alias("f"))


def _flush(field: str, total: dict, records: dict) -> pa.RecordBatch:
    terms = list(total)
    columns = [pa.array([field] * len(terms), pa.string()), pa.array([t if t is None else t.decode() for t in terms], pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([records[t] for t in terms], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTIAL_ARROW)


def text_partials(texts: DataFrame, column: str, field: str) -> DataFrame:
    """Partial counts of the words of a text column; the null term counts the records with at least one word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total, records = Counter(), Counter()
        for batch in batches:
            with_words = 0
            for words in word_lists(batch.column(0)):
                if words:
                    with_words += 1
                    total.update(words)
                    records.update(set(words))
            total[None] += with_words
            records[None] += with_words
            if len(total) > FLUSH_TERMS:
                yield _flush(field, total, records)
                total, records = Counter(), Counter()
        if total:
            yield _flush(field, total, records)

    return texts.select(F.col(column).cast("string")).mapInArrow(count, PARTIAL)


def vector_partials(entries: DataFrame, field: str) -> DataFrame:
    """Partial counts of the terms of clean entries, summed inside each map task: one a term and task, more only where a task holds above FLUSH_TERMS terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def fold() -> int:
            names, f, n = (np.concatenate(c) for c in zip(*held))
            terms, where = np.unique(names, return_inverse=True)
            total, records = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
            np.add.at(total, where, f)
            np.add.at(records, where, n)
            held[:] = [(terms, total, records)]
            return len(terms)

        def give() -> pa.RecordBatch:
            terms, total, records = held.pop()
            return pa.RecordBatch.from_arrays([pa.array([field] * len(terms), pa.string()), pa.array(terms.astype(str), pa.string()), pa.array(total), pa.array(records)], schema=_PARTIAL_ARROW)

        for batch in batches:
            terms = batch.column(0).to_numpy(zero_copy_only=False)
            held.append((terms, batch.column(1).to_numpy(zero_copy_only=False), np.ones(len(terms), np.int64)))
            if sum(len(x[0]) for x in held) > 2 * FLUSH_TERMS and fold() > FLUSH_TERMS:
                yield give()
        if held:
            fold()
            yield give()

    return entries.select(F.col("term").cast("long"), F.col("f").cast("long")).mapInArrow(count, PARTIAL)


def term_counts(vectors: DataFrame | None, texts: DataFrame | None, *, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """``(fieldname, term, total, records, n_records, mark)`` of every distinct term.

    ``vectors(doc_id, term, freq)`` give the field 'docvectors' (see :func:`clean_entries`), ``texts(text)`` the field
    'text', each row a record. mark: 'rare' below ``rare_below`` records, else 'common' above ``common_share`` of the
    records with at least one term, else null. Null, empty and blank texts hold no term. Empty tables give no row.
    """
    parts = []
    sizes = None
    if vectors is not None:
        entries = cut(clean_entries(vectors), "entries")
        parts.append(vector_partials(entries, "docvectors"))
        sizes = entries.agg(F.lit("docvectors").alias("__field"), F.count_distinct("doc_id").alias("n_records"))
    if texts is not None:
        parts.append(text_partials(texts, "text", "text"))
    partials = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counts = cut(radix_counts(partials), "counts")
    if texts is not None:
        of_text = counts.filter(F.col("term").isNull()).select(F.col("fieldname").alias("__field"), F.col("records").alias("n_records"))
        sizes = of_text if sizes is None else sizes.unionByName(of_text)
    joined = counts.filter(F.col("term").isNotNull()).join(F.broadcast(sizes), F.col("fieldname") == F.col("__field")).drop("__field")  # one row a field
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_share) * F.col("n_records"), "common")
    if common_share == 0.2:  # exact in integers
        mark = F.when(F.col("records") < rare_below, "rare").when(5 * F.col("records") > F.col("n_records"), "common")
    return joined.withColumn("mark", mark)


def _rarity(records, n_records):
    return F.log(F.lit(1.0) + n_records / records)


def _top_terms(weights: DataFrame, key: list[str], top: int, numeric: bool) -> DataFrame:
    tie = F.col("term").cast("long") if numeric else F.col("term")
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("weight"), tie))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= top)


def vector_weights(vectors: DataFrame, *, top: int = 3, measure: str = "frequency", window: int = 4) -> DataFrame:
    """``(doc_id, term, weight, rank)``: the ``top`` terms of each record of sparse vectors by weight, ties to the smaller term.

    weight = m * ln(1 + N / df), rounded to 6 decimals; N records with a clean entry, df records holding the term. m is
    the summed freq (measure='frequency'), or the number of other distinct terms within ``window`` - 1 entries in the order of pos
    (measure='degree', graph of words). See :func:`clean_entries` for rows left out; an empty table gives no row.
    """
    entries = cut(clean_entries(vectors), "entries")
    by_term = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = entries.agg(F.count_distinct("doc_id").alias("n"), F.count_distinct("term").alias("t")).first()
    if sizes["t"] * 24 <= BROADCAST_BYTES:
        by_term = F.broadcast(by_term)
    measured = entries if measure == "frequency" else vector_degrees(vectors, window)
    weight = F.round(F.col("f") * _rarity(F.col("df"), F.lit(float(sizes["n"]))), 6)
    return _top_terms(measured.join(by_term, "term").select("doc_id", "term", weight.alias("weight")), ["doc_id"], top, True)


def vector_degrees(vectors: DataFrame, window: int, block: int = 100_000) -> DataFrame:
    """``(doc_id, term, f)``: f = distinct other terms within ``window`` - 1 clean entries of the term, in the order of pos.

    Records are laid out in blocks of ``block`` positions that share their first ``window`` - 1 positions with the block before, so
    no task sorts a whole hot record. Entries of one place follow each other by term.
    """
    kept = vectors.filter(F.col("doc_id").isNotNull() & F.col("pos").isNotNull() & F.col("term").isNotNull() & (F.col("freq") > 0))
    rows = kept.select("doc_id", "pos", "term").distinct()
    blocks = F.array_distinct(F.array(F.floor(F.col("pos") / block), F.floor((F.col("pos") - (window - 1)) / block)))
    laid = rows.withColumn("b", F.explode(blocks))
    order = W.partitionBy("doc_id", "b").orderBy("pos", "term")
    for d in range(1, window):
        laid = laid.withColumn(f"z{d}", F.lead("term", d).over(order))
    ahead = F.array(*(f"z{d}" for d in range(1, window)))
    edges = laid.select("doc_id", F.col("term").alias("a"), F.explode(ahead).alias("z")).filter(F.col("z").isNotNull() & (F.col("a") != F.col("z")))
    both = edges.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("z").alias("o")), F.struct(F.col("z").alias("term"), F.col("a").alias("o")))).alias("e"))
    degrees = both.select("doc_id", "e.term", "e.o").distinct().groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("f"))
    every = rows.select("doc_id", "term").distinct()
    return every.join(degrees, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("f", F.lit(0)).alias("f"))


def _measure(words: list[bytes], measure: str, window: int) -> dict:
    from collections import Counter

    if measure == "frequency":
        return Counter(words)
    edges = set()
    for d in range(1, window):
        edges.update(zip(words, words[d:]))
    edges.update([(b, a) for a, b in edges])
    degrees = Counter(a for a, b in edges if a != b)
    return {w: degrees.get(w, 0) for w in set(words)}


def _six_places(x: float) -> float:
    """Rounded as Spark's round does: half up on the shortest decimal form."""
    scaled = x * 1e6
    if abs(scaled - math.floor(scaled) - 0.5) > 1e-4:
        return round(x, 6)
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _best(measured: dict, rarity: dict, top: int) -> list[tuple[float, bytes]]:
    weights = [m * rarity[w] for w, m in measured.items()]
    if len(weights) > top:
        least = sorted(weights)[-top] - 2e-6
        scored = [(-_six_places(x), w) for x, w in zip(weights, measured) if x >= least]
    else:
        scored = [(-_six_places(x), w) for x, w in zip(weights, measured)]
    return sorted(scored)[:top]


def text_weights(texts: DataFrame, *, top: int = 3, measure: str = "frequency", window: int = 4, dictionary_bytes: int = BROADCAST_BYTES // 2) -> DataFrame:
    """``(doc_id, term, weight, rank)``: the ``top`` words of each text by weight, ties in byte order; each row of ``texts(doc_id, text)`` is a record.

    Weights as in :func:`vector_weights`, with the words of a text in its order. The rarity of all words goes to the tasks
    as one dictionary where it fits ``dictionary_bytes``; a larger vocabulary is joined by shuffle. Null, empty and blank texts give no row.
    """
    spark = texts.sparkSession
    counts = cut(radix_counts(text_partials(texts, "text", "text")), "counts")
    size = counts.agg(F.sum(F.length("term") + 72).alias("b"), F.max(F.when(F.col("term").isNull(), F.col("records"))).alias("n")).first()
    n_records = float(size["n"] or 0)
    source = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if (size["b"] or 0) <= dictionary_bytes:
        words = counts.filter(F.col("term").isNotNull()).select("term", _rarity(F.col("records"), F.lit(n_records)).alias("rarity")).toArrow()
        rarity = spark.sparkContext.broadcast({t.encode(): r for t, r in zip(words.column(0).to_pylist(), words.column(1).to_pylist())})
        schema = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("weight", pa.float64()), ("rank", pa.int32())])

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = rarity.value
            for batch in batches:
                out: tuple[list, list, list, list] = ([], [], [], [])
                for doc, words in zip(batch.column(0).to_pylist(), word_lists(batch.column(1))):
                    if words:
                        for k, (w, t) in enumerate(_best(_measure(words, measure, window), table, top)):
                            for column, value in zip(out, (doc, t.decode(), -w, k + 1)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        return source.mapInArrow(weigh, "doc_id long, term string, weight double, rank int")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("term", pa.string()), ("f", pa.int64())])

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for row, doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), word_lists(batch.column(2))):
                for t, m in _measure(words, measure, window).items():
                    for column, value in zip(out, (row, doc, t.decode(), m)):
                        column.append(value)
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    # numbered rows are written once, so that repeated doc_ids stay apart and numbers never change
    numbered = cut(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    measured = numbered.mapInArrow(measures, "row long, doc_id long, term string, f long")
    weight = F.round(F.col("f") * _rarity(F.col("records"), F.lit(n_records)), 6)
    weights = measured.join(counts.select("term", "records"), "term").select("row", "doc_id", "term", weight.alias("weight"))
    return _top_terms(weights, ["row"], top, False).drop("row")


def term_weights(vectors: DataFrame, texts: DataFrame, **options) -> DataFrame:
    """``(fieldname, doc_id, term, weight, rank)`` of :func:`vector_weights` ('docvectors') and :func:`text_weights` ('text'), each with its own N and df."""
    a = vector_weights(vectors, **options).select(F.lit("docvectors").alias("fieldname"), "doc_id", F.col("term").cast("string"), "weight", "rank")
    b = text_weights(texts, **options).select(F.lit("text").alias("fieldname"), "doc_id", "term", "weight", "rank")
    return a.unionByName(b)
