"""Evaluation items found in texts, by hash-joined windows of canonical templates.

Numbers, names and units become typed placeholders, so windows of an item and of a text that differ only in such slots have one
template. Windows of all items are one table, and the texts are scanned once: of each text those windows whose hash may be an item's are
joined with it by the hash. Then the slots are compared: all equal is an exact leak, else each value has to stand for one value throughout the
window for a re-parameterised one.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: Unit words, and numbers in words.
UNITS = (
    "percent second seconds minute minutes min mins hour hours hr hrs day days week weeks month months year years "
    "inch inches foot feet ft yard yards mile miles km kilometre kilometres kilometer kilometers metre metres meter meters cm mm "
    "gram grams g kg kilo kilos kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes "
    "litre litres liter liters ml gallon gallons degree degrees celsius fahrenheit "
    "dollar dollars cent cents euro euros pence usd eur gbp mb gb tb kb hz khz mhz ghz mph kph"
).split()

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

#: Bits of a window's hash the texts are sieved by, and bytes of an item's window.
FILTER_BITS, WINDOW_BYTES = 22, 256
_P, _64 = 0x9E3779B97F4A7C15, (1 << 64) - 1

plain_words = re.compile(r"[a-z0-9]+").findall
_cased_words = re.compile(r"[A-Za-z0-9]+").findall
_sentences = re.compile(r"[.!?:]\s+|\n+").split


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


class Canon(dict):
    """Plain word to the code of its canonical form: numbers and units by their spelling, names by the lexicon. A word that begins with a digit is a number."""

    LIMIT = 1_000_000
    NUMBER, UNIT, NAME = (_code(x) for x in ("<number>", "<unit>", "<name>"))

    def __init__(self, names: set[str], units: Collection[str] = UNITS, number_words: Collection[str] = NUMBER_WORDS):
        super().__init__()
        self.names, self.units, self.numbers = names, set(units), set(number_words)

    def __missing__(self, word: str) -> int:
        code = self.NUMBER if word[0].isdigit() or word in self.numbers else self.NAME if word in self.names else self.UNIT if word in self.units else _code(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code
        return code


def cased(text: str) -> str:
    """Its runs of ``[A-Za-z0-9]`` are the plain words of the text, each letter in the text's own case."""
    if text.isascii():
        return text
    out = []
    for c in text:
        low = c.lower()
        out.append(low.upper() if low.isascii() and c.isupper() else low)
    return "".join(out)


def words_by_case(text: str) -> tuple[list[bool], list[bool]]:
    """For each plain word of the text: whether it has a capital, and whether it begins a sentence."""
    capital: list[bool] = []
    initial: list[bool] = []
    for sentence in _sentences(cased(text)):
        words = _cased_words(sentence)
        capital.extend([w[0].isupper() for w in words])
        initial.extend([k == 0 for k in range(len(words))])
    return capital, initial


def own_names(words: list[str], capital: list[bool], initial: list[bool]) -> tuple[set[str], set[str]]:
    """Names of one text, which it never writes without a capital: those inside sentences, and those that only begin one."""
    lower = {w for w, c in zip(words, capital) if not c}
    inner = {w for w, c, i in zip(words, capital, initial) if c and not i} - lower
    return inner, {w for w, c in zip(words, capital) if c} - lower - inner


def item_lexicon(items: DataFrame) -> tuple[set[str], set[str]]:
    """``(names, ordinary)`` words of all ``items(text)``: names have a capital inside sentences and are never in lower case; the rest is ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for word, capital, initial in zip(plain_words(text.lower()), *words_by_case(text)):
                    seen[word] = seen.get(word, 0) | (0 if word[0].isdigit() else 1 if not capital else 0 if initial else 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int32())], names=["word", "cases"])

    cases = items.select("text").mapInArrow(run, "word string, cases int").groupBy("word").agg(F.bit_or("cases").alias("cases")).collect()
    return {r["word"] for r in cases if r["cases"] == 2}, {r["word"] for r in cases if r["cases"] != 2}


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` codes, by its start."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    out, done, doubled, width = None, 0, codes, 1
    power, rest = _P, size
    while True:  # windows of powers of two, joined by the binary digits of the size
        if rest & 1:
            part = doubled[done : done + len(codes) - size + 1]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        rest >>= 1
        if not rest:
            break
        doubled = doubled[:-width] * np.uint64(power) + doubled[width:]
        width, power = 2 * width, power * power & _64
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


_WINDOWS = "hash long, item_id long, other boolean, size int, words array<string>"
_CANDIDATES = "row long, doc_id long, hash long, first boolean, n long, words array<string>"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def item_windows(items: DataFrame, size: int, names: set[str], units: Collection[str], number_words: Collection[str], own: bool) -> DataFrame:
    """``(hash, item_id, other, size, words)``: template windows of ``size`` words, or the whole of a shorter item.

    Names are those of the lexicon of all items. With ``own``, a window that holds other names of its own item is there a second time, as ``other``.
    """
    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("other", pa.bool_()), ("size", pa.int32()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(names, units, number_words)
        fixed = (np.uint64(Canon.NUMBER), np.uint64(Canon.UNIT))
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(text.lower())
                if not words:
                    continue
                width = min(size, len(words))
                codes = np.fromiter(map(canon.__getitem__, words), np.uint64, len(words))
                hashes = window_hashes(codes, width)
                rows = [(int(h), item, False, width, words[k : k + width]) for k, h in enumerate(hashes.view(np.int64))]
                inner = own_names(words, *words_by_case(text))[0] - names if own else ()
                if inner:
                    wider = np.fromiter((Canon.NAME if w in inner and c not in fixed else c for w, c in zip(words, codes)), np.uint64, len(words))
                    again = window_hashes(wider, width)
                    rows.extend((int(again.view(np.int64)[k]), item, True, width, words[k : k + width]) for k in np.flatnonzero(again != hashes).tolist())
                for start in range(0, len(rows), 50_000):
                    yield _rows(rows[start : start + 50_000], schema)

    return items.select("item_id", "text").mapInArrow(run, _WINDOWS)


def _candidates(sieve: np.ndarray, sizes: list[int], names: set[str], ordinary: set[str], units: Collection[str], number_words: Collection[str], own: bool):
    """Windows of texts that pass the sieve: ``first`` with the names of the lexicon, the others with the text's own; n alike in a text."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("first", pa.bool_()), ("n", pa.int64()), ("words", pa.list_(pa.string()))])

    def passing(codes: np.ndarray, size: int, ends: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, texts and hashes of windows inside one text that pass and whose hash is none of ``held``, to which all are added."""
        hashes = window_hashes(codes, size)
        maybe = sieve[hashes >> np.uint64(64 - FILTER_BITS)]
        for before in held:
            maybe &= hashes != before
        held.append(hashes)
        at = np.flatnonzero(maybe)
        text = np.searchsorted(ends, at, "right")
        inside = at + size <= ends[text]
        return at[inside], text[inside], hashes[at[inside]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(names, units, number_words)
        for batch in batches:
            numbers, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words: list[str] = []
            lengths, marks = np.zeros(batch.num_rows, np.int64), bytearray()
            for k, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                mine = plain_words(text.lower())
                words.extend(mine)
                lengths[k] = len(mine)
                if own:
                    inner, initial = own_names(mine, *words_by_case(text))
                    kind = {w: 1 + 2 * (w in ordinary) for w in inner} | {w: 2 + 2 * (w in ordinary) for w in initial}
                    marks.extend([kind.get(w, 0) for w in mine])
            if not words:
                continue
            codes, ends = np.fromiter(map(canon.__getitem__, words), np.uint64, len(words)), np.cumsum(lengths)
            views = [codes]
            if own:  # again, with each text's own names
                # 1: inside sentences, 2: only at the begin of one, 3 and 4: likewise, but ordinary words of the items. A word that begins a sentence
                # may be either, and so may any in a text of capitals only
                mark = np.frombuffer(marks, np.uint8) * ((codes != np.uint64(Canon.NUMBER)) & (codes != np.uint64(Canon.UNIT)))
                views += [np.where(np.isin(mark, kinds), np.uint64(Canon.NAME), codes) for kinds in ((1, 3), (1, 2, 3), (1, 2, 3, 4), (1, 2))]
            seen: dict[tuple, int] = {}
            for size in sizes:
                held: list[np.ndarray] = []
                for view, of in enumerate(views):
                    for at, text, h in zip(*(x.tolist() for x in passing(of, size, ends, held))):
                        key = (text, h - (1 << 64) if h >> 63 else h, view == 0, tuple(words[at : at + size]))
                        seen[key] = seen.get(key, 0) + 1
                    if len(seen) > 200_000:
                        yield _rows([(numbers[t], docs[t], h, first, n, w) for (t, h, first, w), n in seen.items()], schema)
                        seen.clear()
            yield _rows([(numbers[t], docs[t], h, first, n, w) for (t, h, first, w), n in seen.items()], schema)

    return run


def leaked_items(
    texts: DataFrame, items: DataFrame, *, size: int = 10, reparameterised: bool = True, least_equal: float = 0.5, units: Collection[str] = UNITS, number_words: Collection[str] = NUMBER_WORDS
) -> DataFrame:
    """``(doc_id, item_id, kind, windows)``: texts holding ``size`` consecutive plain words of an item, or all words of a shorter item.

    kind 'exact', or 'reparameterised' where only numbers, names and units differ, consistently (each value of the item stands for one of the text and the other way
    round), and at least the share ``least_equal`` of the window's words is the same; ``windows`` counts the matching window pairs of that kind (of a re-parameterised
    hit with names the items never use, at least one). Items without a word match nothing; null, empty and blank texts hold nothing. A number is a word that begins with a
    digit or is one of ``number_words``, a unit one of ``units``; a name is a word that the items write with a capital inside sentences and never in lower case, or one
    that the single item or text never writes without a capital. Repeated text rows give repeated rows; equal items are reported each. Empty tables give no row.

    The texts are scanned once, however many items there are. The items' windows are broadcast where their counted number is small and else joined by shuffle.
    """
    spark = texts.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    names, ordinary = item_lexicon(given) if reparameterised else (set(), set())
    units, number_words = set(units), set(number_words)
    windows = cut(item_windows(given, size, names, units, number_words, reparameterised), "windows")
    count = windows.count()
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``size`` many
    sieve = np.zeros(1 << FILTER_BITS, bool)
    bits = windows.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("b")).distinct().toArrow()  # at most 2 ** FILTER_BITS many
    sieve[bits.column(0).to_numpy()] = True
    shipped = spark.sparkContext.broadcast((sieve, sizes, names, ordinary, units, number_words, reparameterised))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _candidates(*shipped.value)(batches)

    source = texts.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = broadcast_if_small(windows.select("hash", "item_id", "other", F.col("words").alias("wanted")), count, WINDOW_BYTES)
    met = source.mapInArrow(run, _CANDIDATES).join(wanted, "hash").filter(F.size("words") == F.size("wanted"))
    same = F.col("words") == F.col("wanted")
    pairs = F.arrays_zip("wanted", "words")
    equal = F.aggregate(F.zip_with("wanted", "words", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    values = F.size(F.array_distinct(pairs))
    agree = (F.size(F.array_distinct("wanted")) == values) & (F.size(F.array_distinct("words")) == values) & (equal >= F.lit(least_equal) * F.size("words"))
    by_lexicon = F.col("first") & ~F.col("other")
    kinds = F.when(same, F.when(by_lexicon, 1)).when(F.lit(reparameterised) & agree, F.when(by_lexicon, 2).otherwise(3))
    judged = met.select("row", "doc_id", "item_id", "n", kinds.alias("kind")).filter("kind IS NOT NULL")
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    hits = judged.groupBy("row", "doc_id", "item_id").agg(total(1).alias("exact"), F.greatest(total(2), F.max((F.col("kind") == 3).cast("long"))).alias("other"))
    exact = F.col("exact") > 0
    return hits.select("doc_id", "item_id", F.when(exact, "exact").otherwise("reparameterised").alias("kind"), F.when(exact, F.col("exact")).otherwise(F.col("other")).cast("int").alias("windows"))
