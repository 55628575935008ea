"""Pieces of oversized texts by agglomerative merging at natural boundaries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT_LENGTH, PIECE_LIMIT, VOCABULARY, Encoder, encoder_of, read_vocabulary

#: Boundary strengths, weakest first.
INSIDE, WORD, SENTENCE, PARAGRAPH = 0, 1, 2, 3

#: Characters that end a sentence, and those that may follow it.
ENDERS = ".!?…。！？؟।"
CLOSERS = "\"')]}»”’」』"


class _Shapes(dict):
    """Pre-token to (tokens, starts with space, all space, newlines up to 2, ends a sentence, only closers)."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        body = piece.rstrip(CLOSERS)
        blank = piece.isspace()
        lines = min(piece.count("\n"), 2) if blank else 0
        flags = piece[0].isspace() | blank << 1 | lines << 2 | (body[-1:] != "" and body[-1] in ENDERS) << 4 | (body == "") << 5
        packed = (len(self.encoder[piece]) // 4) << 8 | flags
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= PIECE_LIMIT:
                self.clear()
            self[piece] = packed
        return packed


_shapes: list[_Shapes] = []


def shapes_of(encoder: Encoder) -> _Shapes:
    """The shapes of an encoder's pre-tokens; kept for the process, as the encoder is."""
    if not _shapes or _shapes[0].encoder is not encoder:
        _shapes[:] = [_Shapes(encoder)]
    return _shapes[0]


def boundary_strengths(flags: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each pre-token; the one before the first is PARAGRAPH.

    A run of white space has its cut after it, before the next word: PARAGRAPH with two newlines in the run, SENTENCE with
    one newline or after a sentence end, else WORD. All other boundaries are INSIDE, but SENTENCE after an ender that no space follows is not cut.
    """
    n = len(flags)
    spaced, blank, lines, ends, closer = flags & 1, flags >> 1 & 1, flags >> 2 & 3, flags >> 4 & 1, flags >> 5 & 1
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(blank == 0, at, -1))
    before = np.r_[-1, solid[:-1]]  # last pre-token before this one that isn't blank
    total_lines = np.r_[0, np.cumsum(lines)]
    newlines = total_lines[at] - total_lines[before + 1]
    opaque = np.maximum.accumulate(np.where((blank == 0) & (closer == 0), at, -1))
    word_before = np.where(before >= 0, opaque[before], -1)
    ended = (word_before >= 0) & (ends[word_before] == 1)
    cut = (blank == 0) & ((spaced == 1) | (before < at - 1))
    strength = np.where(newlines >= 2, PARAGRAPH, np.where((newlines == 1) | ended, SENTENCE, WORD))
    strength = np.where(cut, strength, INSIDE)
    strength[0] = PARAGRAPH
    return strength


def _heap_merge(sizes: list[int], room: int) -> list[int]:
    """Starts of the segments left when neighbours of one strength are merged, smallest sum first, then leftmost, while the sum fits."""
    n = len(sizes)
    sizes, right, left, alive = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(sizes[k] + sizes[k + 1], k, k + 1) for k in range(n - 1) if sizes[k] + sizes[k + 1] <= room]
    heapq.heapify(heap)
    while heap:
        size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or sizes[a] + sizes[b] != size:
            continue
        sizes[a], alive[b], right[a] = size, False, right[b]
        if right[b] < n:
            left[right[b]] = a
            if size + sizes[right[b]] <= room:
                heapq.heappush(heap, (size + sizes[right[b]], a, right[b]))
        if left[a] >= 0 and sizes[left[a]] + size <= room:
            heapq.heappush(heap, (sizes[left[a]] + size, left[a], a))
    return [k for k in range(n) if alive[k]]


def merge_segments(sizes: np.ndarray, strengths: np.ndarray, room: int) -> np.ndarray:
    """Starts (positions in ``sizes``) of the segments: weakest boundaries merge first, equal ones by smallest sum, then leftmost.

    A run of boundaries of one strength whose whole sum fits is merged at once, since then every merge in it fits;
    only the other runs need the heap.
    """
    starts = np.arange(len(sizes))
    for level in (INSIDE, WORD, SENTENCE, PARAGRAPH):
        own, strength = np.add.reduceat(sizes, starts), strengths[starts]
        joined = strength == level
        joined[0] = False
        heads = np.flatnonzero(~joined)
        sums = np.add.reduceat(own, heads)
        keep = ~joined
        for h in np.flatnonzero(sums > room):
            a, b = heads[h], heads[h + 1] if h + 1 < len(heads) else len(own)
            if b - a > 1:
                keep[a:b] = False
                keep[a + np.array(_heap_merge(own[a:b].tolist(), room))] = True
        starts = starts[keep]
    return starts


def _atoms(encoder: Encoder, piece: str, room: int) -> list[int]:
    """Token counts of the parts of a pre-token above ``room``: single tokens, joined where a character spans them."""
    bytes_of = encoder.transducer.bytes_of
    counts: list[int] = []
    for token in np.frombuffer(encoder[piece], np.int32).tolist():
        if counts and bytes_of[token][0] & 0xC0 == 0x80 and counts[-1] < room:
            counts[-1] += 1
        else:
            counts.append(1)
    return counts


def surely_fits(encoder: Encoder, pieces: list[str], limit: int) -> bool:
    """Whether the tokens can't exceed ``limit``: pre-tokens encoded before count as they are, others by their bytes, since a token has one at least."""
    most = 0
    for piece in pieces:
        known = encoder.get(piece)
        most += len(piece.encode()) if known is None else len(known) >> 2
        if most > limit:
            return False
    return True


def piece_bounds(encoder: Encoder, shapes: _Shapes, pieces: list[str], limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` in tokens of the pieces of a text given by its pre-tokens; each but the first starts ``overlap`` tokens before the end of the one before."""
    packed = np.fromiter(map(shapes.__getitem__, pieces), np.int64, len(pieces))
    sizes, flags = packed >> 8, packed & 255
    total = int(sizes.sum())
    if total <= limit:
        return [(0, total)]
    room = limit - overlap
    strengths = boundary_strengths(flags)
    if (sizes > room).any():
        cut = [_atoms(encoder, p, room) if s > room else [s] for p, s in zip(pieces, sizes.tolist())]
        first = np.cumsum([0] + [len(c) for c in cut[:-1]])
        sizes = np.fromiter((x for c in cut for x in c), np.int64)
        wide = np.zeros(len(sizes), np.int64)
        wide[first] = strengths
        strengths = wide
    ends = np.r_[0, np.cumsum(sizes)]
    starts = ends[merge_segments(sizes, strengths, room)].tolist()
    return [(max(0, a - overlap) if k else a, z) for k, (a, z) in enumerate(zip(starts, [*starts[1:], total]))]


def split_texts(
    texts: DataFrame, *, limit: int = 1024, overlap: int = 64, vocabulary: str = VOCABULARY, with_text: bool = True, only_split: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, piece, pieces, start_token, end_token[, text])``: the pieces of each text of at most ``limit`` tokens of the vocabulary.

    A text within the limit is one piece. Others begin as pre-tokens (a longer one as its tokens); neighbours merge,
    weakest boundary first (inside words, words, sentences, paragraphs), while both sizes plus ``overlap`` fit the limit.
    Consecutive pieces share ``overlap`` tokens; positions are those of the whole text's ids. ``text`` is the piece decoded, with U+FFFD where
    the overlap starts inside a character. Null and empty texts give no row; ``only_split`` leaves out texts of one piece. An empty table gives no row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be below the limit")
    shipped = texts.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # one vocabulary file
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start_token", pa.int32()), ("end_token", pa.int32())]
    schema = pa.schema(fields + ([("text", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        shapes = shapes_of(encoder)
        bytes_of = encoder.transducer.bytes_of
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                pieces = encoder.split(text)
                if only_split and surely_fits(encoder, pieces, limit):
                    continue
                bounds = piece_bounds(encoder, shapes, pieces, limit, overlap)
                if only_split and len(bounds) == 1:
                    continue
                ids = encoder.encode(text).tolist() if with_text and len(bounds) > 1 else None
                for k, (a, z) in enumerate(bounds):
                    row = [doc, k, len(bounds), a, z]
                    if with_text:
                        row.append(text if ids is None else b"".join(map(bytes_of.__getitem__, ids[a:z])).decode("utf-8", "replace"))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    source = texts.select(F.col(id_column).cast("long"), F.col(text_column).cast("string").alias("t"))
    if only_split:  # a token has a byte at least
        source = source.filter(F.octet_length("t") > limit)
    return source.mapInArrow(run, "doc_id long, piece int, pieces int, start_token int, end_token int" + (", text string" if with_text else ""))
