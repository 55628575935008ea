"""Byte-pair encoding by a lazily determinised transducer, and streaming decoding.

The merges define a nondeterministic transducer over bytes: it guesses where each token ends, and a guess is kept only
while neighbouring tokens may stand side by side, which for byte-pair encoding decides the whole segmentation. The
subset construction runs on demand: a state is the set of live guesses, each with the tokens it has not yet
emitted; what all guesses agree on is emitted. A guess lives at most as long as the longest token, so the
lookahead is bounded. States and transitions are kept and dropped together when they outgrow a limit.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary file; always a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pre-tokenisation pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: The same pattern for texts of ASCII characters only.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s"

STATE_LIMIT = 400_000
PIECE_LIMIT = 400_000
#: Longer pieces are encoded each time they come and not kept.
KEPT_LENGTH = 64

_NEVER = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines 'base64 id' of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], state_limit: int = STATE_LIMIT):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.state_limit = state_limit
        self._spines: dict[bytes, tuple[list, list]] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._moves: list[dict[int, tuple[tuple[int, ...], int]]] = []
        self._intern(((b"", -1, ()),))

    def _intern(self, state: tuple) -> int:
        number = self._number.get(state)
        if number is None:
            number = self._number[state] = len(self._states)
            self._states.append(state)
            self._moves.append({})
        return number

    def merge_all(self, data: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain merging, lowest rank first and left to right, with ranks under ``below``; used on single tokens only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: bytes) -> tuple[list, list]:
        """The pieces at the left edge and at the right edge while ``token`` is built: (bytes, rank it forms at, rank it is absorbed at)."""
        known = self._spines.get(token)
        if known is not None:
            return known
        if len(token) == 1:
            edges = ([(token, -1, _NEVER)], [(token, -1, _NEVER)])
        else:
            rank = self.ranks[token]
            halves = self.merge_all(token, rank)
            left = [(b, f, min(a, rank)) for b, f, a in self._spine(halves[0])[0]]
            right = [(b, f, min(a, rank)) for b, f, a in self._spine(halves[-1])[1]]
            edges = (left + [(token, rank, _NEVER)], right + [(token, rank, _NEVER)])
        self._spines[token] = edges
        return edges

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge ever crosses the boundary: no pieces beside it exist at once when their merge is due.

        At equal ranks merging goes left to right, so the first token's own merge comes before the crossing one and the second's after it.
        """
        key = (first, second)
        known = self._beside.get(key)
        if known is None:
            known = True
            for a, formed_a, gone_a in self._spine(self.bytes_of[first])[1]:
                for b, formed_b, gone_b in self._spine(self.bytes_of[second])[0]:
                    due = self.ranks.get(a + b, _NEVER)
                    if due != _NEVER and formed_a < due < gone_a and formed_b < due <= gone_b:
                        known = False
            if len(self._beside) > 4 * self.state_limit:
                self._beside.clear()
            self._beside[key] = known
        return known

    def _move(self, number: int, byte: int) -> tuple[tuple[int, ...], int]:
        step, ranks, live, closed = bytes((byte,)), self.ranks, [], None
        for partial, last, held in self._states[number]:  # longest partial first
            grown = partial + step
            if closed is None:  # one segmentation of what was read is right, so one guess at most closes here
                token = ranks.get(grown)
                if token is not None and (last < 0 or self.may_follow(last, token)):
                    closed = (b"", token, (*held, token))
            if grown in self.prefixes:
                live.append((grown, last, held))
        if closed is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(closed)
        agreed = live[0][2]
        if agreed:
            for _, _, held in live[1:]:
                k = 0
                while k < min(len(agreed), len(held)) and agreed[k] == held[k]:
                    k += 1
                agreed = agreed[:k]
        state = tuple((p, last, held[len(agreed) :]) for p, last, held in live) if agreed else tuple(live)
        move = (agreed, self._intern(state))
        self._moves[number][byte] = move
        return move

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token, in one pass over its bytes; one that is a token is its own encoding."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self._states) > self.state_limit:
            self._reset()
        moves, number, out = self._moves, 0, []
        for k, byte in enumerate(data):
            move = moves[number].get(byte)
            if move is None:
                move = self._move(number, byte)
            if move[0]:
                out.extend(move[0])
            number = move[1]
            if len(moves) > self.state_limit * 2:  # one long piece: keep the state, drop the rest
                state = self._states[number]
                self._reset()
                number, moves = self._intern(state), self._moves
        if data:
            out.extend(next(held for partial, _, held in self._states[number] if partial == b""))
        return out


class Encoder(dict):
    """Pre-token to its ids as packed 32-bit integers; made on first use."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        import regex

        self.transducer = transducer
        self.split_any = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall

    def split(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.transducer.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= PIECE_LIMIT:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), np.int32)


_encoders: dict[int, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """The encoder of a vocabulary file's bytes; one a process."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Transducer(load_ranks(data)))
    return _encoders[key]


class StreamDecoder:
    """Ids to text as they come. The state is the bytes of an unfinished character, three at most; malformed bytes become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.pending = bytes_of, b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many last bytes begin a character that more bytes could complete."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= byte < 0xF5 else 3 if byte >= 0xE0 and byte < 0xF0 else 2 if 0xC2 <= byte < 0xE0 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte's range depends on the first
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(map(self.bytes_of.__getitem__, ids))
        keep = self._unfinished(data)
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(texts: DataFrame, *, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: one row per row of ``texts``, ids of the text without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text. Texts are encoded
    whole. Null ids and repeated rows are kept as they come; an empty table gives no row.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # batches of long texts are passed on in parts
                packed, offsets, start = [], [0], at
                while at < batch.num_rows and offsets[-1] < 4_000_000:
                    text = batch.column(1)[at].as_py()
                    packed.append(b"".join(map(encoder.__getitem__, encoder.split(text))) if text else b"")
                    offsets.append(offsets[-1] + len(packed[-1]) // 4)
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), ids.cast(schema.field(1).type)], schema=schema)

    return texts.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY, chunk: int = 4096) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``, decoded as a stream of ``chunk`` ids at a time; a null list gives null, an unknown id fails."""
    shipped = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder_of(shipped.value).transducer.bytes_of
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                stream = StreamDecoder(bytes_of)
                texts.append("".join([stream.feed(ids[k : k + chunk]) for k in range(0, len(ids), chunk)]) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
