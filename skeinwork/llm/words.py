"""The words of a text, over whole Arrow batches."""

from __future__ import annotations

import pyarrow as pa

#: The 32 ASCII punctuation characters.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Every byte of a non-ASCII character becomes a space; letters become lower case.
_MAP = bytes(32 if b > 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_DIGITS = b"0123456789"


def word_lists(texts: pa.Array):
    """Yields for each text its words as a list of bytes; for a null text an empty list.

    Non-ASCII characters become spaces, ASCII punctuation is deleted, letters are lowered, the rest is split at ASCII
    white space and tokens holding a digit are dropped.
    """
    for text in texts:
        data = text.as_buffer() if text.is_valid else None
        if data is None or data.size == 0:
            yield []
            continue
        flat = data.to_pybytes().translate(_MAP, PUNCTUATION)
        tokens = flat.split()
        if flat.translate(None, _DIGITS) != flat:
            tokens = [t for t in tokens if t.translate(None, _DIGITS) == t]
        yield tokens


def word_sql(column: str) -> str:
    """DuckDB expression for the list of words of a text column."""
    kept = rf"regexp_replace(regexp_replace({column}, '[^\x00-\x7F]', ' ', 'g'), '[!-/:-@\[-`{{-~]', '', 'g')"
    split = rf"string_split_regex(lower({kept}), '[ \t\n\r\x0B\x0C]+')"
    return f"list_filter({split}, lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]'))"
