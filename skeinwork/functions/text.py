"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: The default stop list.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
    "just me more my no not of on one or our out so some than that the their them then there they this to up us was we were what when which who will with would you your"
).split()


def tokens(text: Column) -> Column:
    """Words of a text: non-ASCII characters become spaces, punctuation is deleted, letters are lowered, tokens with a digit are dropped. Null gives null."""
    flat = F.lower(F.translate(F.regexp_replace(text, r"[^\x00-\x7F]", " "), PUNCTUATION, ""))
    return F.filter(F.split(flat, r"[ \t\n\x0B\f\r]+"), lambda w: (w != "") & ~w.rlike("[0-9]"))


def tokens_sql(column: str) -> str:
    """The same as DuckDB SQL."""
    kept = rf"regexp_replace(regexp_replace({column}, '[^\x00-\x7F]', ' ', 'g'), '[!-/:-@\[-`{{-~]', '', 'g')"
    return rf"list_filter(string_split_regex(lower({kept}), '[ \t\n\r\x0B\x0C]+'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]'))"
