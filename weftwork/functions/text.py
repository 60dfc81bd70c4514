"""Text functions: folding, literal parsing, cleaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that compatibility decomposition leaves whole.
LIGATURES = {
    "ß": "ss",
    "ẞ": "ss",
    "æ": "ae",
    "Æ": "ae",
    "œ": "oe",
    "Œ": "oe",
    "ø": "o",
    "Ø": "o",
    "ł": "l",
    "Ł": "l",
    "þ": "th",
    "Þ": "th",
    "đ": "d",
    "Đ": "d",
    "ð": "d",
    "Ð": "d",
    "ı": "i",
}
_LIGATURES = str.maketrans(LIGATURES)


def fold(text: str) -> str:
    """Lower case without diacritics: ligatures, decomposition, marks dropped."""
    if text.isascii():
        return text.lower()
    wide = unicodedata.normalize("NFKD", text.translate(_LIGATURES))
    return "".join(c for c in wide if unicodedata.category(c) != "Mn").lower()


@F.pandas_udf(T.StringType())
def fold_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``fold`` of a string column; null stays null.

    Decomposition has no built-in function, so columns are folded once when rows are
    merged, and queries read the stored copy.
    """
    for batch in batches:
        yield batch.map(fold, na_action="ignore")


#: Folding of the letters that the four corpus languages use, for ad-hoc queries.
_LATIN = "".join(map(chr, range(0xC0, 0x180)))


def fold_latin(column: Column) -> Column:
    """Folding by built-in functions, exact for ASCII and the Latin letters up to U+017F."""
    single = {c: f for c in _LATIN if len(f := fold(c)) == 1 and f != c}
    out = F.translate(F.lower(column), "".join(single), "".join(single.values()))
    for c in sorted({c.lower() for c in _LATIN if len(fold(c)) > 1}):
        out = F.replace(out, F.lit(c), F.lit(fold(c)))
    return out


def parse_asn(text: str) -> int | None:
    """A number literal with an optional AS before it, from 1 to 2**32 - 1."""
    m = re.fullmatch(r"(?:as)?([+-]?[0-9]+)", text.strip(), re.IGNORECASE | re.ASCII)
    number = int(m[1]) if m else 0
    return number if 0 < number <= 0xFFFFFFFF else None


def parse_asn_column(column: Column) -> Column:
    number = F.regexp_extract(F.trim(column), r"^(?:[aA][sS])?([+-]?[0-9]+)$", 1).try_cast("bigint")
    return F.when((number > 0) & (number <= 0xFFFFFFFF), number)


def strip_control(column: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(column, r"\p{Cc}", "")


def truncated(column: Column, width: int) -> Column:
    """At most ``width`` characters, the last three of a longer text being dots.

    Widths count characters; a byte count would cut letters apart.
    """
    if width <= 3:
        return column
    return F.when(F.length(column) > width, F.concat(F.left(column, F.lit(width - 3)), F.lit("..."))).otherwise(column)
