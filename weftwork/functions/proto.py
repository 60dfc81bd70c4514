"""Rows as protobuf messages: wire encoding by column functions.

A field is its tag and its value: a varint (numbers, booleans), or a length and so many bytes (texts, bytes, messages).
Fields are given in the order of their numbers.  A null is absent; so is a default (0, false, an empty text) unless its presence counts.
Bytes are put together as hexadecimal digits and turned into binary once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the value of a field is laid out.
VARINT, BYTES = 0, 2


def _varint_digits(value: Column) -> Column:
    """A long as a varint in hexadecimal digits: seven bits a byte, lowest first, the top bit set on all but the last; a negative one takes ten bytes."""
    bits = F.length(F.bin(value))
    n = F.ceil(bits / 7).cast("int")
    byte = lambda i: F.call_function("shiftrightunsigned", value, i * 7).bitwiseAND(127) + F.when(i < n - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def _tag(number: int, kind: int) -> str:
    value, out = number << 3 | kind, ""
    while True:
        value, low = value >> 7, value & 127
        out += f"{low | (128 if value else 0):02X}"
        if not value:
            return out


def number_field(number: int, value: Column, keep_default: bool = False) -> Column:
    """A whole number or boolean."""
    value = value.cast("bigint")
    shown = value.isNotNull() if keep_default else F.coalesce(value != 0, F.lit(False))
    return F.when(shown, F.concat(F.lit(_tag(number, VARINT)), _varint_digits(value))).otherwise("")


def bytes_field(number: int, value: Column, keep_default: bool = False) -> Column:
    """Binary, or a text in UTF-8, or a message that ``message`` made."""
    data = value.cast("binary")
    size = F.octet_length(data)
    shown = data.isNotNull() if keep_default else F.coalesce(size > 0, F.lit(False))
    return F.when(shown, F.concat(F.lit(_tag(number, BYTES)), _varint_digits(size.cast("bigint")), F.hex(data))).otherwise("")


def repeated_field(number: int, values: Column) -> Column:
    """An array of texts or messages: each a field of its own; empty ones are kept, nulls left out."""
    one = lambda v: bytes_field(number, v, keep_default=True)
    return F.coalesce(F.array_join(F.transform(values, one), ""), F.lit(""))


def timestamp_field(number: int, moment: Column) -> Column:
    """A message of seconds since 1970 and nanoseconds."""
    micros = F.unix_micros(moment.cast("timestamp"))
    rest = F.pmod(micros, F.lit(1_000_000))
    seconds = ((micros - rest).cast("decimal(20,0)") / F.lit(1_000_000)).cast("bigint")
    body = message([number_field(1, seconds), number_field(2, rest * 1000)])
    return F.when(moment.isNotNull(), bytes_field(number, body, keep_default=True)).otherwise("")


def message(fields: Sequence[Column]) -> Column:
    """The message's bytes."""
    return F.unhex(F.concat(*fields))
