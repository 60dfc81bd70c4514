"""Addresses and prefixes as numbers, for joins.  Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a group of an IPv6 address.
_GROUP = "[0-9a-f]{1,4}"


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    shaped = F.regexp_like(address, F.lit(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"))
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    return F.when(shaped & (F.array_max(parts) <= 255), number)


def ipv4_range(prefix: Column) -> Column:
    """First and last address of an IPv4 prefix, as struct(low, high)."""
    base = ipv4_number(F.split_part(prefix, F.lit("/"), F.lit(1)))
    length = F.split_part(prefix, F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint")
    low = base - F.pmod(base, size)
    return F.when(base.isNotNull() & length.between(0, 32), F.struct(low.alias("low"), (low + size - 1).alias("high")))


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hex_number(groups: Column) -> Column:
    """Four groups of hexadecimal digits as 64 bits."""
    return F.aggregate(groups, F.lit(0).cast("bigint"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address in lower case; null for anything else."""
    some = f"({_GROUP}(:{_GROUP})*)?"
    listed = lambda part: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(part)), ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        missing = F.lit(8) - F.size(sides["left"]) - F.size(sides["right"])
        return F.when(missing >= 1, F.concat(sides["left"], F.array_repeat(F.lit("0"), missing), sides["right"]))

    short = _let(F.struct(listed(1).alias("left"), listed(2).alias("right")), filled)
    return F.when(F.regexp_like(text, F.lit(f"^({_GROUP}:){{7}}{_GROUP}$")), F.split(text, ":")).when(F.regexp_like(text, F.lit(f"^{some}::{some}$")), short)


def _ipv6_bits(address: Column) -> Column:
    def spelt(text: Column) -> Column:
        """An IPv4 address at the end becomes two groups."""
        ending = lambda n: F.concat(F.regexp_replace(text, "[0-9.]+$", ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(F.contains(text, F.lit(".")), _let(ipv4_number(F.regexp_extract(text, "([0-9.]+)$", 1)), ending)).otherwise(text)

    bits = lambda g: F.when(g.isNotNull(), F.struct(F.lit(6).alias("family"), _hex_number(F.slice(g, 1, 4)).alias("high"), _hex_number(F.slice(g, 5, 4)).alias("low")))
    return _let(_let(_let(F.regexp_replace(F.lower(address), "%[^%/]+$", ""), spelt), _groups), bits)


def address_bits(address: Column) -> Column:
    """struct(family, high, low): the bits of an IPv4 (32, in low) or IPv6 address as two longs; null for what is no address.

    IPv6 addresses may end in an IPv4 address and in a zone, which doesn't count; IPv4-mapped ones stay IPv6.
    """
    four = lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("high"), n.alias("low")))
    return F.when(F.contains(address, F.lit(":")), _ipv6_bits(address)).otherwise(_let(ipv4_number(address), four))


def address_number(address: Column) -> Column:
    """The same with both longs shifted so that their order as signed numbers is that of the addresses."""
    lowest = F.lit(-(1 << 63)).cast("bigint")
    shifted = lambda b: F.when(b.isNotNull(), F.struct(b["family"].alias("family"), b["high"].bitwiseXOR(lowest).alias("high"), b["low"].bitwiseXOR(lowest).alias("low")))
    return _let(address_bits(address), shifted)


def _mask(bits: Column) -> Column:
    """A long whose first ``bits`` bits are set: none below 1, all from 64 on."""
    ones = F.lit(-1).cast("bigint")
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, ones).otherwise(_shifted(ones, (F.lit(64) - bits).cast("int")))


def network_bits(family: Column, high: Column, low: Column, length: Column) -> Column:
    """struct(high, low) of the first ``length`` bits of an address, the others 0."""
    low_bits = F.when(family == 4, length + 32).otherwise(length - 64)
    return F.struct(F.when(family == 4, F.lit(0).cast("bigint")).otherwise(high.bitwiseAND(_mask(length))).alias("high"), low.bitwiseAND(_mask(low_bits)).alias("low"))


def prefix_bits(prefix: Column) -> Column:
    """struct(family, length, high, low) of a prefix, bits after the length 0; an address alone is a prefix of
    its full length; null for what is neither."""
    said = F.split_part(prefix, F.lit("/"), F.lit(2))

    def with_length(bits: Column) -> Column:
        most = F.when(bits["family"] == 4, 32).otherwise(128)
        length = F.when(~F.contains(prefix, F.lit("/")), most).when(F.regexp_like(said, F.lit("^[0-9]{1,3}$")), said.try_cast("int"))
        fits = bits.isNotNull() & (F.size(F.split(prefix, "/")) <= 2) & length.between(0, most)
        return F.when(fits, F.struct(bits["family"].alias("family"), length.alias("length"), bits["high"].alias("high"), bits["low"].alias("low")))

    def cut(p: Column) -> Column:
        network = network_bits(p["family"], p["high"], p["low"], p["length"])
        return F.when(p.isNotNull(), F.struct(p["family"].alias("family"), p["length"].alias("length"), network["high"].alias("high"), network["low"].alias("low")))

    return _let(_let(address_bits(F.split_part(prefix, F.lit("/"), F.lit(1))), with_length), cut)
