"""Which prefixes hold an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.net import address_bits, network_bits, prefix_bits


def addresses_in_prefixes(addresses: DataFrame, prefixes: DataFrame, address: str = "address", prefix: str = "prefix") -> DataFrame:
    """Pairs of rows whose address lies in the prefix, IPv4 and IPv6.

    A prefix is an equality on the leading bits, so the join is an ordinary equi-join on
    (family, length, network): an address looks for one network for each prefix length in use.
    These are a table of 162 rows at most, joined by family; no range or cross join is involved, and no Python.
    """
    parts = prefixes.withColumn("_p", prefix_bits(F.col(prefix))).where("_p IS NOT NULL")
    lengths = F.broadcast(parts.select(F.col("_p.family").alias("_family"), F.col("_p.length").alias("_length")).distinct())
    looked = addresses.withColumn("_a", address_bits(F.col(address))).where("_a IS NOT NULL").join(lengths, F.col("_a.family") == F.col("_family"))
    looked = looked.withColumn("_n", network_bits(F.col("_family"), F.col("_a.high"), F.col("_a.low"), F.col("_length")))
    on = [F.col("_family") == F.col("_p.family"), F.col("_length") == F.col("_p.length"), F.col("_n.high") == F.col("_p.high"), F.col("_n.low") == F.col("_p.low")]
    return looked.join(parts, on).drop("_a", "_n", "_p", "_family", "_length")


def numbers_in_ranges(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bits: int = 32) -> DataFrame:
    """Pairs of a number and a range around it, both ends included; numbers have ``bits`` bits.

    A range is a union of aligned blocks, two of each power of two at most, so it makes up to 2 * bits rows
    however wide it is.  A number lies in one block of each size: the join is an equi-join on
    (size, block), for the sizes in use, and each pair comes out once.
    """
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    left = lambda k: F.floor((F.col(low) + size(k) - 1) / size(k)).cast("bigint")
    end = lambda k: F.floor((F.col(high) + 1) / size(k)).cast("bigint")
    block = lambda k, at, there: F.when(there, F.struct(k.alias("k"), at.alias("at")))
    first = lambda k: block(k, left(k), (left(k) % 2 == 1) & (left(k) < end(k)))
    last = lambda k: block(k, end(k) - 1, (end(k) % 2 == 1) & (left(k) + left(k) % 2 < end(k)))
    levels = F.sequence(F.lit(0), F.lit(bits))
    blocks = F.filter(F.concat(F.transform(levels, first), F.transform(levels, last)), lambda b: b.isNotNull())
    listed = ranges.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(blocks))
    used = sorted(r["k"] for r in listed.select("_b.k").distinct().collect())
    asked = F.transform(F.array(*map(F.lit, used)).cast("array<int>"), lambda k: F.struct(k.alias("k"), F.floor(F.col(point) / size(k)).cast("bigint").alias("at")))
    return points.withColumn("_q", F.explode(asked)).join(listed, (F.col("_q.k") == F.col("_b.k")) & (F.col("_q.at") == F.col("_b.at"))).drop("_b", "_q")
