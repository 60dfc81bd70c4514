"""Display functions: speeds, places, protocols, freshness, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions.text import strip_control


def _whole(column: Column, unit: int) -> Column:
    return F.floor(column / F.lit(unit)).cast("bigint").cast("string")


def format_speed(mbps: Column) -> Column:
    return F.when(mbps >= 1_000_000, F.concat(_whole(mbps, 1_000_000), F.lit("T"))).when(mbps >= 1000, F.concat(_whole(mbps, 1000), F.lit("G"))).otherwise(F.concat(mbps.cast("string"), F.lit("M")))


def format_bandwidth(mbps: Column) -> Column:
    """Halves of a tenth go where the nearest double lies, as in C and Go; exact ones to the even tenth."""
    value = mbps.cast("double") / F.lit(1e6)
    # Multiples of the value near the number of half tenths: each step is exact in doubles.
    beyond = (value * 16 - F.floor(mbps / 50_000)) + value * 4
    low = F.floor(mbps / 100_000)
    up = (beyond > 0) | ((beyond == 0) & (low % 2 == 1))
    tenths = F.when(mbps % 100_000 == 50_000, low + F.when(up, 1).otherwise(0)).otherwise(F.floor((mbps + 50_000) / 100_000))
    tera = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" Tbps"))
    return F.when(mbps >= 1_000_000, tera).when(mbps >= 1000, F.concat(_whole(mbps, 1000), F.lit(" Gbps"))).otherwise(F.concat(mbps.cast("string"), F.lit(" Mbps")))


def speed_tier(mbps: Column) -> Column:
    return F.when(mbps >= 400_000, "400G").when(mbps >= 100_000, "100G").when(mbps > 1000, "10G").when(mbps == 1000, "1G").otherwise("sub-1G")


def policy_class(policy: Column) -> Column:
    low = F.lower(strip_control(policy))
    return F.when(low.isin("open", "selective", "restrictive"), low).otherwise("other")


def format_protocols(unicast: Column, multicast: Column, ipv6: Column) -> Column:
    return F.concat_ws(", ", F.when(unicast, "unicast"), F.when(multicast, "multicast"), F.when(ipv6, "IPv6"))


def join_present(*parts: Column) -> Column:
    """What isn't empty, joined by commas."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def format_location(city: Column, country: Column) -> Column:
    return join_present(strip_control(city), strip_control(country))


def format_address(first: Column, second: Column) -> Column:
    return join_present(first, second)


def format_freshness(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def entity_tag(version: Column) -> Column:
    """The first half of a SHA-256, as hexadecimal digits."""
    return F.substring(F.sha2(version.cast("string"), 256), 1, 32)


def on_map(latitude: Column, longitude: Column) -> Column:
    """Whether coordinates are set: not null, and not both zero."""
    return latitude.isNotNull() & longitude.isNotNull() & ((latitude != 0) | (longitude != 0))


#: The least width that shows a column of a section; other columns are always shown.
SHOWN_FROM = {
    "net-ix": {"speed": 50, "ipv4": 80, "crossref": 90, "rs": 70, "ipv6": 100},
    "net-fac": {"crossref": 70, "location": 60},
    "ix-participants": {"speed": 50, "ipv4": 80, "rs": 70, "ipv6": 100},
    "ix-facilities": {"crossref": 70, "location": 60},
    "ix-prefixes": {"dfz": 60},
    "fac-networks": {"crossref": 60},
    "fac-ixps": {"crossref": 60},
    "fac-carriers": {"crossref": 60},
}


def shown_columns(section: str, columns: list[str], width: int) -> list[str]:
    """Columns that fit a width; 0 shows all."""
    least = SHOWN_FROM.get(section, {})
    return [c for c in columns if width == 0 or width >= least.get(c, 0)]


#: Names of sections and what they stand for.
SECTION_ALIASES = {
    "ix": "ix",
    "exchanges": "ix",
    "fac": "fac",
    "facilities": "fac",
    "net": "net",
    "networks": "net",
    "participants": "net",
    "carrier": "carrier",
    "carriers": "carrier",
    "campus": "campus",
    "campuses": "campus",
    "contact": "contact",
    "contacts": "contact",
    "prefix": "prefix",
    "prefixes": "prefix",
}


def parse_sections(text: str) -> list[str]:
    """Known sections of a comma list, each once, in order."""
    found = [SECTION_ALIASES[p] for p in (p.strip().lower() for p in text.split(",")) if p in SECTION_ALIASES]
    return list(dict.fromkeys(found))


def whois_line(name: str, value: Column) -> Column:
    """A name and value line, or null for an empty value."""
    clean = strip_control(value.cast("string"))
    return F.when(clean != "", F.concat(F.lit(f"{name}:".ljust(16)), clean))


def whois_block(fields: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[whois_line(n, v) for n, v in fields])
