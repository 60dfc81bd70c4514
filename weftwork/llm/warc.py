"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: request, response (or revisit, where an
earlier capture has the same payload) and metadata.  WARC-Concurrent-To ties request and
metadata to the response.  ``read_records`` gives one row per record, and ``assemble`` joins
them through these identifiers, in either direction, to one nested row per capture.  ``read_captures`` gives the same rows with
payloads where they were read: the task that parses an archive joins what lies in it, and only records that
name, or are named by, records of other archives are joined by a shuffle.  Captures are a table, and what follows reads the columns it needs.

Archives are written by Spark's text writer with the record separator as line end, and
read as whole files, so any storage that Spark reaches will do.  Captures of like size share
archives, so that none holds more than about 16 MB before compression, or a single capture.

Defined results: a null payload is empty; a null url writes no target; a null page_id is kept
as null and comes after all others when the smallest is chosen.  Repeated rows are
captures of their own: the first of them is the response.  An empty table gives no records.  A very
long page is an archive of its own, and takes its size a few times in the tasks that write and parse it.
Identifiers that an archive holds aren't looked up in others.
Records that no other names, or that name a missing one, are left out of captures but
stay in ``read_records``.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

#: Line end, record end and version line of the format.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Types of records that a capture is made around.
MAIN = ("response", "revisit", "resource")
#: Fixed value: the base-32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a binary column."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(name: Column) -> Column:
    digits = F.md5(name)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cut]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text without the record end; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{CRLF}{name}: "), value) for name, value in headers]
    head = F.concat(F.lit(VERSION), *[F.coalesce(line, F.lit("")) for line in lines])
    return F.concat(head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


#: Largest payload of each class of captures that share archives; what is larger has one of its own.
CLASS_BYTES = tuple(1 << k for k in range(10, 24, 2))


def size_class(payload_bytes: Column) -> Column:
    """The number of the first class that the payload fits, or that of the class without a limit."""
    out = F.lit(len(CLASS_BYTES))
    for k in reversed(range(len(CLASS_BYTES))):
        out = F.when(payload_bytes <= CLASS_BYTES[k], k).otherwise(out)
    return out


def with_decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add payload_digest, payload_bytes, size_class, of_row and whether each capture is a response.

    Among equal payloads of ``min_bytes`` or more, the first by (page_id, row) is the
    response; digests are grouped before anything is joined.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row_id"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = common.materialize(rows.withColumn("size_class", size_class(F.col("payload_bytes"))), "captures", by="size_class")
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row_id")
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = common.materialize(firsts.select("payload_digest", F.col("payload_bytes").alias("b"), F.col("first.row_id").alias("first_row")), "firsts")
    # Payloads that surely have no equal bypass the join.
    marked = common.with_likely(rows, firsts, "payload_digest")
    likely, alone = marked.where("_likely").drop("_likely"), marked.where("NOT _likely").drop("_likely")
    firsts = firsts.withColumnRenamed("payload_digest", "d").hint("merge")
    joined = likely.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left").drop("d", "b")
    every = joined.union(alone.withColumn("first_row", F.lit(None).cast("long")))
    return every.withColumn("of_row", F.coalesce("first_row", "row_id")).withColumn("is_response", F.col("of_row") == F.col("row_id")).drop("first_row")


def archive_records(decided: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the records, those of a capture next to one another."""
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    name = lambda kind, row="row_id": _urn(F.concat(F.lit(kind), F.col(row).cast("string")))
    page = F.col("page_id").cast("string")
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    when = F.lit(date)
    path = F.coalesce(F.regexp_replace(target, r"^[a-zA-Z]+://[^/]*", ""), F.lit("/"))
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", name("request")),
            ("WARC-Date", when),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", name("response")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    common_headers = [("WARC-Record-ID", name("response")), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Page-ID", page), ("WARC-Payload-Digest", digest)]
    response = _record([("WARC-Type", F.lit("response")), *common_headers, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(status, F.col("payload")))
    revisit = _record(
        [
            ("WARC-Type", F.lit("revisit")),
            *common_headers,
            ("WARC-Refers-To", name("response", "of_row")),
            ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        status,
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name("metadata")), ("WARC-Date", when), ("WARC-Concurrent-To", name("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageBytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
    )
    return decided.select(F.explode(F.array(request, F.when(F.col("is_response"), response).otherwise(revisit), metadata)).alias("value"))


def captures_per_archive(kind: int, most_bytes: int = 16 << 20, headers: int = 1500) -> int:
    """How many captures of a size class surely fit an archive of ``most_bytes``, one at least."""
    return max(1, most_bytes // (CLASS_BYTES[kind] + headers)) if kind < len(CLASS_BYTES) else 1


def class_groups(counts: list[tuple[int, int, int]]) -> list[list[int]]:
    """Size classes that are written together, from (class, captures, payload bytes): neighbours join while
    the mean payload stays above an eighth of the largest class's limit, so that archives aren't tiny."""
    groups: list[list[int]] = []
    n = size = 0
    for kind, captures, payload in sorted(counts):
        n, size = n + captures, size + payload
        if groups and kind < len(CLASS_BYTES) and 8 * size >= n * CLASS_BYTES[kind]:
            groups[-1].append(kind)
        else:
            groups.append([kind])
            n, size = captures, payload
    return groups


def write_archives(decided: DataFrame, path: str, most_bytes: int = 16 << 20) -> None:
    """Write the captures' archives, gzip-compressed as a whole, each record ended as the format asks.

    One write for each group of size classes; its files hold as many captures as surely
    fit ``most_bytes``, however sizes are spread over the input.
    """
    counts = decided.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("size")).collect()
    for kinds in class_groups([tuple(row) for row in counts]):
        records = archive_records(decided.where(F.col("size_class").isin(kinds)))
        most = 3 * captures_per_archive(kinds[-1], most_bytes)
        records.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, str] = {}
        for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            name, text = key.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")
            # The one header that may come several times.
            headers[name] = f"{headers[name]} {text}" if name == "warc-concurrent-to" and name in headers else text
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, block
        at = end + 4 + size


RECORDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target string, page_id long, "
    "headers map<string,string>, block_bytes long, payload binary, payload_bytes long, payload_digest string, archive string"
)


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header in HTTP records; else the block."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _fields(h: dict[str, str], block: bytes) -> tuple:
    """A record's fields from headers and block; payload size and digest are of the bytes read."""
    payload, page = _payload(h, block), h.get("warc-page-id")
    digest = b32encode(hashlib.sha1(payload).digest()).decode()
    return h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to", "").split(), h.get("warc-refers-to"), h.get("warc-target-uri"), int(page) if page else None, list(h.items()), len(block), payload, len(payload), digest


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [part.split(" ")[0] for part in re.sub(r"<.*?>", "", RECORDS).split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            rows, size, archive = [], 0, batch.column("path")[i].as_py()
            for h, block in parse(batch.column("content")[i].as_py()):
                rows.append((*_fields(h, block), archive))
                size += len(block)
                if size > 8 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives in a folder, as a table of the shared folder, so that no archive
    is parsed twice.  Payload size and digest are of the bytes read."""
    common.ship_package(spark)
    if not common.exists(spark, path):
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return common.materialize(files.mapInArrow(_parsed, RECORDS), "records")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response (a response or a revisit), metadata.

    ``response`` holds the record's fields; ``request`` is a struct or null and ``metadata`` an array of
    structs.  Links count in both directions: from a record to the response
    and from the response to a record.  Blocks of responses are shuffled once.
    """
    main = F.col("type").isin(*MAIN)
    heads = records.where(main)
    small = records.where(~main).select("record_id", "type", "concurrent_to", "target", "payload")
    backward = small.select(F.explode("concurrent_to").alias("capture_id"), F.col("record_id").alias("other"))
    forward = heads.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other"))
    links = backward.union(forward).where("capture_id IS NOT NULL AND other IS NOT NULL").distinct()
    parts = links.join(small, links["other"] == small["record_id"])
    tied = parts.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("type", "record_id", "target", "payload"))).alias("parts"))
    tied = tied.select(
        "capture_id",
        F.get(F.filter("parts", lambda p: p["type"] == "request"), F.lit(0)).alias("request"),
        F.filter("parts", lambda p: p["type"] == "metadata").alias("metadata"),
    )
    response = F.struct("record_id", "type", "refers_to", "target", "page_id", "headers", "payload", "payload_bytes", "payload_digest")
    return heads.select(F.col("record_id").alias("capture_id"), response.alias("response")).join(tied, "capture_id", "left").select("capture_id", "request", "response", "metadata")


HEAD = "struct<record_id:string,type:string,refers_to:string,target:string,page_id:bigint,headers:map<string,string>,payload:binary,payload_bytes:bigint,payload_digest:string>"
PART = "struct<type:string,record_id:string,target:string,payload:binary>"
#: Rows of captures (part is null) and of other records (response is null); ``wanted`` are identifiers that the archive doesn't hold.
LOCAL = f"capture_id string, response {HEAD}, parts array<{PART}>, wanted array<string>, part {PART}"
_HEAD_TYPE = pa.struct(
    [("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("page_id", pa.int64()), ("headers", pa.map_(pa.string(), pa.string()))]
    + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
_PART_TYPE = pa.struct([("type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("payload", pa.binary())])


def join_archive(records: list[tuple]) -> list[tuple]:
    """Rows of ``LOCAL`` from the records of one archive, as ``_fields`` gives them."""
    heads: dict[str, list[int]] = {}
    others: dict[str, list[int]] = {}
    for i, r in enumerate(records):
        (heads if r[1] in MAIN else others).setdefault(r[0], []).append(i)
    part = {i: {"type": r[1], "record_id": r[0], "target": r[4], "payload": r[8]} for i, r in enumerate(records) if r[1] not in MAIN}
    tied: dict[int, set[int]] = {}
    wanted: dict[int, list[str]] = {}
    for i, r in enumerate(records):
        named, far = (others, wanted) if r[1] in MAIN else (heads, wanted)
        for other in dict.fromkeys(r[2]):
            found = named.get(other, [])
            for j in found:
                tied.setdefault(i if r[1] in MAIN else j, set()).add(j if r[1] in MAIN else i)
            if not found:
                far.setdefault(i, []).append(other)
    rows = []
    for i, r in enumerate(records):
        if r[1] in MAIN:
            head = dict(zip(("record_id", "type", "refers_to", "target", "page_id", "headers"), (r[0], r[1], r[3], r[4], r[5], r[6]))) | {"payload": r[8], "payload_bytes": r[9], "payload_digest": r[10]}
            rows.append((r[0], head, [part[j] for j in sorted(tied.get(i, ()))], wanted.get(i, []), None))
        else:
            rows.append((None, None, [], wanted.get(i, []), part[i]))
    return rows


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), _HEAD_TYPE, pa.list_(_PART_TYPE), pa.list_(pa.string()), _PART_TYPE]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)], names=["capture_id", "response", "parts", "wanted", "part"])

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for row in join_archive([_fields(h, block) for h, block in parse(content.as_py())]):
                rows.append(row)
                size += len(row[1]["payload"]) if row[1] else 0
                if size > 8 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``assemble(read_records(spark, path))`` over all archives in a folder, as a table of the shared folder;
    payloads aren't shuffled unless links go from one archive to another."""
    common.ship_package(spark)
    if not common.exists(spark, path):
        local = spark.createDataFrame([], LOCAL)
    else:
        files = spark.read.format("binaryFile").load(path).select("content")
        local = common.materialize(files.mapInArrow(_joined, LOCAL), "captures")
    captures = local.where("response IS NOT NULL").select("capture_id", "response", "parts", "wanted")
    if not local.where(F.size("wanted") > 0).select("capture_id").isEmpty():
        parts = local.where("part IS NOT NULL").select("part", "wanted")
        named = captures.select("capture_id", F.explode("wanted").alias("other"))
        forward = named.join(parts.select("part"), F.col("other") == F.col("part.record_id")).select("capture_id", "part")
        strays = parts.select(F.explode("wanted").alias("capture_id"), "part").union(forward).distinct()
        strays = strays.groupBy("capture_id").agg(F.collect_list("part").alias("more"))
        captures = captures.join(strays, "capture_id", "left").withColumn("parts", F.array_distinct(F.concat("parts", F.coalesce("more", F.array().cast(f"array<{PART}>")))))
    every = F.sort_array("parts")
    return captures.select(
        "capture_id",
        F.get(F.filter(every, lambda p: p["type"] == "request"), F.lit(0)).alias("request"),
        "response",
        F.when(F.size("parts") > 0, F.filter(every, lambda p: p["type"] == "metadata")).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """page_id, record_type, of the payload a capture stands for payload_bytes, payload_digest and
    refers_to (the page whose response holds it), and of the records tied to it request_uri,
    metadata_bytes (what the first metadata record says of the page) and n_concurrent.

    Revisits alone are joined; responses hold what they stand for.
    """
    r = F.col("response")
    said = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"pageBytes: ([0-9]+)", 1)
    flat = captures.select(
        r["record_id"].alias("record_id"),
        r["type"].alias("record_type"),
        r["page_id"].alias("page_id"),
        r["refers_to"].alias("to"),
        r["payload_bytes"].alias("n"),
        r["payload_digest"].alias("digest"),
        F.col("request")["target"].alias("request_uri"),
        F.when(said != "", said).cast("long").alias("metadata_bytes"),
        (F.coalesce(F.size("metadata"), F.lit(0)) + F.when(F.col("request").isNull(), 0).otherwise(1)).cast("long").alias("n_concurrent"),
    )
    more = ("request_uri", "metadata_bytes", "n_concurrent")
    held = flat.where("record_type = 'response'").select(F.col("record_id").alias("held_id"), F.col("page_id").alias("held_page"), F.col("n").alias("held_n"), F.col("digest").alias("held_digest"))
    again = flat.where("record_type = 'revisit'").join(held, F.col("to") == F.col("held_id"), "left")
    again = again.select("page_id", F.col("held_n").alias("payload_bytes"), F.col("held_digest").alias("payload_digest"), "record_type", F.col("held_page").alias("refers_to"), *more)
    first = flat.where("record_type <> 'revisit'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), *more)
    return first.union(again)


def captured(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` into the folder ``path``, read them back and assemble their captures.

    The nested rows, payloads with them, are a table of the shared folder; tables on the way to the archives are deleted.
    """
    spark = pages.sparkSession
    with common.tracking() as made:
        write_archives(with_decisions(pages, min_bytes), path)
    common.delete(spark, made)
    return read_captures(spark, path)


def decisions_sql(min_bytes: int = 0) -> str:
    """DuckDB SQL for what the archives of ``pages`` say of each page."""
    digit = lambda group, shift: f"substr('{BASE32}', ((('0x' || substr(sha1(html), {5 * group + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    base32 = " || ".join(digit(group, shift) for group in range(8) for shift in (15, 10, 5, 0))
    return f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, {base32} AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {min_bytes} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {min_bytes} AND page_id <> first THEN first END AS refers_to,
               regexp_replace(url, '[\\x00-\\x20\\x7f]', '%20', 'g') AS request_uri, payload_bytes AS metadata_bytes, 2::BIGINT AS n_concurrent
        FROM f"""
