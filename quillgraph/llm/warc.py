"""Not-modified revisit resolution over WARC records (operator 5).

A revisit record of the *server-not-modified* kind holds only the headers of a 304 answer. It stands for the latest
earlier full response of its URL, if that one's validators agree.

1. *Order*: full responses and revisits, without bodies, are put in one order by canonical URL and capture time, by range
   partitions; a URL that holds most rows is cut like any other. Each row is written with its partition's number.
2. *As-of join*: within a URL's rows of one partition, a window carries the latest earlier full response on. What a URL
   leaves at the end of one partition is carried to its next ones: one row per URL and partition.
3. *Check and merge*: entity tags are compared (weakly) where both sides have one, else times of last modification.
   Where they agree, the headers of the revisit replace the stored ones, but for those that a 304 answer may not change.

Bodies never move with the order; :func:`with_payloads` joins them by record afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.storage import materialize

#: Headers that a not-modified answer never changes: of one connection only, or describing the stored body. Fixed.
FORBIDDEN = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
)
RESOLVED, MISMATCH, NO_VALIDATOR, NO_RESPONSE = "resolved", "validator mismatch", "no validator", "no earlier response"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path; null or blank: null."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    front = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    rest = F.substring(plain, F.length(front) + 1, F.length(plain))
    front = F.regexp_replace(F.regexp_replace(front, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    path = F.when(rest.startswith("/") | (front == ""), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(plain != "", F.concat(front, path))


def plain_headers(headers: Column) -> Column:
    """Names in lower case; values of a name that repeats are joined by commas, as HTTP has it. Null: no headers."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    name = lambda e: F.lower(F.trim(e["key"]))
    names = F.array_distinct(F.transform(entries, name))
    value = lambda n: F.array_join(F.transform(F.filter(entries, lambda e: name(e) == n), lambda e: F.trim(e["value"])), ", ")
    return F.map_from_arrays(names, F.transform(names, value))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the permitted headers of ``fresh`` put in; both from :func:`plain_headers`."""
    of_connection = F.transform(F.split(F.lower(F.coalesce(fresh["connection"], F.lit(""))), ","), lambda name: F.trim(name))
    permitted = F.map_filter(fresh, lambda k, _: ~k.isin(*FORBIDDEN) & ~F.array_contains(of_connection, k))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def header_block(headers: Column) -> Column:
    """``name: value`` lines by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")


def resolve(records: DataFrame) -> DataFrame:
    """Resolve the revisits among ``records`` (record_id, warc_type, status, url, captured, headers map).

    One row per revisit: record_id, url (canonical), outcome, response_id and headers (merged); both are null unless
    the outcome is ``resolved``. A full response is a record of type ``response`` with status 200. *Earlier* is strict:
    a response captured at the same time does not count; of several captured at once, the greatest record_id is taken.
    Only the latest earlier response is checked: if it disagrees, the page has changed since and nothing older may stand
    in. Revisits with a null URL or time find no response; responses with one are never found. Repeated rows are
    answered each. Other record types and other columns are ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "captured", plain_headers(F.col("headers")).alias("headers"), F.coalesce(full, F.lit(False)).alias("is_full"), F.coalesce(F.col("warc_type") == "revisit", F.lit(False)).alias("asks"))
    rows = rows.where("is_full or asks")
    placed = F.col("url").isNotNull() & F.col("captured").isNotNull()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where(placed).repartitionByRange(parts, "url", "captured", "is_full", "record_id").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "warc_order")
    response = F.when(F.col("is_full"), F.struct("record_id", "headers"))
    before = Window.partitionBy("part", "url").orderBy("captured", "is_full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = ordered.withColumn("here", F.last(response, ignorenulls=True).over(before)).where("asks")
    left = ordered.groupBy("part", "url").agg(F.max_by(response, F.when(F.col("is_full"), F.struct("captured", "record_id"))).alias("last"))
    carry = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("part", "url", F.last("last", ignorenulls=True).over(carry).alias("carried")).where("carried is not null")
    found = here.join(carried, ["part", "url"], "left").select("record_id", "url", "headers", F.coalesce("here", "carried").alias("response"))
    lost = rows.where(~placed & F.col("asks")).select("record_id", "url", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response"))
    return _checked(found.unionByName(lost))


def _checked(found: DataFrame) -> DataFrame:
    fresh, stored = F.col("headers"), F.col("response.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    agree = F.when(fresh["etag"].isNotNull() & stored["etag"].isNotNull(), tag(fresh) == tag(stored)).when(
        fresh["last-modified"].isNotNull() & stored["last-modified"].isNotNull(), fresh["last-modified"] == stored["last-modified"]
    )
    outcome = F.when(F.col("response").isNull(), NO_RESPONSE).when(agree.isNull(), NO_VALIDATOR).when(agree, RESOLVED).otherwise(MISMATCH)
    told = found.withColumn("outcome", outcome)
    done = F.col("outcome") == RESOLVED
    return told.select("record_id", "url", "outcome", F.when(done, F.col("response.record_id")).alias("response_id"), F.when(done, merged_headers(stored, fresh)).alias("headers"))


def with_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with the other columns of ``payloads`` (record_id, ...), null where nothing was resolved. Of several rows of a
    record_id one stays, the least by all columns; those of a null one are left out. Columns of ``payloads`` that are
    named like those of ``resolved`` raise: both could not be told apart."""
    others = [c for c in payloads.columns if c != "record_id"]
    if clashing := set(others) & set(resolved.columns):
        raise ValueError(f"rename these columns of the payloads: {sorted(clashing)}")
    once = payloads.where("record_id is not null").groupBy(F.col("record_id").alias("response_id")).agg(F.min(F.struct(*others)).alias("payload"))
    return resolved.join(once, "response_id", "left").select("*", "payload.*").drop("payload")


# ---- files

_RECORD = "record_id string, warc_type string, status int, url string, captured timestamp, headers map<string,string>, body binary, offset long, error string"
_COLUMNS = [c.split()[0] for c in _RECORD.split(", ")]
STEP = 1 << 20


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """First line, and headers by lower-case name (repeated ones joined by commas)."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return first, found


class Damaged(ValueError):
    """What can't be read, and where."""


def _inflated(raw: bytes) -> Iterator[bytes | Damaged]:
    """The bytes of a file in steps, gzipped in one or more members or not. A member that is damaged or cut off gives an error
    in its place, and reading goes on at the next one."""
    view, at = memoryview(raw), 0
    if raw[:2] != b"\x1f\x8b":
        while at < len(view):
            yield bytes(view[at : at + STEP])
            at += STEP
        return
    while at < len(view):
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(view):
                step = view[at : at + STEP]
                yield member.decompress(step)
                at += len(step) - len(member.unused_data)
            if not member.eof:
                yield Damaged(f"gzip member at byte {begin} is cut off")
        except zlib.error as error:
            yield Damaged(f"gzip member at byte {begin}: {error}")
            following = raw.find(b"\x1f\x8b\x08", begin + 3)
            at = following if following >= 0 else len(view)


def _record(head: bytes, block: bytes) -> tuple:
    _, warc = _fields(head)
    is_http = block.startswith(b"HTTP/")
    front, _, body = block.partition(b"\r\n\r\n")
    first, headers = _fields(front) if is_http else ("", {})
    status = re.match(r"\S+ ([0-9]{1,9})(?: |$)", first)
    captured = pd.to_datetime(warc.get("warc-date"), errors="coerce", utc=True)
    when = None if pd.isna(captured) else captured.tz_localize(None)
    return warc.get("warc-record-id"), warc.get("warc-type"), int(status[1]) if status else None, warc.get("warc-target-uri"), when, headers, body if is_http else block


class _Reader:
    """Records out of the bytes that have come in so far. Each byte is taken in and given out once: ``wanted`` says how many
    must be there before it is worth looking again."""

    def __init__(self) -> None:
        self.data, self.gone, self.wanted = bytearray(), 0, 0

    def take(self, more: bytes) -> Iterator[tuple]:
        self.data += more
        while len(self.data) >= max(self.wanted, 1):
            at = self.data.find(b"WARC/")
            if at < 0:
                self._drop(max(0, len(self.data) - 4))
                break
            self._drop(at)
            end = self.data.find(b"\r\n\r\n")
            if end < 0:
                self.wanted = len(self.data) + 1
                break
            head = bytes(self.data[:end])
            size = _fields(head)[1].get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                yield self.failed("a record without a length")
                self._drop(5)
                continue
            to = end + 4 + int(size)
            if to > len(self.data):
                self.wanted = to
                break
            yield *_record(head, bytes(self.data[end + 4 : to])), self.gone, None
            self._drop(to)

    def _drop(self, count: int) -> None:
        del self.data[:count]
        self.gone += count
        self.wanted = 0 if count else self.wanted

    def failed(self, why: str) -> tuple:
        return (None,) * 7 + (self.gone, why)

    def cut(self, why: str) -> Iterator[tuple]:
        """What is left is no whole record: an error, and on with what follows."""
        started = self.data.startswith(b"WARC/")
        if started or why:
            yield self.failed(why or "a record is cut off")
        if started:  # a wrong length may have swallowed the records behind it
            self._drop(5)
            yield from self.take(b"")
            if self.data.startswith(b"WARC/"):
                yield from self.cut("")
                return
        self._drop(len(self.data))


def parse_records(raw: bytes) -> Iterator[tuple]:
    """Records of one WARC file, gzipped or not, as they are unzipped, with their place in the unzipped bytes. What can't be
    read (a damaged or cut-off gzip member, a record without a length, a cut-off record) gives a row with ``error`` and
    nothing else but its place; reading goes on at the next member or ``WARC/``."""
    reader = _Reader()
    for more in _inflated(raw):
        if isinstance(more, Damaged):
            yield from reader.cut(str(more))
        else:
            yield from reader.take(more)
    yield from reader.cut("")


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            records = parse_records(raw)
            while some := list(islice(records, 256)):
                yield pd.DataFrame(some, columns=_COLUMNS).astype({"status": "Int32"}).assign(file=path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path``, one task a file (of at most 2 GB), in time linear in its bytes: what
    :func:`resolve` takes, and body, offset (in the unzipped bytes), error, file. Rows with an ``error`` have no record;
    :func:`resolve` passes them over. Times are UTC; the session's time zone must be too."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parsed, f"{_RECORD}, file string")
