"""WARC archives: a native writer and a PySpark Python data source.

Writing: payloads are told apart by SHA-256; of equal payloads of at least 100 bytes the one with the smallest
id is a ``response``, the others are ``revisit`` records without payload.  Records are made by Spark's text
writer, so any file system that Spark knows can hold them (the record terminator CRLF CRLF is the line
separator; each file is one gzip stream).

Reading: the data source plans one partition per group of files, takes record-type and header predicates from
the filters Spark pushes down, parses headers first, and never copies out a payload nobody wants.

Edge cases, each with a defined result: null payload is an empty one; a null URL has no target header; line breaks in
a URL are percent encoded; very long payloads are read whole, one at a time, or skipped in pieces; of rows that repeat
an id each gets a record of the same type; of equal payloads the smallest id is the response; no pages give an archive
without records; columns other than page_id, url and html are not read, whatever their names.  In foreign archives
header bytes that aren't UTF-8 are replaced, and a block without a Content-Length is passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .common import new_path

LEAST_REVISIT = 100
END = "\r\n\r\n"
#: Records in a file at most: a file is read by one task.
FILE_RECORDS = 20_000
# Fixed value: the profile of revisits by equal payload digest in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (id, url, payload) with digest, bytes and, for revisits, the id that is referred to.

    Only digests are aggregated (partially, before the shuffle); the join back is one shuffle of the payloads,
    keyed by digest, whose hot keys the skew join splits.
    """
    body = F.coalesce(payload, F.lit(""))
    known = pages.select(
        F.col(id_col).alias("id"), F.col("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"),
    )
    first = known.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    joined = known.join(first.select("digest", "first_id").repartition("digest"), "digest", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("id", "url", "body", "bytes", "digest", refers.alias("refers_to"))


def write_warc(marked: DataFrame, path: str) -> None:
    """One record a row, in gzip files under ``path``."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    visit = F.col("refers_to").isNotNull()
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(visit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes")),
        F.when(visit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(visit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(visit, F.lit(0)).otherwise(F.col("bytes"))),
    )
    record = F.concat(lines, F.lit(END), F.when(visit, F.lit("")).otherwise(F.col("body")))
    marked.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _open(path: str):
    """A file handle and its file system, for any URI that Arrow knows."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, base = _open(path)
    info = system.get_file_info(fs.FileSelector(base, recursive=True)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    return sorted((prefix + x.path, x.size) for x in info if x.is_file and x.base_name.endswith((".gz", ".warc", ".txt")) and not x.base_name.startswith((".", "_")))


class _Stream:
    """Bytes of a plain or gzip file (of one or many members), a chunk at a time."""

    def __init__(self, path: str, chunk: int = 1 << 18):
        system, inner = _open(path)
        self.raw, self.chunk, self.buf, self.at = system.open_input_stream(inner, compression=None), chunk, b"", 0
        self.unzip = zlib.decompressobj(31) if path.endswith(".gz") else None
        self.left = b""

    def _more(self) -> bytes:
        if not self.unzip:
            return self.raw.read(self.chunk)
        while True:
            if self.unzip.eof:
                self.left, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            data = self.left or self.raw.read(self.chunk)
            self.left = b""
            if not data:
                return b""
            if out := self.unzip.decompress(data):
                return out

    def _fill(self) -> bool:
        data = self._more()
        self.buf, self.at = self.buf[self.at :] + data, 0
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is skipped too; None at the end."""
        start = self.at
        while (found := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - self.at - len(mark) + 1)
            if not self._fill():
                return None
        out, self.at = self.buf[self.at : found], found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buf[self.at : self.at + n]], min(n, len(self.buf) - self.at)
        self.at += have
        while have < n:
            self.buf, self.at = self._more(), 0
            if not self.buf:
                raise EOFError("the archive ends inside a record")
            parts.append(self.buf[: n - have])
            self.at = min(n - have, len(self.buf))
            have += self.at
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Go past ``n`` bytes without joining or copying them."""
        while n > len(self.buf) - self.at:
            n -= len(self.buf) - self.at
            self.buf, self.at = self._more(), 0
            if not self.buf:
                raise EOFError("the archive ends inside a record")
        self.at += n


SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary"
# The header that fills each column.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "warc-payload-length", "content_length": "content-length",
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.payload_types = [x for x in options.get("payload", "response,resource").split(",") if x and x != "none"]
        self.group_bytes = int(options.get("groupbytes", 32 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and prefix tests on header columns are done here; others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in HEADERS and not name.endswith("_length"):
                if isinstance(f, EqualTo):
                    self.tests.append((HEADERS[name], "in", (f.value,)))
                    continue
                if isinstance(f, In):
                    self.tests.append((HEADERS[name], "in", tuple(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.tests.append((HEADERS[name], "prefix", (f.value,)))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        groups, size = [[]], 0
        for name, n in _files(self.path):
            if groups[-1] and size + n > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            yield from self._records(_Stream(path))

    def _records(self, stream: _Stream) -> Iterator[tuple]:
        while (block := stream.until(b"\r\n\r\n")) is not None:
            fields = {}
            for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            length = int(fields.get("content-length", "")) if fields.get("content-length", "").isdigit() else None
            if length is None:  # not a record's head: go on behind the next blank line
                continue
            keep = all(self._passes(fields.get(h), how, values) for h, how, values in self.tests)
            wanted = keep and fields.get("warc-type") in self.payload_types
            payload = stream.take(length) if wanted else stream.skip(length)
            stream.skip(4)
            if keep:
                row = [fields.get(h) for h in HEADERS.values()]
                row[6:8] = [int(x) if x and x.isdigit() else None for x in row[6:8]]
                yield (*row, payload)

    @staticmethod
    def _passes(value: str | None, how: str, wanted: tuple) -> bool:
        return value is not None and (value in wanted if how == "in" else value.startswith(wanted[0]))


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "response" or "none").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "response,resource") -> DataFrame:
    """Records under ``path``; ``payload`` lists the record types whose payload is wanted, or is ``none``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back, and report each record's full payload.

    A response's digest and size come from the payload that was read; a revisit's from its headers.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(mark_revisits(pages), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    got = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        as_id("record_id").alias("page_id"),
        F.when(got, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(got, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )


def oracle() -> str:
    return f"""
with p as (select page_id, strlen(coalesce(html, '')) b, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first_id from p where b >= {LEAST_REVISIT} group by d)
select page_id, b::bigint payload_bytes, d payload_digest,
  case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end record_type,
  case when first_id <> page_id then first_id end refers_to
from p left join f using (d)
"""
