"""WARC archives: writing them with Spark's text sink, reading them with a Python data source.

Writing: a record is one string column, and the text sink ends each with the
last line feed of the record's closing CR LF CR LF. So the archives are written
by Spark itself, on any store that it can write, one for each partition.
Payloads that were written before become ``revisit`` records without a body.

Reading: ``spark.read.format("warc")`` plans whole files into partitions of
bounded size. Filters on the record type and the other header columns are pushed
down; headers are parsed first, and the payload of a record that fails them (or
any payload, with ``payload=false``) is skipped by seeking, never decoded. An archive
that ends early, or whose records don't tell their length, is an error whether or not
the filters want the record in question. A file is one task's: its records can't be
told from copies of records in payloads other than from its start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from docgrid.llm import scratch

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: Bytes of archives that a partition reads, those of a batch that it yields, and of one read.
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 20

#: Column of the source and the header it holds; fixed by the format, the last by this writer.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in ``path``.

    A null html has an empty payload. Of rows with equal payloads of at least
    REVISIT_BYTES bytes, those with the smallest page_id are responses (one, unless
    rows repeat the id) and the others revisit it; null ids are never smallest,
    and a group of null ids alone has responses only. White space and control
    characters of a url are percent-encoded, as a header can't hold them; a null
    url has no header.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("size"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy(F.unhex("sha").alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = scratch.keep(groups.where("n > 1 and first is not null").select("key", "first"), "revisited")
    rows = rows.withColumn("key", F.unhex("sha")).join(scratch.sized(groups, scratch.BROADCAST_ROWS // 2), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(c: str):  # noqa: ANN202
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    def line(name: str, value):  # noqa: ANN001, ANN202
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    uri = F.col("url")
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        uri = F.replace(uri, F.lit(char), F.lit(code))
    uri = F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("first")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("html")),
        F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Input:
    """A file read in pieces, from which stretches can be skipped unread."""

    def __init__(self, store, path: str):  # noqa: ANN001
        packed = path.endswith(".gz")
        self.file = store.open_input_stream(path, compression="gzip") if packed else store.open_input_file(path)
        self.path, self.size = path, None if packed else self.file.size()
        self.held, self.at = b"", 0

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed over too; None at the end of the file."""
        seen = 0
        while (i := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError(f"an archive ends inside a record's header: {self.path}")
                return None
        out, self.at = self.held[self.at : i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end <= len(self.held):
            out, self.at = self.held[self.at : end], end
            return out
        parts = [self.held[self.at :]]
        left = n - len(parts[0])
        self.held, self.at = b"", 0
        while left and (got := self.file.read(left)):
            parts.append(got)
            left -= len(got)
        if left:
            raise ValueError(f"an archive ends {left} bytes before its last record does: {self.path}")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes, which must be there, though they aren't read where a file can be sought in."""
        if self.at + n <= len(self.held):
            self.at += n
            return
        if self.size is not None:
            to = self.file.tell() + n - (len(self.held) - self.at)
            if to > self.size:
                raise ValueError(f"an archive ends {to - self.size} bytes before its last record does: {self.path}")
            self.file.seek(to)
            self.held, self.at = b"", 0
            return
        while n:  # a packed stream is read through in pieces
            part = min(n, READ_BYTES)
            self.take(part)
            n -= part


def parse_header(block: bytes) -> dict[str, str]:
    """Lower-cased header names and their values; a line that starts with white space continues the last."""
    out: dict[str, str] = {}
    last = ""
    for raw in block.decode("utf-8", "replace").split("\r\n"):
        if raw[:1] in (" ", "\t") and last:
            out[last] += " " + raw.strip()
        elif ":" in raw:
            last, _, value = raw.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, frozenset[str]]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take tests of header columns for equality, membership and presence; give back the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", ()) else ""
            if isinstance(f, EqualTo) and column in HEADERS:
                self.wanted.append((HEADERS[column].lower(), frozenset([f.value])))
            elif isinstance(f, In) and column in HEADERS:
                self.wanted.append((HEADERS[column].lower(), frozenset(f.value)))
            elif isinstance(f, IsNotNull) and column in HEADERS:
                self.present.append(HEADERS[column].lower())
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.size and not i.base_name.startswith(("_", ".")))
        out: list[list[str]] = []
        room = 0
        for path, size in files:
            if size > room or not out:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(path)
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            source = _Input(store, path)
            while (block := source.until(b"\r\n\r\n")) is not None:
                head = parse_header(block)
                length = _length(head, path)
                if all(head.get(name) in values for name, values in self.wanted) and all(name in head for name in self.present):
                    body = None
                    if self.payload and head.get("warc-type") != "revisit":
                        body = source.take(length)
                    else:
                        source.skip(length)
                    rows.append((head, length, body))
                    size += len(block) + len(body or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                else:
                    source.skip(length)
                source.skip(4)
        if rows:
            yield _batch(rows)


def _length(head: dict[str, str], path: str) -> int:
    """Content-Length of a record; without a whole number there the records behind can't be found."""
    told = head.get("content-length", "")
    if not (told.isascii() and told.isdigit()):
        raise ValueError(f"{path} has a record ({head.get('warc-record-id', 'without an id')}) whose Content-Length is {told!r}")
    return int(told)


def _batch(rows: list[tuple[dict[str, str], int, bytes | None]]) -> pa.RecordBatch:
    cols = [pa.array([h.get(n.lower()) for h, _, _ in rows], pa.string()) for n in HEADERS.values()]
    cols += [pa.array([n for _, n, _ in rows], pa.int64()), pa.array([b for _, _, b in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=[*HEADERS, "content_length", "payload"])


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``: a row for each record of the archives in a folder."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``; filters on header columns reach the reader.

    Registers the source and turns on the session's filter pushdown for Python sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn) -> F.Column:  # noqa: ANN001
    return F.expr(f"try_cast(regexp_extract({urn}, '<urn:page:(.*)>', 1) AS BIGINT)")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and describe each record.

    Digests and lengths of responses are those of the payloads read; those of
    revisits come from their headers. Every row gives one record, repeated rows and
    null ids too; an empty table gives an empty result. Other columns of ``pages``
    are passed over, whatever their names. The archives go when the Python process ends.
    """
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    scratch.forget_at_end(spark, path)
    write(pages, path)
    got = read(spark, path)
    return got.select(
        page_id("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page_id("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
