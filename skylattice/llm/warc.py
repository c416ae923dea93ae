"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing is one row a record, put together from SQL functions; a record ends in line feeds, so the text
writer's row separator closes it. Files reach any store that Spark writes, and a lost task is written anew.

The reader plans its partitions from the list of files: small files share a partition, up to
``split_bytes``. It parses the header of a record first; predicates on header columns are pushed into it
(equality, ``IN`` and prefixes), and a payload is skipped, by a seek where the file is plain, when a
predicate fails or when the option ``payload`` is false. Files that end in ``.gz`` are read as streams.

Defined results: a null payload is an empty one; a null URI gives no header; line breaks and control
characters in a header value are percent-encoded; rows with a null id are left out; repeated rows are
records of their own. A broken record raises an error that names the file and the offset.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-record:"
_BATCH_BYTES = 8 << 20


# ---------------------------------------------------------------- writing

def _plain(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.regexp_replace(value, r"\r", "%0D"), r"[\x00-\x1F\x7F]", "%0A")


def with_revisits(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``id, uri, payload, digest, length, refers_to`` of ``records (id, uri, payload)``.

    Of equal payloads of at least ``least`` bytes that of least id is kept; the others refer to it. Payloads
    are compared by SHA-256; only digests and ids are grouped, so a page that half the web repeats is one
    row from each task, and whole payloads are exchanged by id alone.
    """
    rows = records.where("id IS NOT NULL").select(
        "id", "uri", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    kinds = rows.where(F.col("length") >= least).select("id", F.unhex("digest").alias("sha"))
    first = kinds.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    later = kinds.join(first, "sha").where("id != first").select(
        F.col("id").alias("later"), F.col("sha").alias("later_sha"), F.col("first").alias("refers_to")).distinct()
    return rows.join(later, (F.col("id") == F.col("later")) & (F.unhex("digest") == F.col("later_sha")), "left").select(
        "id", "uri", "payload", "digest", "length", "refers_to")


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "none",
                   records_per_file: int = 200_000) -> None:
    """Write ``records (id, uri, payload, digest, length, refers_to)``: a revisit record has no payload of its own."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("length"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_URN}"), F.col("id").cast("string"), F.lit(">"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _plain(F.col("uri"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("length").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"), http)
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(head.cast("binary"), body, F.lit(b"\r\n\r"))
    records.select(record.cast("string").alias("value")).write.option("lineSep", "\n").option("compression", compression).option(
        "maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- reading

HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_length long, file string, offset long, payload binary")


class BrokenArchive(ValueError):
    """A record that is not as the format has it."""


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return (pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream: io.BufferedReader, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """Headers, offset and payload of each record whose headers are wanted; other blocks are passed over."""
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        try:
            if not line.startswith(b"WARC/1."):
                raise ValueError("no record starts here")
            head = _headers(stream)
            size = int(head["content-length"])
            payload = None
            if not wanted(head) or not payloads:
                stream.seek(size, io.SEEK_CUR)
            else:
                block = stream.read(size)
                if len(block) != size:
                    raise EOFError
                # The payload of a message of the web protocol follows its own headers.
                payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            if stream.readline() != b"\r\n" or stream.readline() != b"\r\n":
                raise ValueError("a record without its end")
        except (ValueError, KeyError, EOFError) as e:
            raise BrokenArchive(f"offset {at}: {e!r}") from e
        if wanted(head):
            yield head, at, payload


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", str(64 << 20)))
        self.payloads = options.get("payload", "true").lower() == "true"
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.equal.append((name, frozenset([f.value])))
            elif name and isinstance(f, In):
                self.equal.append((name, frozenset(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            elif name and isinstance(f, IsNotNull):
                self.prefix.append((name, ""))
            else:
                yield f

    def wanted(self, head: dict[str, str]) -> bool:
        return all(head.get(n) in values for n, values in self.equal) and all(
            n in head and head[n].startswith(p) for n, p in self.prefix)

    def partitions(self) -> list[InputPartition]:
        files = []
        for path in self.path.split(","):
            store, inner = _store(path)
            head = path[:len(path) - len(inner)] if path.endswith(inner) else ""
            selector = pa.fs.FileSelector(inner, recursive=True)
            info = store.get_file_info(inner)
            for f in [info] if info.is_file else store.get_file_info(selector):
                if f.is_file and not f.base_name.startswith(("_", ".")):
                    files.append((head + f.path, f.size))
        out, now, size = [], [], 0
        for path, n in sorted(files):
            if now and size + n > self.split:
                out.append(Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, Files(now)] if now else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for path in partition.paths:
            store, inner = _store(path)
            rows, size = [], 0
            with store.open_input_file(inner) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                try:
                    for head, at, payload in records(stream, self.wanted, self.payloads):
                        told = head.get("x-payload-length")
                        length = len(payload) if payload is not None and head.get("warc-type") != "revisit" else told and int(told)
                        rows.append((*(head.get(h) for h in HEADERS.values()), length, path, at, payload))
                        size += len(payload or b"") + 500
                        if size > _BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                except BrokenArchive as e:
                    raise BrokenArchive(f"{path}: {e}") from e
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    """Options: ``path`` (files or folders, comma between them), ``payload``, ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def record_number(column: str, kind: str = "long") -> Column:
    """The id that a record id or a reference carries."""
    return F.regexp_extract(column, rf"^<{_URN}(.*)>$", 1).cast(kind)
