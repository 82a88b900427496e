"""WARC archives: a writer and a splittable reader, as a Spark data source.

``df.write.format("warc")`` writes one gzip member per record and
``spark.read.format("warc")`` reads the archives back by byte ranges. A task
scans its range for the gzip magic, accepts a candidate only when it inflates
to a WARC header, and owns the records that start inside the range (the last
one may end beyond it). After a record the next one is looked for where its
member ended, so bytes inside a member are candidates only ahead of a range's
first record.

Files are reached through :mod:`pyarrow.fs` (local or shared mounts, HDFS,
object stores). Tasks write under a folder of their job; the job's commit moves the
files of the attempts that succeeded, so lost executors and speculative
attempts leave no partial archive behind.

Defined results: a null payload is written as an empty one; a null URI or id
gives a record without that header and reads back as null; control characters
of a URI are percent-encoded; a record that cannot be parsed is not a record;
an empty table gives an archive folder without records.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from .common import attach_by_key, fresh_path, materialize, read, text_of

MAGIC = b"\x1f\x8b\x08"
GZIP = 31                      # zlib's window bits for gzip framing
RANGE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary, archive string, offset long")


def filesystem(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- records

def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def encode_record(row: dict) -> bytes:
    """One gzip member for a response or revisit row."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if revisit else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    if not revisit:
        block += payload
    head = {"WARC-Type": row["record_type"], "WARC-Date": "2000-01-01T00:00:00Z"}
    if row["record_id"] is not None:
        head["WARC-Record-ID"] = f"<{_clean(row['record_id'])}>"
    if row["target_uri"] is not None:
        head["WARC-Target-URI"] = _clean(row["target_uri"])
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    if revisit:
        head["WARC-Profile"] = PROFILE
        head["WARC-Refers-To"] = f"<{_clean(row['refers_to'])}>"
    head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return gz.compress(text.encode() + block + b"\r\n\r\n") + gz.flush()


def decode_record(data: bytes) -> dict | None:
    """The fields of an inflated member, or None if it holds no response or revisit record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/1."):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if fields.get("WARC-Type") not in ("response", "revisit"):
        return None
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
    algorithm, _, digest = fields.get("WARC-Payload-Digest", "").partition(":")
    unwrap = lambda v: v[1:-1] if v else None
    return {"record_id": unwrap(fields.get("WARC-Record-ID")), "record_type": fields["WARC-Type"],
            "target_uri": fields.get("WARC-Target-URI"), "refers_to": unwrap(fields.get("WARC-Refers-To")),
            "payload_digest": base64.b32decode(digest).hex() if algorithm == "sha1" else None,
            "payload_bytes": int(length[1]) if revisit and length else len(payload),
            "payload": None if revisit else payload}


class _Window:
    """Reads of a random-access file through one block of it."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.at, self.data = file, block, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``offset``; fewer only at the end of the file."""
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(n, self.block))
        return self.data[offset - self.at:offset - self.at + n]


def _inflate(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``offset``, or None if it is not a whole WARC member."""
    gz, parts, seen, at = zlib.decompressobj(GZIP), [], b"", offset
    try:
        while not gz.eof:
            chunk = window.get(at, 1 << 16)
            if not chunk:
                return None
            at += len(chunk)
            parts.append(gz.decompress(chunk))
            if len(seen) < 7:
                seen += parts[-1][:7]
                if not b"WARC/1.".startswith(seen[:7]):
                    return None
    except zlib.error:
        return None
    return b"".join(parts), at - len(gz.unused_data)


def records_in_range(file, start: int, end: int):
    """(offset, fields) of each record that starts in [start, end)."""
    window, at, step = _Window(file), start, 1 << 16
    while at < end:
        data = window.get(at, step + len(MAGIC) - 1)
        if len(data) < len(MAGIC):
            return
        hit = data.find(MAGIC)
        if hit < 0:
            at += len(data) - len(MAGIC) + 1
            continue
        at += hit
        if at >= end:
            return
        member = _inflate(window, at)
        if member is None:
            at += 1
            continue
        fields = decode_record(member[0])
        if fields is not None:
            yield at, fields
        at = member[1]


# ---------------------------------------------------------------- data source

@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int):
        self.uri, self.range_bytes = uri, range_bytes

    def partitions(self):
        from pyarrow import fs

        files, path = filesystem(self.uri)
        found = files.get_file_info(fs.FileSelector(path, recursive=False))
        out = [ByteRange(f.path, at, min(at + self.range_bytes, f.size)) for f in sorted(found, key=lambda f: f.path)
               if f.path.endswith(".warc.gz") for at in range(0, f.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange):
        if not part.archive:
            return
        files, _ = filesystem(self.uri)
        with files.open_input_file(part.archive) as file:
            for offset, r in records_in_range(file, part.start, part.end):
                yield (r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"],
                       r["payload_bytes"], r["payload"], part.archive.rpartition("/")[2], offset)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri
        self.job = f"_temporary-{uuid.uuid4().hex}"        # of this job alone: others may write to the folder meanwhile

    def write(self, batches):
        files, path = filesystem(self.uri)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        files.create_dir(f"{path}/{self.job}", recursive=True)
                        out = files.open_output_stream(f"{path}/{self.job}/{name}", compression=None)
                    out.write(encode_record(row))
        finally:
            if out is not None:
                out.close()
        return Written([name] if out is not None else [])

    def commit(self, messages):
        files, path = filesystem(self.uri)
        files.create_dir(path, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                files.move(f"{path}/{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        files, path = filesystem(self.uri)
        if files.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.job}")


class WarcSource(DataSource):
    """Options: ``path`` (given by load/save) and ``rangeBytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


# ---------------------------------------------------------------- operator

def warc_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html",
                 min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """WARC rows of ``pages``: of equal payloads of at least ``min_revisit_bytes``, the
    one with the largest id is the response and the others are revisits of it.

    Payloads are grouped by size and digest without moving them; only the ids of
    the revisits are joined back (rows repeating id and payload are one record twice)."""
    payload = text_of(body_col).cast("binary")
    keyed = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("target_uri"),
                         payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    long = materialize(keyed.filter(F.length("payload") >= min_revisit_bytes).select("id", "digest"), "payloads")
    groups = long.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "payload-groups")
    again = attach_by_key(long, groups, "digest", "n", long.count()).filter(~F.col("id").eqNullSafe(F.col("first")))
    again = materialize(again.select("id", "digest", "first").distinct(), "revisits")
    joined = keyed.join(again, keyed["id"].eqNullSafe(again["id"]) & (keyed["digest"] == again["digest"]), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    revisit = again["digest"].isNotNull()
    return joined.select(
        name(keyed["id"]).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(revisit, name(F.coalesce(F.col("first").cast("string"), F.lit("")))).alias("refers_to"),
        F.lower(F.hex(keyed["digest"])).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("rangeBytes", range_bytes).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(warc_records(read(spark, sf_dir, "pages")), path)
    r = read_warc(spark, path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    whole = F.col("record_type") == "response"
    return r.select(page("record_id").alias("page_id"),
                    F.when(whole, F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                    F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                    "record_type", page("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
