"""Quoted multi-line CSV files read by byte ranges (S-01).

A file whose cells hold line breaks cannot be cut at any line: only what stands
before tells whether a line starts a record or goes on with a quoted cell. Spark's
``multiLine`` reader therefore takes a task per file. Here the file's lines are read
as split text, and a range is what a split holds:

1. Each range is followed from both states a line can start in, outside or inside a
   quoted cell; it reports the state it ends in and its last line that starts a
   record, for either. A cell is quoted if a quote is its first character, and two
   quotes inside are one, so quotes in the middle of a bare cell change nothing.
2. The reports, one small row a range (64 bytes; a range is megabytes), are composed
   in file order, which gives the state each range really starts in and the record
   its first lines belong to.
3. Each range builds the records that start in it. The lines that reach into the next
   ranges leave as fragments, which alone are shuffled and put together.
4. The records are parsed by ``from_csv`` with the options of the plain reader.

Defined results: as the ``multiLine`` reader gives for files whose lines end in LF or
CRLF (where the first line ends in CRLF, every CRLF is read as LF, also in cells); a lone
carriage return ends no line; a quote that is never closed makes the rest
of its file one cell, without the last line break; blank lines between records and each file's header are no
records; a file without records gives no rows. Where the splits of the two passes differ
(they follow the cluster's cores), the run fails and does not give other records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed as V
from ..operators.quality import clean_null_tokens
from ..session import materialize

REPORT = "file string, start bigint, crlf boolean, open0 boolean, open1 boolean, last0 bigint, last1 bigint"
STATE = "file string, start bigint, crlf boolean, open boolean, from_start bigint, from_line bigint"
RECORD = "file string, start bigint, line bigint, part bigint, whole boolean, header boolean, record string"
OPTIONS = {"escape": '"', "multiLine": "true"}


def ends_open(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``, which starts inside of one or where a record starts."""
    at = 0
    if not inside and line.startswith(b'"'):
        inside, at = True, 1
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line.startswith(b'""', at):
                at += 2
                continue
            inside, at = False, at + 1
        at = line.find(b',"', at)
        if at < 0:
            return False
        inside, at = True, at + 2


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, start) of each run of rows of one range, with where the run starts and ends in the batch."""
    files, starts = batch.column("file"), batch.column("start").to_numpy()
    code = files.dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield (files[a].as_py(), int(starts[a])), a, b


def _follow(quoted: list[tuple[int, bytes]], n: int, inside: bool) -> tuple[bool, int]:
    """The state behind ``n`` lines, of which ``quoted`` hold quotes, and the last line that starts a record, or -1."""
    last, after = -1, 0
    for i, line in quoted:
        if not inside:
            last = i
        inside, after = ends_open(line, inside), i + 1
    return inside, n - 1 if not inside and after < n else last


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (null for those without a quote) to one REPORT row a range; ``crlf`` is whether its first line ends so."""
    def report(key, crlf, state, last):
        columns = [[key[0]], [key[1]], [crlf], *([x] for x in state), *([x] for x in last)]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)],
                                          names=["file", "start", "crlf", "open0", "open1", "last0", "last1"])

    now = None
    for batch in batches:
        lines = batch.column("quoted")
        for key, a, b in _ranges(batch):
            if key != now:
                if now is not None:
                    yield report(now, crlf, state, last)
                now, n, state, last, crlf = key, 0, [False, True], [-1, -1], batch.column("crlf")[a].as_py()
            part = lines.slice(a, b - a)
            quoted = [(i, part[i].as_py()) for i in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)).tolist()]
            ways = {inside: _follow(quoted, b - a, inside) for inside in set(state)}
            for s in (0, 1):
                state[s], at = ways[state[s]]
                last[s] = n + at if at >= 0 else last[s]
            n += b - a
    if now is not None:
        yield report(now, crlf, state, last)


def _compose(reports: pa.Table) -> pa.Table:
    """The reports of one file to the state each range starts in and the record open there."""
    inside, record, rows = False, (-1, -1), []
    reports = reports.sort_by("start").to_pylist()
    crlf = reports[0]["crlf"]                                # as the plain reader, which goes by the first line too
    for r in reports:
        rows.append((r["file"], r["start"], crlf, inside, *record))
        way = int(inside)
        if r[f"last{way}"] >= 0:
            record = (r["start"], r[f"last{way}"])
        inside = r[f"open{way}"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                names=["file", "start", "crlf", "open", "from_start", "from_line"])


class _Range:
    """The lines of one range, in order, to the records that start in it and the fragments of those that reach over its ends."""

    def __init__(self, key: tuple[str, int], crlf: bool, inside: bool, from_start: int, from_line: int):
        self.file, self.start = key
        self.crlf, self.inside, self.n = crlf, inside, 0
        self.record, self.lines, self.whole = ((from_start, from_line) if inside else None), [], not inside
        self.header = self.start == 0                      # the next record that is no blank line is the file's header

    def add(self, lines: list[bytes], out: list[tuple]) -> None:
        for line in lines:
            if self.crlf:
                line = line.removesuffix(b"\r")
            if not self.inside:
                self.close(out)
                self.record, self.lines, self.whole = (self.start, self.n), [], True
            self.lines.append(line)
            if b'"' in line:
                self.inside = ends_open(line, self.inside)
            self.n += 1

    def close(self, out: list[tuple], end: bool = False) -> None:
        """Emit the record so far; at the end of the range it may go on in the next."""
        if not self.lines:
            return
        whole = self.whole and not (end and self.inside)
        body = b"\n".join(self.lines)
        if body or not whole:
            header, self.header = self.header, False
            out.append((self.file, *self.record, self.start, whole, header, body.decode("utf-8", "replace")))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the state of their range (STATE) to RECORD rows."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = ["file", "start", "line", "part", "whole", "header", "record"]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    now, here = None, None
    for batch in batches:
        out: list[tuple] = []
        for key, a, b in _ranges(batch):
            if key != now:
                if here is not None:
                    here.close(out, end=True)
                state = [batch.column(c)[a].as_py() for c in ("crlf", "open", "from_start", "from_line")]
                if state[1] is None:
                    raise ValueError(f"{key[0]} was split in another way at {key[1]}: the number of cores changed between the passes")
                now, here = key, _Range(key, *state)
            here.add(batch.column("text").slice(a, b - a).to_pylist(), out)
        if out:
            yield batch_of(out)
    if here is not None:
        out = []
        here.close(out, end=True)
        if out:
            yield batch_of(out)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files' records as text, headers and blank lines left out: file, start (of the range), line (in it), record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("text"))
    quoted = lines.select("file", "start", F.when(F.contains("text", F.lit(b'"')), F.col("text")).alias("quoted"),
                          F.endswith("text", F.lit(b"\r")).alias("crlf"))
    reports = quoted.mapInArrow(_reports, REPORT)
    states = materialize(reports.groupBy("file").applyInArrow(_compose, STATE), "csv-ranges")
    # one row a range of megabytes, so what goes to every task is a millionth of the files
    followed = lines.join(F.broadcast(states), ["file", "start"], "left")
    records = materialize(followed.mapInArrow(_records, RECORD), "csv-records")
    pieces = F.array_sort(F.collect_list(F.struct("part", "record")))            # of one record: a cell over range ends
    joined = records.filter("NOT whole").groupBy("file", "start", "line").agg(
        F.max("header").alias("header"), F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
    columns = ["file", "start", "line", "header", "record"]
    return records.filter("whole").select(columns).unionByName(joined.select(columns)).filter("NOT header").drop("header")


def read_csv_ranges(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, position: str | None = None) -> DataFrame:
    """As :func:`talentlake.sources.landing.read_csv`, by as many tasks as the files have splits. ``position`` names a
    column (file, start, line) in landing order."""
    if schema is None:
        schema = spark.read.options(header=True, encoding="UTF-8", **OPTIONS).csv(path).schema       # reads one record
    rows = read_records(spark, path).select(F.from_csv("record", schema if isinstance(schema, str) else schema.toDDL(), OPTIONS).alias("cells"),
                                            F.struct("file", "start", "line").alias("at"))
    at = [F.col("at").alias(position)] if position else []
    return clean_null_tokens(rows.select("cells.*", *at), tokens=V.CSV_NULL_TOKENS)
