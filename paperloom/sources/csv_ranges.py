"""CSV files read in byte ranges, each by a task of its own, though their cells hold line breaks.

Whether a range begins inside a quoted cell depends on all that stands before it. One pass over the ranges
finds, for either answer, whether the range ends inside a cell; a running composition of these over each file
then says how every range begins. The second pass takes the records that begin in its range and reads on over
the end for the last one, so that no record is cut and none is read twice.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.score_sink import store

RANGE_BYTES = 64 << 20
CHUNK = 4 << 20  # bytes read at a time
HEADER_CHUNK = 64 << 10
BATCH_BYTES = 4 << 20
# Endings of compressed files, which are one range each.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
# Stores that the workers can read on their own.
STORES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
MARK = b"\xef\xbb\xbf"
_CELL_END = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line; ``inside`` says so for its beginning.

    A quote opens a cell only where a cell begins. What follows the closing quote up to the comma is passed over.
    """
    at = 0
    while True:
        if not inside:
            if at == 0 and line.startswith(b'"'):
                at = 1
            else:
                at = line.find(b',"', at) + 2
                if at == 1:
                    return False
        end = _CELL_END.match(line, at)
        if end is None:
            return True
        at, inside = end.end(), False
        if at == 0:
            return False


def codec_of(path: str) -> str | None:
    return next((codec for ending, codec in CODECS.items() if path.lower().endswith(ending)), None)


def lines(path: str, start: int = 0, chunk_bytes: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines of a file that begin at ``start`` or after it, without their line ends."""
    files, name = store(path)
    codec = codec_of(path)
    with files.open_input_stream(name, compression=codec) if codec else files.open_input_file(name) as stream:
        place, rest = start, b""
        if start:  # a line begins here only after a line end
            stream.seek(start - 1)
            place, rest = start - 1, b""
        first = start > 0
        while chunk := stream.read(chunk_bytes or CHUNK):
            found = (rest + chunk).split(b"\n")
            rest = found.pop()
            for line in found:
                if first:
                    first = False
                else:
                    yield place, line
                place += len(line) + 1
        if rest and not first:
            yield place, rest


def effect(path: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether the range ends inside a cell, if it begins outside of one and if it begins inside."""
    outside, inside = False, True
    for place, line in lines(path, start):
        if place >= end:
            break
        if b'"' in line:
            line = line.removeprefix(MARK) if place == 0 else line
            outside, inside = ends_inside(line, outside), ends_inside(line, inside)
    return outside, inside


def records(path: str, start: int = 0, end: int | None = None, inside: bool = False, chunk_bytes: int | None = None) -> Iterator[bytes]:
    """The records that begin in a range, whole; empty lines are none."""
    skipping, waiting = inside, []
    for place, line in lines(path, start, chunk_bytes):
        if place == 0:
            line = line.removeprefix(MARK)
        if not inside and end is not None and place >= end:
            return
        inside = ends_inside(line, inside) if inside or b'"' in line else False
        if skipping:
            skipping = inside
        elif inside:
            waiting.append(line)
        else:
            record = b"\n".join([*waiting, line]).removesuffix(b"\r") if waiting else line.removesuffix(b"\r")
            waiting = []
            if record:
                yield record
    if waiting:
        yield b"\n".join(waiting)


def column_names(header: bytes) -> list[str]:
    """Names of the columns, made as Spark's own reader makes them: numbered where empty or repeated."""
    names = next(csv.reader([header.decode("utf-8", "replace")], strict=False), []) if b"\n" not in header else next(
        csv.reader(header.decode("utf-8", "replace").splitlines(keepends=True))
    )
    lowered = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if lowered.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and the columns of partition folders of all files under a path or pattern."""
    found = spark.read.format("binaryFile").load(path)
    return found.drop("content", "modificationTime")


def folder_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns that come from partition folders."""
    return [c for c in csv_files(spark, path).columns if c not in ("path", "length")]


def with_headers(files: DataFrame) -> DataFrame:
    """Adds ``header``, the names of the first record as JSON; each file is opened by a task and read to that record's end."""

    def first_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [next(records(path, chunk_bytes=HEADER_CHUNK), None) for path in batch["path"]]
            batch["header"] = [None if r is None else json.dumps(column_names(r)) for r in found]
            yield batch

    schema = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return files.mapInPandas(first_records, f"{schema}, header string").where("header is not null")


def _xor(one: Column, other: Column) -> Column:
    return one != other


def _compressed() -> Column:
    return F.coalesce(*[F.when(F.lower("path").endswith(ending), F.lit(True)) for ending in CODECS], F.lit(False))


def ranges(files: DataFrame, n: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The files' ranges ``start`` to ``end`` with ``inside``, whether the range begins in a quoted cell.

    A range that ends alike however it begins fixes the state after it; one that swaps the states turns it
    around. So the state is that of the last range that fixed it, turned by the number of swaps since. Ranges are
    looked through by ``n`` tasks.
    """
    whole = _compressed()
    last = F.greatest(F.lit(0), F.col("length") - 1)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long")))
    cut = files.withColumn("start", F.explode(starts)).withColumn("end", F.when(~whole, F.least(F.col("start") + range_bytes, F.col("length"))))

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["end"]):
                outside, inside = effect(path, int(start), int(end))
                yield pd.DataFrame({"path": [path], "start": [start], "outside": [outside], "within": [inside]})

    # Only files of more than one range need to be looked through.
    several = cut.where(F.col("length") > range_bytes).where(~whole)
    effects = several.select("path", "start", "end").repartition(n).mapInPandas(of_batches, "path string, start long, outside boolean, within boolean")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("outside") & ~F.col("within")
    fixes = F.when(F.col("outside") == F.col("within"), F.struct("outside", F.col("swaps").alias("at")))
    states = (
        effects.withColumn("swaps", F.coalesce(F.sum(swaps.cast("long")).over(before), F.lit(0)))
        .withColumn("fixed", F.last(fixes, ignorenulls=True).over(before))
        .withColumn("since", F.col("swaps") - F.coalesce("fixed.at", F.lit(0)))
        .select("path", "start", _xor(F.coalesce("fixed.outside", F.lit(False)), F.col("since") % 2 == 1).alias("inside"))
    )
    return cut.join(states, ["path", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def read_csv_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, schema: T.StructType | None = None) -> DataFrame:
    """All records under a path or pattern as columns of text, by the names in each file's header.

    Files may have their columns in different order, or lack some, which are null then. Partition folders
    give columns of their own. A record is parsed by Spark's ``from_csv``. Lines end with a line feed, with a
    carriage return before it or not. With a schema the columns have its types; it must name them in the order of
    every file, else it is an error.
    """
    files = csv_files(spark, path)
    folders = [c for c in files.columns if c not in ("path", "length")]
    known = with_headers(files).select("path", "header")
    headers = [json.loads(r.header) for r in known.select("header").distinct().orderBy("header").collect()]  # the different ones
    if schema is not None and any(names != schema.names for names in headers):
        raise ValueError(f"the schema names the columns {schema.names}, files have {headers}")
    # One task for each range; the listing has the lengths, no file is opened for them.
    each = F.when(_compressed(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes)))
    n = max(1, files.agg(F.sum(each)).first()[0] or 0)
    cut = ranges(files, n, range_bytes).join(known, "path").repartition(n)
    types = dict(files.dtypes)
    carried = [f"{c}" for c in ("header", *folders)]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                name, start, end, inside = (row.column(c)[0].as_py() for c in ("path", "start", "end", "inside"))
                found = records(name, start, end, inside)
                if start == 0:
                    next(found, None)  # the header
                for some in _batched(found):
                    same = [row.column(c).take(pa.array([0] * len(some))) for c in carried]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.string())], names=[*carried, "record"])

    row = ", ".join([f"`{c}` {types.get(c, 'string')}" for c in carried] + ["record string"])
    rows = cut.mapInArrow(of_batches, row)
    options = {"escape": '"', "multiLine": "true"}
    parsed = {}
    for k, names in enumerate(headers):
        kinds = schema.fields if schema is not None else [T.StructField(n, T.StringType()) for n in names]
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kinds)
        text = F.when(F.col("header") == json.dumps(names), F.col("record"))
        parsed[f"_{k}"] = F.from_csv(text, F.lit(fields), options)
    columns: dict[str, list[Column]] = {}
    for k, names in enumerate(headers):
        for n in names:
            columns.setdefault(n, []).append(F.col(f"_{k}").getField(n))
    named = [F.coalesce(*found).alias(n) for n, found in columns.items()]
    return rows.withColumns(parsed).select(*named, *[F.col(f"`{c}`") for c in folders]) if headers else rows.select(*[F.col(f"`{c}`") for c in folders])


def _batched(found: Iterator[bytes]) -> Iterator[list[str]]:
    some, size = [], 0
    for record in found:
        some.append(record.decode("utf-8", "replace"))
        size += len(record)
        if size >= BATCH_BYTES or len(some) >= 10_000:
            yield some
            some, size = [], 0
    if some:
        yield some
