"""CSV files read by many tasks, also where quoted values hold line breaks.

Spark cuts a file into byte ranges at line ends, but whether a line begins a record depends on all quotes before it. So
each range is read twice:

1. What would the range end in, inside quotes or not, if it began outside, and if it began inside? One row for each range;
   composing these along each file gives every range's true start.
2. With that start, a task cuts its range into records. A record that crosses a range's end is handed on in pieces, at
   most two for each range, and put together.

A quote opens a value only at the value's start; elsewhere it is an ordinary character, as for Spark's own reader. Lines
without quotes, nearly all, are settled by whole batches.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialize

MARK = "\ufeff"
#: Values that end on their line, from outside quotes: `"..."` with doubled quotes inside, or anything that starts otherwise.
_CLOSED = re.compile(r'(?:"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*|)(?:,|$)')
_TO_END_OF_QUOTES = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:,|$)')

WHOLE, BEGIN, MIDDLE, END = range(4)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line that begins inside or outside of them."""
    at = 0
    if inside:
        found = _TO_END_OF_QUOTES.match(line)
        if not found:
            return True
        if not found.group().endswith(","):
            return False
        at = found.end()
    while True:
        found = _CLOSED.match(line, at)
        if not found:
            return True
        if not found.group().endswith(","):
            return False
        at = found.end()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Stretches of lines of one range: its file and first byte, and the lines."""
    for batch in batches:
        if not len(batch):
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        changes = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) | (blocks[1:] != blocks[:-1])
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            yield (files[begin].as_py(), int(blocks[begin])), batch.column("value").slice(begin, end - begin)


def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over (file, block, value): a range's end for each of its two possible starts."""
    found: dict[tuple[str, int], list[bool]] = {}
    for key, lines in _ranges(batches):
        state = found.setdefault(key, [False, True])
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            state[:] = [ends_inside(line, s) for s in state] if state[0] != state[1] else [ends_inside(line, state[0])] * 2
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([found[k][s] for k in keys], pa.bool_()) for s in (0, 1))],
        names=["file", "block", "outside", "inside"],
    )


def cut(opened: set[tuple[str, int]]):
    """For `mapInArrow` over (file, block, value): records and pieces of records; `opened` are the ranges that begin inside quotes.

    `early` are records of which one is the first of its range, so that a header is not looked for among all.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("early", pa.bool_()), ("record", pa.string())])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, line, inside, held, begun, part, early = None, 0, False, [], 0, WHOLE, True
        for key, lines in _ranges(batches):
            rows: list[tuple] = []
            if key != current:
                if held:
                    rows.append((*current, begun, {WHOLE: BEGIN, END: MIDDLE}[part], True, "\n".join(held)))
                current, line, inside, held, begun, early = key, 0, key in opened, [], 0, True
                part = END if inside else WHOLE
            # A line is a record if no quotes are open where it begins or ends. Only lines with quotes change that.
            alone, at = pc.and_(pc.not_equal(lines, ""), pc.not_equal(lines, "\r")).to_numpy(zero_copy_only=False).copy(), 0
            for q in [*np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist(), len(lines)]:
                if inside:
                    held += lines.slice(at, q - at).to_pylist()
                    alone[at:q] = False
                if q == len(lines):
                    break
                text = lines[q].as_py()
                after = ends_inside(text, inside)
                if inside or after:
                    alone[q] = False
                    if not inside:
                        begun = line + q
                    held.append(text)
                    if not after:
                        rows.append((*key, begun, part, early, "\n".join(held)))
                        held, part = [], WHOLE
                inside, at = after, q + 1
            whole = np.flatnonzero(alone)
            if len(whole):
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[0]]).take(pa.array(np.zeros(n, int))), pa.array(np.full(n, key[1])), pa.array(line + whole),
                        pa.array(np.full(n, WHOLE, np.int32)), pa.array((np.arange(n) == 0) & early), lines.take(pa.array(whole)),
                    ],
                    schema=schema,
                )
            if rows:
                yield rows_of(rows)
            early = early and not len(whole) and not held
            line += len(lines)
        if held:
            yield rows_of([(*current, begun, {WHOLE: BEGIN, END: MIDDLE}[part], True, "\n".join(held))])

    return run


@contextmanager
def fixed_ranges(spark: SparkSession) -> Iterator[None]:
    """Both passes see the same ranges, however many executors there are meanwhile."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, early, record) for every record that isn't empty: the range it begins in, its place there, its text.

    Lines end at a line feed; a carriage return before it is no part of the record. Quotes that are still open at a
    file's end are taken to close there. The records are written once.
    """
    with fixed_ranges(spark):
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        ranges = lines.mapInArrow(summarize, "file string, block long, outside boolean, inside boolean")
        # Along a file, a range either settles its end, or keeps or flips the state it began in.
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.groupBy("file", "block").agg(F.max("outside").alias("outside"), F.max("inside").alias("inside"))
        flips = ranges.withColumn("flips", F.count_if(F.col("outside") & ~F.col("inside")).over(Window.partitionBy("file").orderBy("block")))
        settled = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("value"), "flips"))
        starts = flips.withColumn("last", F.last(settled, ignorenulls=True).over(before)).withColumn("turns", F.lag("flips", 1, 0).over(Window.partitionBy("file").orderBy("block")))
        odd = (F.col("turns") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1
        # As many rows as the scan has ranges at most, each of which the driver has planned.
        opened = {(r["file"], r["block"]) for r in starts.where(F.coalesce(F.col("last.value"), F.lit(False)) != odd).select("file", "block").collect()}
        parts = materialize(lines.mapInArrow(cut(opened), "file string, block long, place long, part int, early boolean, record string"), "records")
    pieces = parts.where(F.col("part") != WHOLE)
    number = F.count_if(F.col("part") == BEGIN).over(Window.partitionBy("file").orderBy("block", "place"))
    joined = pieces.withColumn("number", number).groupBy("file", "number").agg(
        F.min(F.struct("block", "place")).alias("at"), F.array_sort(F.collect_list(F.struct("block", "place", "record"))).alias("all")
    )
    crossing = joined.select("file", "at.block", "at.place", F.lit(True).alias("early"), F.array_join("all.record", "\n").alias("record"))
    return parts.where(F.col("part") == WHOLE).select("file", "block", "place", "early", "record").union(crossing)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their header names. All files of a folder must have one header, else the read fails.

    Options as for Spark's reader with quotes doubled inside quotes: an empty value is NULL, a quoted empty one is empty.
    """
    records = csv_records(spark, path)
    first = F.row_number().over(Window.partitionBy("file").orderBy("block", "place"))
    ranked = materialize(records.where("early").withColumn("rank", first), "headers")
    headers = ranked.where("rank = 1").select(F.rtrim("record", F.lit("\r")).alias("header"))
    names = [r["header"] for r in headers.select("header").distinct().limit(2).collect()]
    if not names:
        raise ValueError(f"{path} has no header")
    if len(names) > 1:
        raise ValueError(f"the files of {path} differ in their header: {names[0]!r}, {names[1]!r}")
    columns = [c.lstrip(MARK).strip() for c in next(csv.reader([names[0].lstrip(MARK)]))]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
    body = records.where("not early").select("record").union(ranked.where("rank > 1").select("record"))
    parsed = body.select(F.from_csv(F.rtrim("record", F.lit("\r")), schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(columns)])
