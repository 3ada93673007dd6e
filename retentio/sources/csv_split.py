"""One large quoted CSV file read by many tasks (S1).

A quoted field may hold newlines, so a byte range cannot tell by itself whether
its first line starts a record or goes on inside a quoted field.  Both are
tried: each range is read once, line by line, and every line is noted with what
it is under either assumption.  What a range does to the state (keep it, turn
it, or end in a fixed state whatever came before) is one small row; the ranges'
rows, put together in order, tell the state at each range's start, and with it
which of the two readings holds.  Lines that are whole records - nearly all -
are parsed where they are; only the lines of records that hold newlines or
cross ranges are gathered, by record.

The noted lines are written once to the scratch folder.  That fixes the ranges
(a scan planned anew may cut a file elsewhere) and lets the type pass and later
jobs read them without cutting lines again.

A quote opens a field only at the field's start, a doubled one inside is a
quote, and after a closing one the field goes on to the next separator, as in
Spark's CSV reader.  Lines end with a line feed; where a file's first line ends
with a carriage return and a line feed, that pair is a line feed everywhere.
Empty lines between records are none.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.session import scratch_dir

# the functions that run in tasks travel with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# from the start of a record: whole fields up to the end of the line
_REST = r'(?:[^",][^,]*+|"(?:[^"]|"")*+"[^,]*+|)'
_WHOLE = re.compile(rf"{_REST}(?:,{_REST})*+", re.S)
# from inside a quoted field: its end, then whole fields
_CLOSES = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_REST})*+', re.S)

#: Line notes: states are True inside a quoted field.  ``u`` is the reading that starts a record at the
#: range's start, ``q`` the one that starts inside a quoted field; ``*_in`` and ``*_out`` are the states
#: before and after the line, ``*_rec`` the number of records started in the range so far.
NOTES = ("file string, block long, n long, line string, u_in boolean, u_out boolean, u_rec long, "
         "q_in boolean, q_out boolean, q_rec long")


def line_states(line: str) -> tuple[bool, bool]:
    """(state after the line if it starts a record, state after it if it starts inside a quoted field)."""
    return _WHOLE.fullmatch(line) is None, _CLOSES.fullmatch(line) is None


class _Range:
    """Both readings of one byte range, carried over its Arrow batches."""

    def __init__(self):
        self.n, self.u, self.q, self.u_rec, self.q_rec = 0, False, True, 0, 0

    def note(self, lines: pa.Array):
        quoted = np.flatnonzero(pc.fill_null(pc.match_substring(lines, '"'), False).to_numpy(zero_copy_only=False))
        empty = pc.is_in(lines, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        count = len(lines)
        after = [line_states(lines[int(i)].as_py()) for i in quoted]
        out = []
        for state, rec in ((self.u, self.u_rec), (self.q, self.q_rec)):
            # the state changes at lines with quotes alone
            changes = []
            for from_start, from_inside in after:
                state = from_inside if state else from_start
                changes.append(state)
            runs = np.diff(np.r_[0, quoted, count])
            first = self.u if not out else self.q
            before = np.repeat(np.asarray([first, *changes], bool), np.r_[runs[0] + 1, runs[1:]]
                               if len(quoted) else np.asarray([count]))[:count]
            behind = np.r_[before[1:], state] if count else before
            starts = np.cumsum(~before & ~empty) + rec
            out.append((before, behind, starts))
        at = np.arange(count) + self.n
        self.n += count
        (_, _, su), (_, _, sq) = out
        self.u, self.q = (bool(o[1][-1]) for o in out)
        self.u_rec, self.q_rec = int(su[-1]), int(sq[-1])
        return at, out


def _notes(batches):
    place, state = None, None
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        coded = files.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if (here := (files[a].as_py(), int(blocks[a]))) != place:
                place, state = here, _Range()
            lines = batch.column("line").slice(a, b - a)
            at, ((ui, uo, ur), (qi, qo, qr)) = state.note(lines)
            yield pa.RecordBatch.from_arrays(
                [files.slice(a, b - a), batch.column("block").slice(a, b - a), pa.array(at), lines, pa.array(ui), pa.array(uo),
                 pa.array(ur), pa.array(qi), pa.array(qo), pa.array(qr)],
                names=["file", "block", "n", "line", "u_in", "u_out", "u_rec", "q_in", "q_out", "q_rec"])


def _noted(lines: DataFrame) -> DataFrame:
    """The notes of all lines, written once."""
    at = scratch_dir(lines.sparkSession, "csv-lines")
    lines.mapInArrow(_notes, NOTES).write.parquet(at)
    return lines.sparkSession.read.schema(NOTES).parquet(at)


def _range_starts(notes: DataFrame) -> DataFrame:
    """(file, block, inside, first, crlf, held): the state at each range's start, whether the file's first
    record starts in it or later, whether the file's lines end in CR LF (as its first does), and the place of
    the record before it.  One row a range."""
    last = F.max_by(F.struct("u_out", "q_out", "u_rec", "q_rec"), "n")
    ranges = notes.groupBy("file", "block").agg(
        last.alias("e"), F.min_by(F.col("line").endswith("\r"), "n").alias("cr")).select("file", "block", "e.*", "cr")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("u_out") == F.col("q_out")
    turns = F.col("u_out") & ~F.col("q_out")
    ranges = ranges.withColumn("turned", F.sum(turns.cast("long")).over(upto))
    # since the last range that ends in one state whatever came before, count the turns
    mark = F.last(F.when(fixed, F.struct(F.col("u_out").alias("state"), "turned")), ignorenulls=True).over(before)
    ranges = ranges.withColumns({"mark": mark, "sofar": F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("block")), F.lit(0))})
    odd = (F.col("sofar") - F.coalesce(F.col("mark.turned"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("mark.state"), F.lit(False)) != odd
    ranges = ranges.withColumn("inside", inside)
    ranges = ranges.withColumn("records", F.when(F.col("inside"), F.col("q_rec")).otherwise(F.col("u_rec")))
    ranges = ranges.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0)) == 0)
    return ranges.select("file", "block", "inside", "first", F.first("cr").over(upto).alias("crlf"), F.last(F.when(
        F.col("records") > 0, F.struct("block", "records", "first")), ignorenulls=True).over(before).alias("held"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, record): the text of every record but each file's first (the header), with the place
    of its first line: file, byte range, line in it."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("value").alias("line")))
    notes = _noted(lines)
    # one row a byte range: the lines stay where they are
    told = notes.join(F.broadcast(_range_starts(notes)), ["file", "block"])

    def by_start(name):
        return F.when(F.col("inside"), F.col(f"q_{name}")).otherwise(F.col(f"u_{name}"))

    told = told.withColumns({"was": by_start("in"), "now": by_start("out"), "rec": by_start("rec")})
    # an empty line between records is none; a record's number is that of its range
    told = told.where(F.col("was") | ~F.col("line").isin("", "\r"))
    header = F.when(F.col("rec") > 0, F.col("first") & (F.col("rec") == 1)).otherwise(
        F.col("held.first") & (F.col("held.records") == 1))
    told = told.where(~header)
    whole = told.where(~F.col("was") & ~F.col("now")).select("file", "block", "n", "crlf", F.col("line").alias("record"))
    parts = told.where(F.col("was") | F.col("now"))
    own = F.col("rec") > 0
    parts = parts.select(
        "file", "crlf", F.when(own, F.col("block")).otherwise(F.col("held.block")).alias("start"),
        F.when(own, F.col("rec")).otherwise(F.col("held.records")).alias("rec"),
        F.struct("block", "n", "line").alias("part"))
    gathered = (parts.groupBy("file", "crlf", "start", "rec").agg(F.sort_array(F.collect_list("part")).alias("parts"))
                .select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["n"].alias("n"),
                        "crlf", F.array_join(F.col("parts.line"), "\n").alias("record")))
    every = whole.unionByName(gathered)
    return every.withColumn("record", F.when(F.col("crlf"), F.regexp_replace(
        F.regexp_replace("record", "\r\n", "\n"), "\r$", "")).otherwise(F.col("record"))).drop("crlf")


def read_split_csv(spark: SparkSession, path: str, columns: T.StructType, options: dict, row_id: str | None = None) -> DataFrame:
    """The rows of a CSV file or folder, each file read by as many tasks as it has byte ranges."""
    given = records(spark, path)
    # a record is parsed by itself, so a line feed in it is one inside quotes
    row = F.from_csv("record", columns.simpleString() if not columns.fields else ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in columns.fields),
        {k: v for k, v in options.items() if k != "header"} | {"mode": "PERMISSIVE"})
    out = given.select("file", "block", "n", row.alias("row"))
    place = [F.struct("file", "block", F.col("n").alias("row")).alias(row_id)] if row_id and row_id not in columns.names else []
    return out.select("row.*", *place)
