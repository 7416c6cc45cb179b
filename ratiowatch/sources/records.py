"""Records of delimited text, read by many tasks though quoted values may span lines.

Whether a line break ends a record depends on all quotes before it. A small automaton says
so, and at line breaks it has only two states: between records, or inside a quoted value.
Each file split is read once from both states, which gives its effect as a function of the
state it starts in, and the records that it starts. These functions, a few numbers per
split, are composed along each file; then every task knows the state and the record number
its splits start with, and cuts its own lines into records. Only records that lie across
splits are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratiowatch.session import cut_lineage

C = F.col
MARK = b"\xef\xbb\xbf"
BLANK = bytes(range(33))


class Quotes:
    """The automaton over one line; True stands for inside a quoted value.

    A quote opens a value only at the start of a field, after white space at most; a doubled
    quote inside is a quote; what follows a closing quote belongs to the field.
    """

    def __init__(self, separator: str):
        mark = re.escape(separator.encode())
        space = b"[\\x00-\\x20]" if separator != "\t" else b"[\\x00-\\x08\\x0a-\\x20]"
        other = b"[^" + mark + b"]"
        self.close = re.compile(rb'(?:[^"]++|"")*+"' + other + b"*+")
        self.fields = re.compile(b'(?:(?:' + space + b'*+"(?:[^"]++|"")*+"' + other + b"*+|(?!" + space + b'*+")' + other + b"*+)" + mark + b")*+")
        self.last = re.compile(space + b'*+(?:"(?:[^"]++|"")*+"|[^"]|\\Z)')
        self.cell = re.compile(space + b'*+"((?:[^"]++|"")*+)"(' + other + b"*+)|(" + other + b"*+)")
        self.mark = separator.encode()

    def after(self, line: bytes, inside: bool) -> bool:
        at = 0
        if inside:
            found = self.close.match(line)
            if found is None:
                return True
            at = found.end()
            if at == len(line):
                return False
            at += len(self.mark)
        at = self.fields.match(line, at).end()
        return self.last.match(line, at) is None

    def cells(self, record: bytes) -> list[bytes | None]:
        """Values of a whole record; empty ones are null. A value that is never closed takes the rest."""
        out, at = [], 0
        while True:
            found = self.cell.match(record, at)
            quoted, rest, bare = found.groups()
            if bare is not None and bare.lstrip(BLANK).startswith(b'"'):
                return [*out, record[at:].lstrip(BLANK)[1:].replace(b'""', b'"')]
            out.append((bare.strip(BLANK) if quoted is None else quoted.replace(b'""', b'"') + rest.strip(BLANK)) or None)
            at = found.end() + len(self.mark)
            if found.end() >= len(record):
                return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, block, line) in the order of the files; line breaks are "\\n", and bytes are as they are."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(C("_metadata.file_path").alias("path"), C("_metadata.file_name").alias("name"),
                       C("_metadata.file_block_start").alias("block"), C("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int, pa.Array]]:
    """Slices of a batch with one file split each."""
    paths, blocks = batch.column(0), batch.column(2)
    changed = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1])) if len(paths) > 1 else pa.array([], pa.bool_())
    edges = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), len(paths)]
    for first, last in zip(edges, edges[1:]):
        if last > first:
            yield paths[first].as_py(), batch.column(1)[first].as_py(), blocks[first].as_py(), batch.column(3)[first:last]


def _shown(column: pa.Array) -> np.ndarray:
    """Which lines hold more than white space."""
    trimmed = pc.ascii_trim(column.view(pa.string()), BLANK.decode())
    return pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)


def _quoted(column: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(column, b'"').to_numpy(zero_copy_only=False))


EFFECT = "path string, name string, block long, after_bare boolean, after_quoted boolean, starts_bare long, starts_quoted long, open_bare long, open_quoted long"


def block_effects(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Per file split: the state after it, the records it starts and its line breaks inside values, for both states before it."""
    def measured(batches):
        quotes, held = Quotes(separator), {}
        for batch in batches:
            for file, name, block, column in _runs(batch):
                state = held.setdefault((file, name, block), [[False, 0, 0], [True, 0, 0]])
                shown, marked = np.concatenate([[0], np.cumsum(_shown(column))]), _quoted(column).tolist()
                for automaton in state:
                    at = 0
                    for place in [*marked, len(column)]:
                        inside = automaton[0]
                        if inside:
                            automaton[2] += place - at
                        else:
                            automaton[1] += int(shown[place] - shown[at])
                        if place < len(column):
                            automaton[0] = quotes.after(column[place].as_py().removeprefix(MARK) if block == 0 and place == 0 else column[place].as_py(), inside)
                            automaton[1] += not inside
                            automaton[2] += automaton[0]
                        at = place + 1
        yield pa.RecordBatch.from_pylist([
            {"path": f, "name": n, "block": b, "after_bare": bare[0], "after_quoted": quoted[0], "starts_bare": bare[1], "starts_quoted": quoted[1],
             "open_bare": bare[2], "open_quoted": quoted[2]} for (f, n, b), (bare, quoted) in held.items()], schema=_EFFECT_SCHEMA)

    return lines(spark, path).mapInArrow(measured, EFFECT)


_EFFECT_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (f.split() for f in EFFECT.split(", "))])


def block_starts(effects: DataFrame) -> DataFrame:
    """Per file split: the state and the record number it starts with, and its line breaks inside values. A file's splits meet in one group."""
    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        inside, number, out = False, 0, []
        for r in rows.itertuples():
            after = bool(r.after_quoted if inside else r.after_bare)
            out.append((r.path, r.block, inside, number, after, r.open_quoted if inside else r.open_bare))
            number += r.starts_quoted if inside else r.starts_bare
            inside = after
        return pd.DataFrame(out, columns=["path", "block", "inside", "number", "left_open", "breaks"])

    return effects.groupBy("path").applyInPandas(composed, "path string, block long, inside boolean, number long, left_open boolean, breaks long")


@dataclass
class Layout:
    """What is known of a set of files after one reading: a row per file split, line breaks inside values, splits that end inside a value."""

    starts: DataFrame
    breaks: int
    across: int


def layout(spark: SparkSession, path: str, separator: str) -> Layout:
    starts = cut_lineage(block_starts(block_effects(spark, path, separator)))
    found = starts.agg(F.sum("breaks").alias("breaks"), F.count_if("left_open").alias("across")).first()
    return Layout(starts, found["breaks"] or 0, found["across"])


def _located(spark: SparkSession, path: str, starts: DataFrame) -> DataFrame:
    """Lines with the state and number their split starts with: one row per split of the files is broadcast, and order is kept."""
    side = starts.select(C("path").alias("to_path"), C("block").alias("to_block"), "inside", "number")
    rows = lines(spark, path)
    return rows.join(F.broadcast(side), (rows["path"] == C("to_path")) & (rows["block"] == C("to_block"))).select(
        "path", "name", "block", "line", "inside", "number")


def _parts(batch_rows, separator: str) -> Iterator[tuple[str, str, int, int, bytes, bool]]:
    """(path, name, block, row_no, bytes, whole) of all records and parts of records in a stream of located lines."""
    quotes, current, pending, inside, number, cut, first = Quotes(separator), None, [], False, 0, False, True
    for batch in batch_rows:
        offset = 0
        for file, name, block, column in _runs(batch):
            if current is None or current[0] != file or current[2] != block:
                if pending:
                    yield (*current, number - 1, b"\n".join(pending) + b"\n", False)
                current, pending = (file, name, block), []
                inside, number, first = batch.column(4)[offset].as_py(), batch.column(5)[offset].as_py(), True
                cut = inside
            for value in column:
                line = value.as_py()
                if first:
                    first = False
                    if block == 0:
                        line = line.removeprefix(MARK)
                if not inside:
                    if not line.strip(BLANK):
                        continue
                    number += 1
                pending.append(line)
                inside = b'"' in line and quotes.after(line, inside) or inside and b'"' not in line
                if not inside:
                    yield (*current, number - 1, b"\n".join(pending), not cut)
                    pending, cut = [], False
            offset += len(column)
    if pending:
        yield (*current, number - 1, b"\n".join(pending) + b"\n", False)


BATCH = 20_000


def records(spark: SparkSession, path: str, separator: str, encoding: str, found: Layout | None = None) -> DataFrame:
    """(path, name, row_no, record): every record of every file with its number in the file, from 0.

    Lines of white space between records are left out and not counted. A byte-order mark is
    dropped. ``\\r`` at the end of a record is dropped; inside values everything is kept. A
    value that is never closed takes the rest of its file.
    """
    found = found or layout(spark, path, separator)

    def cut(whole: bool):
        def read(batches):
            out = []
            for file, name, block, number, data, complete in _parts(batches, separator):
                if complete is whole:
                    out.append((file, name, block, number, data))
                    if len(out) == BATCH:
                        yield _rows(out)
                        out = []
            yield _rows(out)
        return read

    schema = "path string, name string, block long, row_no long, data binary"
    located = _located(spark, path, found.starts)
    rows = located.mapInArrow(cut(True), schema).select("path", "name", "row_no", "data")
    if found.across:
        touched = found.starts.where("left_open").select("path").distinct()  # only their files are cut a second time
        again = _located(spark, path, found.starts.join(touched, "path", "left_semi"))
        parts = again.mapInArrow(cut(False), schema)
        joined = parts.groupBy("path", "name", "row_no").agg(F.array_sort(F.collect_list(F.struct("block", "data"))).alias("p"))  # parts of one record
        rows = rows.unionByName(joined.select("path", "name", "row_no", F.aggregate(
            "p", F.lit(b""), lambda done, part: F.concat(done, part["data"])).alias("data")))
    return rows.select("path", "name", "row_no", F.rtrim(F.decode("data", encoding), F.lit("\r\n")).alias("record"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "name", "block", "row_no", "data"])


def cells_of(rows: DataFrame, separator: str) -> DataFrame:
    """``rows`` with ``cells``, the values of ``record`` as an array; empty values are null."""
    def split(batches):
        quotes = Quotes(separator)
        for batch in batches:
            cells = [[None if v is None else v.decode() for v in quotes.cells(r.as_py().encode())] for r in batch.column("record")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), batch.column("row_no"), pa.array(cells, pa.list_(pa.string()))],
                                             ["path", "name", "row_no", "cells"])

    return rows.select("path", "name", "row_no", "record").mapInArrow(split, "path string, name string, row_no long, cells array<string>")
