"""Delimited text in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratiowatch.sources import records

SEPARATORS = (",", ";", "\t", "|")


def sniff(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """Separator, encoding and whether there are quotes, in one pass over all lines.

    The separator is the one that most lines hold outside quotes, then the one with more of
    them on every such line, then the more even one: lines inside a quoted value and titles
    above a table hold few.
    """
    lines = spark.read.text(path).filter(F.length("value") > 0)
    bare = F.regexp_replace("value", '"[^"]*"', "")
    wanted = []
    for n, separator in enumerate(SEPARATORS):
        held = F.nullif(F.length(bare) - F.length(F.translate(bare, separator, "")), F.lit(0))
        wanted += [F.count(held).alias(f"n{n}"), F.min(held).alias(f"least{n}"), F.coalesce(F.stddev_pop(held), F.lit(0.0)).alias(f"spread{n}")]
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.max(~F.is_valid_utf8("value")).alias("broken"),
                      F.max(F.contains("value", F.lit('"'))).alias("quoted"), *wanted).first()
    if not found["n"]:
        raise ValueError("The file is empty.")
    best = max(range(len(SEPARATORS)), key=lambda n: (found[f"n{n}"], found[f"least{n}"] or 0, -found[f"spread{n}"]))
    return SEPARATORS[best], "ISO-8859-1" if found["broken"] else "UTF-8", bool(found["quoted"])


def read_delimited(spark: SparkSession, path: str, separator: str | None = None,
                   encoding: str | None = None) -> DataFrame:
    """A table with a header line; every column is text and is typed later.

    Quotes inside a quoted value are doubled. Where values span lines, the files are cut
    into records by ``records``, split by split; no file becomes one task for it. The header
    is the first record of the first file by name, and every file has one.
    """
    sniffed, found, quoted = sniff(spark, path)
    separator, encoding = separator or sniffed, encoding or found
    options = dict(sep=separator, mode="PERMISSIVE", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    known = records.layout(spark, path, separator) if quoted else None
    if known is None or not known.breaks:
        return spark.read.csv(path, header=True, encoding=encoding, **options)
    rows = records.records(spark, path, separator, encoding, known)
    first = records.cells_of(rows.where("row_no = 0").orderBy("path").limit(1), separator).first()
    names = [name or f"_c{n}" for n, name in enumerate(first["cells"])]
    names = [name if names.count(name) == 1 else f"{name}{n}" for n, name in enumerate(names)]
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    parsed = F.from_csv("record", F.lit(schema), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    return rows.where("row_no > 0").select(parsed.alias("r")).select("r.*")


def read_grid(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Tables without a header as (table_id, row_no, cells): the file's place under ``path``, the row's number in it from 0, all its cells.

    Rows may differ in length. Numbers come from counts per file split and their sums, so
    nothing is sorted, and the rows can be read as statement grids.
    """
    sniffed, encoding, _ = sniff(spark, path)
    separator = separator or sniffed
    rows = records.cells_of(records.records(spark, path, separator, encoding), separator)
    inner = F.regexp_extract("path", rf"/{re.escape(path.rstrip('/').split('/')[-1])}/(.*)$", 1)  # files of several folders may share a name
    return rows.select(F.coalesce(F.nullif(inner, F.lit("")), "name").alias("table_id"), "row_no", "cells")


def write_delimited(frame: DataFrame, path: str) -> None:
    frame.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns."""
    if not tables:
        raise ValueError("No tables to stack.")
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked
