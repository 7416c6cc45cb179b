"""Repeated lines across documents, with built-in column functions alone.

The keys of all lines are hashed once and written as numbers; counting and marking read
those numbers, so the texts are split and hashed once and are shuffled once, when the few
dropped positions meet their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratiowatch.session import cut_lineage

#: The white space that is stripped, and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def drop_repeated_lines(docs: DataFrame, min_key_length: int = 10, min_docs: int = 2, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Drop lines that many documents hold, except in the smallest document holding them.

    A key of at least ``min_key_length`` code points found in at least ``min_docs`` distinct
    documents loses all its lines in every document but the one with the smallest id. All
    columns are kept; ``kept_text``, ``n_lines`` and ``n_dropped`` are added, replacing
    columns of those names. Null and empty texts are one empty line. Rows that share an id
    are one document for counting, and each row loses its own lines; a null id is a document
    smaller than all others. Keys are compared by 128 bits of hash.

    The count of distinct documents is taken in two steps, (key, document) and then key, so
    a line that a third of all documents hold is spread over all tasks and folded before it
    is shuffled. The join that marks lines is left to the skew handling of adaptive execution.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    cells = (docs.select(F.col(id_column).alias("i"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .select("i", "t", "pos", line_key(F.col("line")).alias("key"))
             .where(F.char_length("key") >= min_key_length)
             .select("i", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit(1)).alias("h2")))
    cells = cut_lineage(cells)
    seen = cells.groupBy("h1", "h2", "i").agg(F.count(F.lit(1)).alias("n"))
    least = F.when(~F.max(F.col("i").isNull()), F.min("i"))  # a null is the smallest
    repeated = (seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), least.alias("first"))
                .where(F.col("n_docs") >= min_docs).select("h1", "h2", "first"))
    repeated = cut_lineage(repeated)  # read anew, both sides of the join are plain shuffles that can be split
    marked = (cells.join(repeated, ["h1", "h2"]).where(~F.col("i").eqNullSafe(F.col("first")))
              .groupBy(F.col("i").alias("_line_i"), F.col("t").alias("_line_t"))
              .agg(F.collect_set("pos").alias("_line_drops")))
    held = docs.withColumns({"_line_all": F.split(text, "\n"), "_line_text": text, "_line_hash": F.xxhash64(text)})
    joined = held.join(marked, held[id_column].eqNullSafe(marked["_line_i"]) & (held["_line_hash"] == marked["_line_t"]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_line_all") - 1), F.col("_line_drops"))
    kept = F.array_join(F.transform(places, lambda at: F.get(F.col("_line_all"), at)), "\n")
    return joined.withColumns({
        "n_lines": F.size("_line_all").cast("bigint"),
        "n_dropped": F.coalesce(F.size("_line_drops"), F.lit(0)).cast("bigint"),
        "kept_text": F.when(F.col("_line_drops").isNull(), F.col("_line_text")).otherwise(kept),
    }).drop("_line_all", "_line_text", "_line_hash", "_line_i", "_line_t", "_line_drops")
