"""Packing documents into sequences by length patterns.

The driver sees the histogram of piece lengths alone, at most one number per length.
Lengths are rounded up to steps, patterns of up to three pieces that fill a sequence are
enumerated, and non-negative least squares finds how often each pattern should be used to
meet the histogram. Counts are rounded and limited to what is there; the exact lengths
then take their places, and what is left over, shorter pieces first of all, goes into the
tightest open space (best fit, longest first), sequence groups at a time. The plan is a
table of ranges: pieces of one length, in rank order, go to these sequences at this offset.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ratiowatch.llm.encoding import crc32_of, give_back, slices_of, word_encoder
from ratiowatch.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct step sizes in a pattern; 256 keeps the fit at 256 equations whatever the corpus is.
STEPS = 256
#: Bytes of text that are encoded at a time: a word is looked up once in each.
ENCODED = 4_000_000


def pieces_of(docs: DataFrame, vocabulary: str, style: str, end_id: int, capacity: int, with_ids: bool = False,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every whole text as ids and ``end_id``, cut only where it is longer than ``capacity``."""
    def cut(rows):
        encoder = word_encoder(vocabulary, style)
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            del batch
            for first, last in slices_of(pc.binary_length(texts).to_pylist(), ENCODED):
                ids, lengths = encoder.encode(texts[first:last])
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                out, at = [], 0
                for doc_id, length in zip(doc_ids[first:last], (lengths + 1).tolist()):
                    for piece, start in enumerate(range(0, length, capacity)):
                        part = ids[at + start:at + min(start + capacity, length)]
                        out.append((doc_id, piece, start, len(part), crc32_of(part), *([part.tolist()] if with_ids else [])))
                    at += length
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5]
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            del texts  # before the next batch is read
        encoder.rest()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, schema)


def least_squares(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative x with the least ``|columns @ x - target|``, by an active set."""
    x, active = np.zeros(columns.shape[1]), []
    gradient = columns.T @ target
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(3 * len(target)):
        free = gradient.copy()
        free[active] = -np.inf
        best = int(free.argmax())
        if free[best] <= tolerance:
            break
        active.append(best)
        while active:
            part = columns[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target)
            if solved.min() > 0:
                break
            current = x[active]
            bad = solved <= 0
            step = np.min(current[bad] / np.maximum(current[bad] - solved[bad], 1e-300))
            moved = current + step * (solved - current)
            x[active] = np.maximum(moved, 0)
            keep = moved > 1e-9
            x[[a for a, k in zip(active, keep) if not k]] = 0
            active = [a for a, k in zip(active, keep) if k]
        else:
            continue
        x[:] = 0
        x[active] = solved
        gradient = columns.T @ (target - columns @ x)
    return x


def _patterns(bins: int, present: set[int]) -> list[tuple[int, ...]]:
    """One to three present steps, falling, that add up to ``bins``."""
    found = [(bins,)] if bins in present else []
    for a in sorted(present, reverse=True):
        if bins - a <= a and bins - a in present:
            found.append((a, bins - a))
        found += [(a, b, bins - a - b) for b in present if b <= a and 0 < bins - a - b <= b and bins - a - b in present]
    return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences: (exact lengths of the pieces in order, number of sequences)."""
    left = Counter({length: count for length, count in histogram.items() if count > 0})
    step = max(1, -(-capacity // STEPS))
    bins = capacity // step
    totals = np.zeros(bins + 1)
    for length in sorted(left):
        if -(-length // step) <= bins:
            totals[-(-length // step)] += left[length]
    patterns = _patterns(bins, set(np.flatnonzero(totals).tolist()))
    groups: list[tuple[tuple[int, ...], int]] = []
    if patterns:
        columns = np.zeros((bins, len(patterns)))
        for n, pattern in enumerate(patterns):
            for b in pattern:
                columns[b - 1, n] += 1
        scale = max(1.0, totals.max())
        repeats = np.rint(least_squares(columns, totals[1:] / scale) * scale).astype(np.int64)
        for n in np.argsort(-repeats, kind="stable").tolist():
            wanted = int(repeats[n])
            while wanted > 0:
                taken: list[int] = []
                for at, b in enumerate(patterns[n]):  # the longest of each step; the last piece takes up the rounding
                    most = capacity - sum(taken) if at and at == len(patterns[n]) - 1 else b * step
                    length = next((x for x in range(most, (b - 1) * step, -1) if left[x] > taken.count(x)), None)
                    if length is None:
                        break
                    taken.append(length)
                if len(taken) < len(patterns[n]):
                    break
                times = min(wanted, *(left[x] // taken.count(x) for x in taken))
                for x in taken:
                    left[x] -= times
                groups.append((tuple(taken), times))
                wanted -= times
    return _best_fit(groups, left, capacity)


def _best_fit(groups: list[tuple[tuple[int, ...], int]], left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left, longest first, into the tightest space; open sequences when none fits."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def add(pattern: tuple[int, ...], count: int) -> None:
        space = capacity - sum(pattern)
        if count:
            if not open_[space]:
                insort(spaces, space)
            open_[space].append((pattern, count))

    for pattern, count in groups:
        add(pattern, count)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count > 0:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                pattern, held = open_[space].pop()
                if not open_[space]:
                    spaces.pop(at)
            else:
                space, pattern, held = capacity, (), count
            each = space // length
            full = min(held, count // each)
            rest = count - full * each if full < held else 0
            add(pattern + (length,) * each, full)
            if rest:
                add(pattern + (length,) * rest, 1)
            if pattern:
                add(pattern, held - full - bool(rest))
            count -= full * each + rest
    return [g for space in sorted(open_) for g in open_[space]]


def ranges(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted columns (length, first rank, first sequence, offset) of the plan."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, count in groups:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a table that gives the same rows each time) with ``sequence_id`` and ``offset``.

    Only the histogram, of at most ``capacity`` rows, reaches the driver. Pieces of one
    length are ranked in slices, so a length that a third of all pieces have is spread over
    many tasks. Equal rows may change places with one another. An empty table gives none.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, ranks, sequences, offsets = ranges(plan(histogram, capacity))
    keys = (lengths << 44) | ranks
    slices = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    counts = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "_slice", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("_inner", F.row_number().over(inside) - 1).join(before, ["length", "_slice"]).select(
        *pieces.columns, (F.col("_before") + F.col("_inner")).alias("_rank"))

    def placed(rows):
        for batch in rows:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            kept = batch.drop_columns(["_rank"])
            yield kept.append_column("sequence_id", pa.array(sequences[at] + rank - ranks[at])).append_column("offset", pa.array(offsets[at]))

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, vocabulary: str, style: str, end_id: int, capacity: int = 2048, with_ids: bool = False,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and the ids on demand.

    Null and empty texts are the end id alone. Rows that share an id are packed one by one.
    Other columns are ignored.
    """
    return pack(cut_lineage(pieces_of(docs, vocabulary, style, end_id, capacity, with_ids, id_column, text_column)), capacity)
