"""Benchmark passages in a corpus, by a distributed positional inverted index.

The index is a table of segments. A segment covers some four million characters of whole
documents and holds, for every distinct word, the sorted places of all its occurrences,
so it takes a few megabytes and any task can open it alone. Words are kept as 64-bit
hashes. The test side comes in chunks of bounded size; for each window, the lists of its
words are intersected inside a segment, rarest word first, each moved by the word's offset,
until no place is left or all words agree.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ratiowatch.llm.encoding import batches_of, give_back
from ratiowatch.session import cut_lineage

#: Characters of a segment, and of the test items that are matched at a time.
SEGMENT_CHARACTERS, CHUNK_CHARACTERS = 4_000_000, 4_000_000
#: Letters and digits stay, A-Z are folded, other ASCII parts words; bytes from 128 on belong to words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SEGMENTS = ("part long, segment long, doc_ids array<bigint>, sizes array<bigint>, "
            "words binary, counts binary, places binary")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of all words of all whole texts, written once to the shared folder."""
    def indexed(rows):
        part, segment = TaskContext.get().partitionId(), 0
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in batches_of(texts, SEGMENT_CHARACTERS):
                words, sizes = [], []
                for text in texts[first:last]:
                    found = words_of(text)
                    words += found
                    sizes.append(len(found))
                distinct = list(set(words))
                number = dict(zip(distinct, range(len(distinct))))
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                hashes = np.fromiter(map(_hash, distinct), np.uint64, len(distinct))
                order = np.argsort(hashes)
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                ids = rank[ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([segment]), pa.array([doc_ids[first:last]], pa.list_(pa.int64())),
                     pa.array([sizes], pa.list_(pa.int64())), pa.array([hashes[order].tobytes()]),
                     pa.array([np.bincount(ids, minlength=len(order)).astype("<u4").tobytes()]),
                     pa.array([np.argsort(ids, kind="stable").astype("<u4").tobytes()])],
                    ["part", "segment", "doc_ids", "sizes", "words", "counts", "places"])
                segment += 1
            del batch, texts  # before the next one is read
            give_back()

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return cut_lineage(rows.mapInArrow(indexed, SEGMENTS), codec="zstd")


class Windows:
    """Windows of the test items: columns of word hashes, and the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        held: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [_hash(w) for w in words_of(text)]
            for at in range(max(1, len(words) - size + 1) if words else 0):
                held[tuple(words[at:at + size])].add(item)
        self.items = [sorted(v) for v in held.values()]
        self.lengths = np.array([len(k) for k in held], np.int64)
        flat = np.fromiter((h for k in held for h in k), np.uint64)
        self.vocabulary, self.words = np.unique(flat, return_inverse=True)
        self.firsts = np.cumsum(self.lengths) - self.lengths


class Segment:
    """An opened segment."""

    def __init__(self, sizes: list[int], words: bytes, counts: bytes, places: bytes):
        self.words, self.counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64)
        self.places = np.frombuffer(places, "<u4")
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.stops = np.cumsum(self.counts)

    def matches(self, windows: Windows, slop: int = 0):
        """(window, starts) for windows that occur; with ``slop``, each word within so many words of its own offset."""
        at = np.searchsorted(self.words, windows.vocabulary)
        at[at == len(self.words)] = 0
        here = self.words[at] == windows.vocabulary if len(self.words) else np.zeros(len(at), bool)
        whole = np.logical_and.reduceat(here[windows.words], windows.firsts) if len(windows.firsts) else np.empty(0, bool)
        for window in np.flatnonzero(whole).tolist():
            first, length = windows.firsts[window], int(windows.lengths[window])
            terms = at[windows.words[first:first + length]]
            starts = None
            for offset in np.argsort(self.counts[terms], kind="stable").tolist():  # the rarest first
                term = terms[offset]
                places = self.places[self.stops[term] - self.counts[term]:self.stops[term]]
                if starts is None:
                    starts = places.astype(np.int64) - offset
                    starts = starts[starts >= 0]
                elif slop:
                    low, high = starts + offset - slop, starts + offset + slop + 1
                    starts = starts[np.searchsorted(places, low) < np.searchsorted(places, high)]
                else:
                    near = np.searchsorted(places, starts + offset)
                    near[near == len(places)] = 0
                    starts = starts[places[near] == starts + offset]
                if not len(starts):
                    break
            # a window lies inside one document
            starts = starts[np.searchsorted(self.ends, starts, "right") == np.searchsorted(self.ends, starts + length - 1, "right")]
            if len(starts):
                yield window, starts


def _chunks(benchmark: DataFrame, item_column: str, text_column: str):
    """Lists of (item, text) of bounded size; the item as text, null as an empty one."""
    rows = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).alias("text")).where(
        F.col("text").isNotNull())
    total = rows.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // CHUNK_CHARACTERS)
    for n in range(parts):
        yield [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == n).collect()]


MATCHES = "part long, segment long, number int, doc_id long, n_words long, items array<string>, hits array<int>"


def find_passages(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0, item_column: str = "item_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, items (sorted texts) and n_hit.

    A window is so many consecutive words of an item, or all of a shorter item; an item
    without words has none. A word of a document is hit if an occurrence of a window covers
    it. With ``slop`` windows also match in proximity, each word up to so many words from its
    place. Null and empty texts have no words and no hits. Repeated rows and ids are documents
    of their own; items that share an id are one item; extra columns are ignored. The
    benchmark is matched in chunks of bounded size against all segments.
    """
    spark = index.sparkSession
    docs = index.select("part", "segment", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("number", "d")).select(
        "part", "segment", "number", F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    found = None
    for items in _chunks(benchmark, item_column, text_column):
        held = spark.sparkContext.broadcast(Windows(items, window))

        def matched(rows, held=held):
            windows = held.value
            for batch in rows:
                for part, segment, doc_ids, sizes, *lists in zip(*(batch.column(n).to_pylist() for n in range(7))):
                    opened = Segment(sizes, *lists)
                    hits, names = defaultdict(list), defaultdict(set)
                    for n, starts in opened.matches(windows, slop):
                        owners = np.searchsorted(opened.ends, starts, "right")
                        for owner in np.unique(owners).tolist():
                            hits[owner].append((starts[owners == owner], int(windows.lengths[n])))
                            names[owner].update(windows.items[n])
                    if hits:
                        numbers = sorted(hits)
                        places = [np.unique(np.concatenate([(s[:, None] + np.arange(k)).ravel() for s, k in hits[o]])) - (opened.ends[o] - sizes[o])
                                  for o in numbers]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(numbers)), pa.array([segment] * len(numbers)), pa.array(numbers, pa.int32()),
                             pa.array([sorted(names[o]) for o in numbers], pa.list_(pa.string())),
                             pa.array([p.tolist() for p in places], pa.list_(pa.int32()))],
                            ["part", "segment", "number", "items", "hits"])

        hit = index.mapInArrow(matched, "part long, segment long, number int, items array<string>, hits array<int>")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.select("doc_id", "n_words", F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_hit")).withColumn(
            "items", F.coalesce("items", F.array().cast("array<string>")))
    merged = found.groupBy("part", "segment", "number").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("bigint").alias("n_hit"))
    return docs.join(merged, ["part", "segment", "number"], "left").select(
        "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``found`` with n_items and contaminated: a document with a hit and at least one hit word in ``share``."""
    return found.withColumns({
        "n_items": F.size("items").cast("bigint"),
        "contaminated": (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))})
