"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

The index is a table of segments of whole documents. A segment holds, for every distinct
word, the documents that have it by falling impact, so a list is read from its best end.
A query reads its words' lists in parallel. Every document met is scored at once by direct
access to the other lists, and the places found there count as seen. The best position of
a list is the end of its gap-free seen part; no unseen document scores more than the sum of
the impacts at the best positions. A task carries its best documents of each query from
segment to segment, and leaves a segment once that sum is strictly below the last of them,
so equal scores are never lost.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratiowatch.llm.encoding import batches_of
from ratiowatch.session import cut_lineage

#: Characters of a segment, and of the queries that are searched at a time.
SEGMENT_CHARACTERS, CHUNK_CHARACTERS = 8_000_000, 4_000_000
#: Entries read from each list at first; each further reading of a query doubles them.
FIRST_READ = 16
#: Words are letters, digits and all beyond ASCII; A-Z are folded and everything else parts words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SEGMENTS = "docs binary, nulls binary, words binary, counts binary, holders binary, impacts binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Scoring:
    """The whole numbers of the score: a word adds weight * ((gain * tf) div (pace * tf + stretch * m)), m = 100 - slope + (slope * n * N) div L."""

    top: int = 20
    gain: int = 1_000_000_000
    pace: int = 1_000
    stretch: int = 12
    slope: int = 25
    precision: int = 1_000

    def weight(self, documents: int, holders: int) -> int:
        return math.floor(self.precision * math.log((2 * documents + 2) / (2 * holders + 1)))

    def measure(self, terms: int, documents: int, all_terms: int) -> int:
        return 100 - self.slope + self.slope * terms * documents // all_terms


@dataclass
class Index:
    segments: DataFrame
    documents: int
    terms: int


def _term_counts(docs: DataFrame, text_column: str) -> tuple[int, int]:
    """Documents with a term, and all terms."""
    def counted(batches):
        n = total = 0
        for batch in batches:
            for text in batch.column(0):
                found = len(terms_of(text.as_py()))
                n += found > 0
                total += found
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select(text_column).mapInArrow(counted, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def build_index(docs: DataFrame, scoring: Scoring = Scoring(), id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Impact-ordered segments of all words of all whole texts, written once to the shared folder.

    Null and empty texts have no words and are in no list. Rows are documents of their own,
    also if they share an id or a text. Only the two columns named are read.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    documents, all_terms = _term_counts(docs, "text")

    def indexed(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in batches_of(texts, SEGMENT_CHARACTERS):
                number: dict[bytes, int] = {}
                keys, sizes = [], []
                for text in texts[first:last]:
                    words = terms_of(text)
                    sizes.append(len(words))
                    keys.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                if not number:
                    continue
                owner = np.repeat(np.arange(len(sizes)), sizes)
                pairs, tf = np.unique(np.concatenate(keys) * len(sizes) + owner, return_counts=True)
                word, doc = pairs // len(sizes), pairs % len(sizes)
                measure = np.array([scoring.measure(n, documents, all_terms) for n in sizes], np.int64)
                impact = scoring.gain * tf // (scoring.pace * tf + scoring.stretch * measure[doc])
                order = np.lexsort((doc, -impact, word))
                held = ids[first:last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (
                        np.array([d or 0 for d in held], "<i8").tobytes(), np.array([d is None for d in held]).tobytes(), b" ".join(number),
                        np.bincount(word, minlength=len(number)).astype("<u4").tobytes(), doc[order].astype("<u4").tobytes(),
                        impact[order].astype("<i4").tobytes())],
                    ["docs", "nulls", "words", "counts", "holders", "impacts"])

    return Index(cut_lineage(docs.mapInArrow(indexed, SEGMENTS), codec="zstd"), documents, all_terms)


class Lists:
    """The lists of an opened segment that some query reads."""

    def __init__(self, words: bytes, counts: bytes, holders: bytes, impacts: bytes, wanted: dict[bytes, int]):
        stops = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64))
        holders, impacts = np.frombuffer(holders, "<u4"), np.frombuffer(impacts, "<i4")
        self.holders: dict[int, np.ndarray] = {}
        self.impacts: dict[int, np.ndarray] = {}
        self._by_document: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, word in enumerate(words.split(b" ")):
            term = wanted.get(word)
            if term is not None:
                begin, end = int(stops[at - 1]) if at else 0, int(stops[at])
                self.holders[term], self.impacts[term] = holders[begin:end], impacts[begin:end].astype(np.int64)

    def places(self, term: int, documents: np.ndarray) -> np.ndarray:
        """Direct access: the places of these documents in the list of a term, -1 where absent."""
        found = self._by_document.get(term)
        if found is None:
            order = np.argsort(self.holders[term])
            found = self._by_document[term] = self.holders[term][order], order
        sorted_holders, order = found
        at = np.searchsorted(sorted_holders, documents)
        at[at == len(sorted_holders)] = 0
        return np.where(sorted_holders[at] == documents, order[at], -1)


def best_positions(lists: Lists, query: list[tuple[int, int]], floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a segment that may be among the best ``top``: all with a score of at least the last of these.

    ``query`` has (term, weight times repeats); documents below ``floor`` are of no interest.
    """
    query = [(t, w) for t, w in query if w > 0 and t in lists.holders]
    n_docs = np.empty(0, np.int64)
    if not query:
        return n_docs, n_docs
    holders, impacts = [lists.holders[t] for t, _ in query], [w * lists.impacts[t] for t, w in query]
    seen = [np.zeros(len(h) + 1, bool) for h in holders]  # the entry beyond the end is never seen
    best = [0] * len(query)  # places before this one are all seen
    step = FIRST_READ
    documents, scores = n_docs, n_docs
    while True:
        # no list is read again where direct access has been: reading goes on from the best position
        fresh = np.unique(np.concatenate([h[b:b + step] for h, b in zip(holders, best)])).astype(np.int64)
        fresh = np.setdiff1d(fresh, documents, assume_unique=True)
        total = np.zeros(len(fresh), np.int64)
        for k, (term, _) in enumerate(query):
            place = lists.places(term, fresh)
            here = place >= 0
            total[here] += impacts[k][place[here]]
            seen[k][place[here]] = True
        documents, scores = np.concatenate([documents, fresh]), np.concatenate([scores, total])
        for k in range(len(query)):
            ahead = seen[k][best[k]:]
            best[k] += int(np.argmin(ahead))
        # a list that is used up adds nothing to documents not seen
        bound = sum(int(i[b - 1]) for i, b in zip(impacts, best) if 0 < b < len(i)) + sum(int(i[0]) for i, b in zip(impacts, best) if b == 0)
        last = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0)
        if bound < last or all(b == len(i) for i, b in zip(impacts, best)):
            kept = scores >= max(last, 1)
            return documents[kept], scores[kept]
        step *= 2


def _chunks(queries: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, str]]]:
    """Lists of (id, text) of bounded size, from one reading of the table; at most a partition waits on the driver."""
    held, size = [], 0
    for row in queries.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        if held and size + len(row["t"]) > CHUNK_CHARACTERS:
            yield held
            held, size = [], 0
        held.append((row["i"], row["t"]))
        size += len(row["t"])
    if held:
        yield held


def _document_frequencies(index: Index, wanted) -> dict[int, int]:
    """Documents that hold each word of the queries; one row per word reaches the driver."""
    def counted(batches):
        total: Counter[int] = Counter()
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                sizes = np.frombuffer(counts.as_py(), "<u4")
                for at, word in enumerate(words.as_py().split(b" ")):
                    term = wanted.value.get(word)
                    if term is not None:
                        total[term] += int(sizes[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    found = index.segments.select("words", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


def _found(index: Index, items: list[tuple[object, str]], scoring: Scoring, spark: SparkSession) -> DataFrame:
    """(query number, doc_id, score): the best documents of each task for each query of a chunk."""
    words = [Counter(terms_of(text)) for _, text in items]
    wanted = {w: n for n, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
    held = spark.sparkContext.broadcast(wanted)
    frequency = _document_frequencies(index, held)
    weight = {w: scoring.weight(index.documents, frequency[n]) for w, n in wanted.items() if n in frequency}
    plans = spark.sparkContext.broadcast([[(wanted[w], weight[w] * times) for w, times in found.items() if w in weight] for found in words])

    def searched(batches):
        best: list[list[tuple[int, bool, int]]] = [[] for _ in plans.value]  # (-score, id is null, id), in order
        for batch in batches:
            for docs, nulls, *lists in zip(*(batch.column(n).to_pylist() for n in range(6))):
                opened = Lists(*lists, held.value)
                ids, missing = np.frombuffer(docs, "<i8"), np.frombuffer(nulls, bool)
                for number, query in enumerate(plans.value):
                    known = best[number]
                    floor = -known[-1][0] if len(known) == scoring.top else 0
                    documents, scores = best_positions(opened, query, floor, scoring.top)
                    if len(documents):
                        met = zip((-scores).tolist(), missing[documents].tolist(), ids[documents].tolist())
                        best[number] = sorted(itertools.chain(known, met))[:scoring.top]
        rows = [(number, None if null else doc, -score) for number, known in enumerate(best) for score, null, doc in known]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "doc_id", "score"])

    return index.segments.mapInArrow(searched, "number long, doc_id long, score long")


def search(index: Index, queries: DataFrame, scoring: Scoring = Scoring(), id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The best ``scoring.top`` documents of every query: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count. Equal scores go by ascending doc_id, null ids last. Words
    repeated in a query count each time. A query without words, or a null one, finds
    nothing. Queries that share an id are queries of their own, each with its own ranks.
    Queries come in chunks of bounded size, each against all segments; a task sends at most
    ``top`` rows per query on.
    """
    spark = queries.sparkSession
    kind = queries.schema[id_column].dataType
    out = None
    for chunk in _chunks(queries, id_column, text_column):
        found = _found(index, chunk, scoring, spark)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= scoring.top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(chunk)], f"number long, item_id {kind.simpleString()}")
        named = ranked.join(names, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionByName(cut_lineage(named))
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
