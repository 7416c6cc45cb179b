"""Quality rules in a short-circuit cascade.

Counts every document needs are taken once. Documents that pass the base limits then meet
the rules of the cascade, which stops at the first rejection. Each rule's time and share of
rejections are measured on a sample, and rules run in the order of rejections per second.
The order changes the time alone: a document is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Documents on which time and selectivity of the rules are measured.
SAMPLE_ROWS = 500
#: Words of a stretch in which distinct words are counted.
STRETCH = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


@dataclass
class Document:
    """A text, its words and the counts that all rules may use."""

    text: str
    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total = reach = 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            total += at + 3 - max(at, reach)
            reach = at + 3
    return total


def read(text: str | None) -> Document:
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six white-space characters
    seen, copies = set(), 0
    for line in text.split("\n"):
        if line in seen:
            copies += bool(line.strip(SPACE))
        seen.add(line)
    return Document(text, words, len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
                    copies, repeated_words(words))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


_LETTER_WORD = re.compile(r"[^\W\d_]")


def _shouted(d: Document) -> bool:
    """More than half of the cased characters of a text are capitals."""
    capitals = sum(map(str.isupper, d.text))
    return 2 * capitals > capitals + sum(map(str.islower, d.text))


def _few_letters(d: Document) -> bool:
    """Fewer than 60 of 100 words hold a letter."""
    return 100 * sum(1 for w in d.words if _LETTER_WORD.search(w.decode())) < 60 * d.n_words


def _poor_vocabulary(d: Document) -> bool:
    """Each distinct word of a stretch is used 30 times on average. Stretches of 2,000 words, the last one up to the end of
    the text, make texts of any length alike."""
    begins = [*range(0, d.n_words - STRETCH, STRETCH), max(0, d.n_words - STRETCH)]
    return 30 * sum(len(set(d.words[at:at + STRETCH])) for at in begins) < len(begins) * min(STRETCH, d.n_words)


RULES = (
    Rule("few_letters", _few_letters),
    Rule("shouted", _shouted),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("short_words", lambda d: 2 * d.word_chars < 3 * d.n_words),
    Rule("long_words", lambda d: d.word_chars > 20 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > d.text.count("\n") + 1),
    Rule("poor_vocabulary", _poor_vocabulary),
)


def rejected(document: Document, rules: tuple[Rule, ...]) -> bool:
    return any(rule.rejects(document) for rule in rules)  # any() stops at the first


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per rule on the sample: rule, seen, rejections, seconds."""
    def timed(rows):
        totals = {r.name: [0, 0, 0.0] for r in rules}
        for batch in rows:
            for text in batch.column(0).to_pylist():
                document = read(text)
                if document.base_failed:
                    continue
                for rule in rules:
                    began = time.perf_counter()
                    hit = rule.rejects(document)
                    total = totals[rule.name]
                    total[0] += 1
                    total[1] += hit
                    total[2] += time.perf_counter() - began
        yield pa.RecordBatch.from_pylist([{"rule": k, "seen": a, "rejections": b, "seconds": c} for k, (a, b, c) in totals.items()])

    part = docs.select(F.col(text_column).alias("text")).orderBy(F.xxhash64(F.lit(5), "text")).limit(sample_rows)  # from all of the table
    return part.mapInArrow(timed, "rule string, seen long, rejections long, seconds double").groupBy("rule").agg(
        F.sum("seen").alias("seen"), F.sum("rejections").alias("rejections"), F.sum("seconds").alias("seconds"))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; one row per rule reaches the driver."""
    rate = {r["rule"]: (r["rejections"] + 0.01) / (r["seconds"] + 1e-9) for r in measured(docs, rules, text_column, sample_rows).collect()}
    return tuple(sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept.

    Null and empty texts have no words and fail the base limits. Each row is judged alone,
    so repeated rows and ids get equal rows; other columns are ignored.
    """
    cascade = ordered(docs, rules, text_column, sample_rows)

    def judged(rows):
        for batch in rows:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = read(text)
                out.append((doc_id, *(getattr(d, c) for c in COUNTS), d.base_failed, not d.base_failed and not rejected(d, cascade)))
            kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds],
                                             ["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        judged, SCHEMA)
