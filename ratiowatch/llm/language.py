"""Language of a text by cross-parsing: the language whose sample explains it in fewest phrases.

For each language a suffix automaton holds all substrings of a bounded sample of its texts.
A text is read left to right; a phrase is the longest match from where the last one ended.
A phrase costs the logarithm of its language's sample length, as its place in the sample
does, so a language with a short sample is judged alike; phrases times that cost, per symbol
of the text, are the cross-parsing entropy, and the least one wins.

Long texts are parsed in blocks of ``BLOCK`` letters, many at once as columns of numbers; a
phrase that a block's end cuts counts once, so long and short texts follow one rule.
Transitions of the commonest letters lie in a table, those of all others in a sorted list,
so every letter of the training texts is a symbol of its own.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ratiowatch.llm.encoding import batches_of

UNDETERMINED = "und"
#: Bounds of the training sample, parameters of ``train``: labelled rows of each language, characters of each row, symbols of
#: each language, and symbols of all languages together, shared evenly (at least ``LEAST_SYMBOLS`` each). A language's symbols
#: are shared by all its sampled rows. Scoring has no bound.
SAMPLE_DOCS, ROW_CHARACTERS, SAMPLE_SYMBOLS, ALL_SYMBOLS, LEAST_SYMBOLS = 80, 4_000, 25_000, 200_000, 200
#: What a symbol costs that a language's sample has nowhere: its number among all signs, dearer than any phrase.
LITERAL_BITS = 21.0
#: Letters with a column of the table; it changes speed and memory alone.
COLUMNS = 94
BLOCK = 256


@functools.lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions, per state, of the automaton of all substrings. State 0 is the start and is never reached."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                twin = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = twin
                    at = link[at]
                link[target] = link[state] = twin
        last = state
    return moves


def shared_quota(sizes: list[int], quota: int) -> list[int]:
    """How much of each row is taken: evenly, and what short rows leave goes to longer ones."""
    taken, left = [0] * len(sizes), quota
    for place, n in enumerate(sorted(range(len(sizes)), key=lambda k: sizes[k])):
        taken[n] = min(sizes[n], left // (len(sizes) - place))
        left -= taken[n]
    return taken


class Model:
    """One automaton per language in common tables; ``phrases`` parses many texts at once."""

    def __init__(self, samples: dict[str, list[str]], language_symbols: int = SAMPLE_SYMBOLS, all_symbols: int = ALL_SYMBOLS):
        self.languages = sorted(samples)
        common = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        ranked = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if len(c) == 1]
        # 0: no letter; columns of the table; rare letters; the last number: a letter that no sample has
        self.letters = sorted(ranked[:COLUMNS]) + sorted(ranked[COLUMNS:])
        self.columns, self.unknown = min(len(ranked), COLUMNS), len(ranked) + 1
        self.width = self.columns + 2  # the last column has no transitions
        quota = min(language_symbols, max(LEAST_SYMBOLS, all_symbols // max(1, len(self.languages))))
        tables, rare, self.roots, self.costs, offset = [np.zeros((1, self.width), np.int32)], [], [], [], 1
        for language in self.languages:
            rows = [self._symbols(t + "\n") for t in samples[language]]
            parts = [r[:n] for r, n in zip(rows, shared_quota([len(r) for r in rows], quota))]
            symbols = np.concatenate(parts) if parts else np.empty(0, np.int32)
            moves = suffix_automaton(symbols.tolist())
            table = np.zeros((len(moves), self.width), np.int32)
            for state, row in enumerate(moves):
                for symbol, target in row.items():
                    if symbol <= self.columns:
                        table[state, symbol] = target + offset
                    else:
                        rare.append(((state + offset) * (self.unknown + 1) + symbol, target + offset))
            tables.append(table)
            self.roots.append(offset * self.width)
            self.costs.append(float(np.log2(len(symbols) + 2)))
            offset += len(moves)
        self.table = (np.concatenate(tables) * np.int64(self.width)).ravel().astype(np.int32 if offset * self.width < 1 << 31 else np.int64)
        rare.sort()
        self.rare_keys = np.array([k for k, _ in rare], np.int64)
        self.rare_moves = np.array([t for _, t in rare], np.int64) * self.width

    @functools.cached_property
    def _number(self) -> np.ndarray:
        number = np.where(_alphabetic(), self.unknown, 0).astype(np.int32)
        number[[ord(c) for c in self.letters]] = np.arange(1, self.unknown)
        return number

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_number"}

    def _symbols(self, text: str) -> np.ndarray:
        """Numbers of the letters; a run of other characters is one 0."""
        numbers = self._number[_points(text)]
        keep = numbers > 0
        keep[1:] |= numbers[:-1] > 0
        return numbers[keep]

    def _moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after one symbol each, 0 where there is no transition."""
        after = self.table[state + np.minimum(symbol, self.columns + 1)]
        rare = np.flatnonzero((symbol > self.columns) & (symbol != self.unknown)) if len(self.rare_keys) else ()
        if len(rare):
            key = state[rare].astype(np.int64) // self.width * (self.unknown + 1) + symbol[rare]
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            after[rare] = np.where(self.rare_keys[at] == key, self.rare_moves[at], 0)
        return after

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and, of these, symbols that match nothing (each language x text), and whether each text has a letter."""
        parts = [self._symbols(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        lettered = np.array([bool(p.any()) for p in parts])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        fill = np.minimum(BLOCK, sizes[owner] - place * BLOCK)
        final = place == blocks[owner] - 1
        order = np.argsort(-fill, kind="stable")
        first = (np.repeat(np.cumsum(sizes) - sizes, blocks) + place * BLOCK)[order]
        owner, fill, final = owner[order], fill[order], final[order]
        flat = np.concatenate([*parts, np.zeros(BLOCK, np.int32)])
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        literals = np.zeros_like(counts)
        active = np.searchsorted(-fill, -np.arange(1, BLOCK + 1), side="right")
        for language, root in enumerate(self.roots):
            state = np.full(len(owner), root, self.table.dtype)
            found, missed = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for step in range(BLOCK):
                n = active[step]
                if not n:
                    break
                symbol, now = flat[first[:n] + step], state[:n]
                after = self._moved(now, symbol)
                ended = np.flatnonzero(after == 0)
                if len(ended):
                    again = self._moved(np.full(len(ended), root, self.table.dtype), symbol[ended])
                    found[ended] += (now[ended] != root).astype(np.int32) + (again == 0)
                    missed[ended] += again == 0
                    after[ended] = np.where(again == 0, root, again)
                state[:n] = after
            found += (state != root) & final  # a phrase cut by a block's end is counted where it goes on
            counts[language] = np.bincount(owner, found, len(texts)).astype(np.int64)
            literals[language] = np.bincount(owner, missed, len(texts)).astype(np.int64)
        return counts, literals, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the share of bits saved against the second best."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """``predict``, and whether each text has a letter."""
        if not texts:
            return [], [], []
        counts, literals, lettered = self.phrases(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), lettered.tolist()
        bits = (counts - literals) * np.array(self.costs)[:, None] + literals * LITERAL_BITS
        best = bits.argmin(axis=0)  # ties: the first name
        ranked = np.sort(bits, axis=0)
        second = ranked[1] if len(self.languages) > 1 else np.zeros(len(texts))
        score = np.where(second > 0, 1 - ranked[0] / np.where(second > 0, second, 1), 1.0)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0).tolist(), lettered.tolist()


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows_a_language: int = SAMPLE_DOCS,
          row_characters: int = ROW_CHARACTERS, language_symbols: int = SAMPLE_SYMBOLS, all_symbols: int = ALL_SYMBOLS) -> Model:
    """Fit on a bounded sample: rows of the smallest id hashes, about ``rows_a_language`` of each, a part of every one of them.

    Rows without a label or a text take no part. No row at all gives a model that knows no
    language and answers ``und``.
    """
    rows = labelled.select(F.xxhash64(F.lit(11), F.col(id_column)).alias("h"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    space = 1 << 40
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(space, rows_a_language * space // n))])
    chosen = rows.where(F.pmod("h", F.lit(space)) < F.element_at(limits, F.col("lang"))).select(
        "lang", "h", F.substring("text", 1, row_characters).alias("text")).collect()
    samples: dict[str, list[str]] = {lang: [] for lang in sizes}
    for row in sorted(chosen, key=lambda r: (r["h"], r["text"])):
        samples[row["lang"]].append(row["text"])
    return Model({lang: texts for lang, texts in samples.items() if texts}, language_symbols, all_symbols)


def identify(docs: DataFrame, model: Model, text_column: str = "text", characters: int = 1_000_000) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` and ``has_letter`` (replacing columns of those names).

    Null texts and texts without a letter are ``und`` with score 0. A model that knows no
    language says ``und`` of every text, so only ``has_letter`` tells which have none. Nothing but the text is
    looked at, so repeated rows and equal texts get equal answers.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, has_letter boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        known, values = held.value, [t or "" for t in texts]
        names, scores, letters = [], [], []
        for first, last in batches_of(values, characters):
            a, b, c = known.judged(values[first:last])
            names += a
            scores += b
            letters += c
        return pd.DataFrame({"lang_pred": names, "score": np.array(scores, float), "has_letter": np.array(letters, bool)})

    answer = docs.withColumn("_language", predicted(F.col(text_column)))
    return answer.withColumns({n: F.col(f"_language.{n}") for n in ("lang_pred", "score", "has_letter")}).drop("_language")
