"""Token counts under a unigram vocabulary, without making the tokens.

Aho-Corasick lists every vocabulary piece that ends at each character; a table of best
scores carries the score and the number of pieces of the best path to that character. Ties
are settled as the exact tokenizer does: paths are tried by rising start, and a later one
must be strictly better. A character that is no piece costs the least score less ten and
counts one token for each of its bytes.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"  # stands for a space, and starts every text
UNKNOWN_COST = 10.0
#: Words that one worker remembers before it starts anew; bounds memory, never results.
REMEMBERED_WORDS = 300_000


def pieces_of(path: str) -> list[tuple[str, float]]:
    """All pieces of a public vocabulary file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(n), model.get_score(n)) for n in range(model.get_piece_size())]


class Counter:
    """Counts of texts; words are counted once and remembered while pieces do not span them."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        inner = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.by_word = not inner and not any("\n" in piece for piece, _ in pieces)
        self.known: dict[str, int] = {}

    def best(self, part: str) -> int:
        """Pieces on the best path through ``part``."""
        scores, counts = [0.0], [0]
        matches = self.automaton.iter(part)
        end, found = next(matches, (-1, None))
        for at, character in enumerate(part):
            best = count = None
            single = False
            while end == at:  # longest first: starts rise
                length, score = found
                single |= length == 1
                total = scores[at + 1 - length] + score
                if best is None or total > best:
                    best, count = total, counts[at + 1 - length] + 1
                end, found = next(matches, (-1, None))
            if not single:
                total = scores[at] + self.unknown
                if best is None or total > best:
                    best, count = total, counts[at] + len(character.encode())
            scores.append(best)
            counts.append(count)
        return counts[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or "  " in text or text[0] == " " or MARK in text:
            return self.best(MARK + text.replace(" ", MARK))
        words = f"{MARK}{text}".replace(" ", "\x00" + MARK).replace("\n", "\x00\n\x00").split("\x00") if "\x00" not in text else [MARK + text.replace(" ", MARK)]
        got = list(map(self.known.get, words, itertools.repeat(-1)))
        if -1 in got:
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            for n, value in enumerate(got):
                if value == -1:
                    word = words[n]
                    value = self.known.get(word)
                    got[n] = value if value is not None else self.known.setdefault(word, self.best(word) if word else 0)
        return sum(got)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of this worker, kept between tasks."""
    return Counter(pieces_of(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens. Null and empty texts have 0.

    Each row is counted alone, whole; repeated rows get equal rows, other columns are ignored.
    """
    def counted(rows):
        tool = counter(vocabulary)
        for batch in rows:
            counts = np.array([tool.count(t or "") for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        counted, "doc_id long, n_tokens long")
