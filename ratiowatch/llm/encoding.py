"""Fast exact encoding of many texts: every distinct word meets the tokenizer once per worker.

Both public vocabularies used here split a text at white space before any merge, so the
ids of a text are the ids of its words in a row. Texts whose white space makes that split
doubtful are given to the tokenizer whole.
"""

from __future__ import annotations

import codecs
import functools
import gc
import itertools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that one encoder remembers before it lets go of some; bounds memory, never results.
REMEMBERED_WORDS = 400_000
COMMON_WORDS = 8_000
#: Words that an encoder keeps between tasks: its worker goes on to other work, beside which they take memory.
RESTING_WORDS = 50_000


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``encode(texts)`` gives all ids in a row and the number of ids of each text. Texts are a list or an Arrow array, without nulls.

    ``style`` is "spaced" for byte-level vocabularies in which a word owns the single space
    before it, and "bare" for those that drop white space.
    """

    def __init__(self, path: str, style: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.style, self.remembered = style, remembered
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # runs are remembered here; a full cache is still searched and locked for each
        self.of_run: dict[str, bytes] = {}
        self.byte_letters = self._byte_letters()
        self._forget()

    def _byte_letters(self) -> str:
        """How the vocabulary writes each byte of the letters that plain words are made of."""
        from tokenizers.pre_tokenizers import ByteLevel

        write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = ["\ufffe"] * 256  # no letter
        for c in _PLAIN_CHARACTERS:
            for byte, letter in zip(c.encode(), write(c)[0][0], strict=True):
                letters[byte] = letter
        return "".join(letters)

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.common: dict[str, int] = {}
        self.batches = 0
        if len(self.of_run) > self.remembered:
            self.of_run.clear()
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.used = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.again = np.zeros(1 << 14, bool)  # words met since they were learned

    def _thin_out(self) -> None:
        """Keep the words that were met again; when those are many, none."""
        kept = np.flatnonzero(self.again[:len(self.index)])
        self._keep(kept if len(kept) <= self.remembered // 2 else kept[:0])

    def rest(self, most: int = RESTING_WORDS) -> None:
        """At the end of a task keep at most so many words, the earliest of those met again, and return unused memory."""
        if len(self.index) > most:
            self._keep(np.flatnonzero(self.again[:len(self.index)])[:most])
        if len(self.of_run) > most:
            self.of_run.clear()
        give_back()

    def _keep(self, kept: np.ndarray) -> None:
        """Forget all words but those of these numbers."""
        if not len(kept):
            return self._forget()
        words, lengths = list(self.index), self.lengths[kept]
        ends = np.cumsum(lengths)
        total = int(lengths.sum())
        pool = self.pool[np.repeat(self.starts[kept] - ends + lengths, lengths) + np.arange(total)]
        self._forget()
        self.pool, self.used = _grown(pool, total), total
        self.lengths, self.starts, self.again = lengths, ends - lengths, np.zeros(len(kept), bool)
        self.index = {words[n]: at for at, n in enumerate(kept.tolist())}

    def _places(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones; a small table of common words is asked first."""
        if not self.common:
            return np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        at = np.fromiter(map(self.common.get, words, itertools.repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero(at < 0)
        at[rest] = np.fromiter(map(self.index.get, [words[n] for n in rest.tolist()], itertools.repeat(-1)), np.int64, len(rest))
        return at

    def _note_common(self, at: np.ndarray) -> None:
        """After the 1st, 2nd, 4th ... batch since the last start, take the most frequent words of the batch as common."""
        self.batches += 1
        if self.batches & (self.batches - 1) == 0:
            seen = np.bincount(at)
            top = np.argsort(-seen, kind="stable")[:COMMON_WORDS]
            wanted = set(top[seen[top] > 2].tolist())
            self.common = {word: n for word, n in self.index.items() if n in wanted}

    def _run(self, run: str) -> bytes:
        """Ids of letters, or of marks, that the vocabulary never splits before its merges, as 32-bit integers."""
        ids = self.of_run.get(run)
        if ids is None:
            data = (run.lower() if self.style == "bare" else run).encode()
            tokens = self.model.tokenize(codecs.charmap_decode(data, "strict", self.byte_letters)[0])
            ids = self.of_run[run] = _packed([t.id for t in tokens])
        return ids

    def _ids(self, word: str) -> bytes:
        plain = _PLAIN_WORD.fullmatch(word)
        if plain is None:
            parts = self._words(word) if self.style == "bare" else [word]
            if parts != [word]:  # white space beyond ASCII
                return b"".join(map(self._ids, parts))
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        return self._run(letters) + self._run(marks) if marks else self._run(letters)

    def _learn(self, words: list[str]) -> None:
        ids = [self._ids(word) for word in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        base, first, total = len(self.index), self.used, int(lengths.sum())
        self.pool = _grown(self.pool, first + total)
        self.starts, self.lengths = _grown(self.starts, base + len(ids)), _grown(self.lengths, base + len(ids))
        self.again = _grown(self.again, base + len(ids))
        self.again[base:base + len(ids)] = False
        self.pool[first:first + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.lengths[base:base + len(ids)] = lengths
        self.starts[base:base + len(ids)] = first + np.cumsum(lengths) - lengths
        self.used += total
        self.index.update(zip(words, range(base, base + len(ids))))

    def _words(self, text: str) -> list[str]:
        """Parts whose ids, in a row, are those of the text."""
        if self.style == "bare":
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
                return [text]
            return text.split()
        if _ODD_SPACE.search(text) or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[-1] in " \n" or text[0] in " \n":
            return [text]
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if "\x00" not in text else [text]

    def _split(self, texts: list[str] | pa.Array) -> tuple[list[str], np.ndarray | None, np.ndarray]:
        """Words, the place of each word of the texts among them (None: as they stand), and how many each text has.

        Bare words are split and told apart by Arrow, so only distinct ones become Python's.
        """
        if self.style == "bare":
            found = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
            coded = found.flatten().dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(), pc.list_value_length(found).to_numpy().astype(np.int64)
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts.to_pylist() if isinstance(texts, pa.Array) else texts):
            if text:
                found = self._words(text)
                counts[n] = len(found)
                words += found
        return words, None, counts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, places, counts = self._split(texts)
        at = self._places(words)
        unknown = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(unknown):
            fresh = list({words[n] for n in unknown.tolist()})
            gc.disable()  # millions of small objects without cycles
            if self.index and len(self.index) + len(fresh) > self.remembered:
                self._thin_out()
                self._learn(list(set(words).difference(self.index)))
                at = self._places(words)
            else:
                self._learn(fresh)
                at[unknown] = np.fromiter(map(self.index.__getitem__, [words[n] for n in unknown.tolist()]), np.int64, len(unknown))
            gc.enable()
        if places is None:
            self._note_common(at)
        else:  # each word is asked for once
            at = at[places]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)]
        edges = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0], ends))
        return ids, sums[edges[1:]] - sums[edges[:-1]]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, style: str, remembered: int = REMEMBERED_WORDS) -> WordEncoder:
    """The encoder of this worker, kept between tasks."""
    return WordEncoder(path, style, remembered)


def give_back() -> None:
    """What Arrow keeps of freed buffers goes back to the system; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()


def batches_of(texts: list[str], characters: int = 2_000_000):
    """Slices of at most so many characters, or of one longer text: (first, after last)."""
    return slices_of(list(map(len, texts)), characters)


def slices_of(sizes: list[int], most: int):
    """Slices of at most so much, or of one larger: (first, after last)."""
    first = total = 0
    for n, size in enumerate(sizes):
        if n > first and total + size > most:
            yield first, n
            first = n
            total = 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def crc32_of(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    bigger = np.empty(max(size, 2 * len(values)), values.dtype)
    bigger[:len(values)] = values
    return bigger


_ODD_SPACE = re.compile(r"[^\S \n]")
#: Letters and marks of plain words: basic and western Latin, and marks that take no part in contractions.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%$#&*|()"
_PLAIN_WORD = re.compile(rf"( ?[{_LETTERS}]+)([{re.escape(_MARKS)}]*)")
_PLAIN_CHARACTERS = [c for c in map(chr, range(32, 256)) if re.match(rf"[ {_LETTERS}{re.escape(_MARKS)}]", c)]
