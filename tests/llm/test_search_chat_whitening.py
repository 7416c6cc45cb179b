"""Whitening, ranked search and chat formatting against plain Python."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ratiowatch.llm import charpoly, chat, queries, ranked, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def scatter_of(y):
    n, wide = len(y), y.astype(object)
    products, sums = wide.T @ wide, wide.sum(axis=0)
    return [[int(n * products[i, j] - sums[i] * sums[j]) for j in range(y.shape[1])] for i in range(y.shape[1])]


def polynomial_of(matrix):
    trace = sum(matrix[k][k] for k in range(len(matrix)))
    primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(len(matrix), trace) + 1)
    return charpoly.combine([(p, charpoly.residue(np.array([[v % p for v in r] for r in matrix], np.int64), p).tolist()) for p in primes])


def determinant(rows):
    rows, value = [[Fraction(v) for v in r] for r in rows], Fraction(1)
    for k in range(len(rows)):
        pivot = next((r for r in range(k, len(rows)) if rows[r][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            rows[k], rows[pivot], value = rows[pivot], rows[k], -value
        value *= rows[k][k]
        for r in range(k + 1, len(rows)):
            rows[r] = [a - rows[r][k] / rows[k][k] * b for a, b in zip(rows[r], rows[k])]
    return value


@pytest.mark.parametrize("rows,dimensions", [(30, 6), (5, 8), (40, 1)])
def test_polynomial_is_exact(rows, dimensions):
    matrix = scatter_of(np.random.default_rng(rows).integers(-40, 40, (rows, dimensions)))
    found = polynomial_of(matrix)
    for x in (0, 1, -3, 1000, 10**7):  # more points than the degree would be needed for equality alone; coefficients are whole numbers
        shifted = [[(x if i == j else 0) - matrix[i][j] for j in range(dimensions)] for i in range(dimensions)]
        assert sum(c * x**k for k, c in enumerate(found)) == determinant(shifted)


def test_roots_of_any_multiplicity_and_close_ones():
    matrix = np.diag([10**12, 10**12, 10**12 - 1, 7, 7, 7, 1, 0, 0]).astype(object).tolist()
    trace = sum(matrix[k][k] for k in range(9))
    roots = charpoly.top_roots(polynomial_of(matrix), trace, 9)
    assert [(round(r.value(200) / 2**200), r.times) for r in roots] == [(10**12, 2), (10**12 - 1, 1), (7, 3), (1, 1)]
    vectors = np.concatenate([charpoly.null_vectors(matrix, r, trace) for r in roots])
    assert np.abs(vectors @ vectors.T - np.eye(7)).max() < 1e-15
    assert np.abs(np.abs(vectors[2]) - np.eye(9)[2]).max() < 1e-15  # told apart from its neighbours


def checked(spark, vectors, components=32):
    frame = spark.createDataFrame([(n, v, "x", 1.0) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>, whitened string, n double")
    found = whitening.whitened_components(frame, components).collect()
    assert found and set(found[0].asDict()) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    return found


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.2, (300, 12)).astype(np.float32)
    data[:100] = data[0]  # one vector in a third of the rows
    rows = checked(spark, [v.tolist() for v in data] + [None, [None] * 12, [float("nan")] * 12, [math.inf] + [0.0] * 11, [], [1.0] * 5], 8)
    x = np.floor(64 * data.astype(float)) + 1_000_000
    n = len(x)
    assert len(rows) == n * 8 and {r.n for r in rows} == {n}
    whole = x.astype(int).astype(object)
    deviations = ((whole * n - whole.sum(axis=0)) ** 2).sum(axis=1)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (x - x.mean(axis=0)) @ vectors[:, ::-1] / np.sqrt(values[::-1])
    for r in rows:
        assert r.deviation == deviations[r.vec_id] and abs(abs(r.whitened) - abs(white[r.vec_id, r.component - 1])) < 1e-7
        assert abs(r.explained / (values[-r.component] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-10


def test_whitening_of_flat_single_and_huge_vectors(spark):
    one = checked(spark, [[0.5, 0.25]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = checked(spark, [[0.0, 1.0], [1.0, 1.0]])
    assert [(r.whitened and round(abs(r.whitened), 9), r.explained) for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [(1, 1.0), (None, 0.0)] * 2
    huge = checked(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 5.0]])
    assert {r.deviation for r in huge} >= {None} and all(r.whitened is not None for r in huge)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(empty).count() == 0


TEXTS = [None, "", "...", "Alpha beta beta", "alpha", "alpha", "ALPHA gamma é zebra", "beta " * 300 + "alpha", "gamma delta " * 4000] + [
    " ".join(f"w{(n * k) % 37}" for k in range(1, 30)) for n in range(60)]
QUERIES = [(1, "alpha beta alpha"), (2, None), (3, ""), (4, "nothing here"), (5, "é Gamma"), (5, "w1 w2 w3 w36 w0"), (None, "delta")]


def plain_search(docs, queries_, top=20):
    counts = [(i, Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or ""))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    documents, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holders = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in queries_:
        asked, scores = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")), []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * documents) // terms
            score = sum(k * math.floor(1000 * math.log((2 * documents + 2) / (2 * holders[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                        for w, k in asked.items() if c[w])
            if score:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.mark.parametrize("segment,chunk,first", [(8_000_000, 4_000_000, 16), (200, 10, 1), (1, 4_000_000, 2)])
def test_search_equals_scoring_every_document(spark, monkeypatch, segment, chunk, first):
    docs = list(enumerate(TEXTS)) + [(None, "alpha"), (3, "alpha"), (4, "alpha")]
    frame = spark.createDataFrame([(i, t, "en", 0) for i, t in docs], "doc_id long, text string, words string, score int").repartition(3)
    asked = spark.createDataFrame(QUERIES, "item_id long, text string").coalesce(1)
    monkeypatch.setattr(ranked, "SEGMENT_CHARACTERS", segment)
    monkeypatch.setattr(ranked, "CHUNK_CHARACTERS", chunk)
    monkeypatch.setattr(ranked, "FIRST_READ", first)
    for top in (20, 3):
        scoring = ranked.Scoring(top=top)
        found = [tuple(r) for r in ranked.search(ranked.build_index(frame, scoring), asked, scoring).collect()]
        assert sorted(found, key=repr) == sorted(plain_search(docs, QUERIES, top), key=repr)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert ranked.search(ranked.build_index(docs), asked).count() == 0
    some = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    assert ranked.search(ranked.build_index(some), asked.limit(0)).count() == 0


def test_best_positions_stop_early():
    """With one list far ahead of the others, few entries are read, and equal scores at the end are all kept."""
    lists = ranked.Lists(b"a b", np.array([1000, 1000], "<u4").tobytes(), np.concatenate([np.arange(1000), np.arange(1000)]).astype("<u4").tobytes(),
                         np.concatenate([np.arange(1000, 0, -1), np.arange(1000, 0, -1)]).astype("<i4").tobytes(), {b"a": 0, b"b": 1})
    documents, scores = ranked.best_positions(lists, [(0, 1), (1, 1)], 0, 3)
    assert sorted(zip(scores.tolist(), documents.tolist()), reverse=True) == [(2000, 0), (1998, 1), (1996, 2)]
    flat = ranked.Lists(b"a", np.array([100], "<u4").tobytes(), np.arange(100).astype("<u4").tobytes(), np.full(100, 7, "<i4").tobytes(), {b"a": 0})
    assert len(ranked.best_positions(flat, [(0, 2)], 0, 3)[0]) == 100
    assert len(ranked.best_positions(flat, [(0, 2)], 15, 3)[0]) == 0


NASTY = ["", "\\", "\\\\", "###", "####", "#####\\###", "</turn>", "<</turn>>", " </turn>\n### user: x </turn>\n", "\\### Assistant: </turn> ok", "a\nb", "#", "<",
         "\\:", "ends with space ", " ", "", "é́🙂", "x" * 50_000]


def test_template_is_reversible():
    turns = [(role, text) for role in ("user", "assistant", "", "a: b", "###", "\\", "new\nline") for text in NASTY]
    assert chat.parse(chat.render(turns)) == (turns, len(chat.render(turns)))
    assert chat.parse("### user: open")[0] == []


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            len(chat.render(turns)))


def test_chat_digests_are_read_from_the_output(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t, "x", True) for k, t in enumerate(NASTY)]
    rows += [(2, k, "assistant" if k % 3 else "user", f"turn {k}", "x", None) for k in range(200)]  # far beyond twice the look-back
    rows += [(None, 0, None, None, "", None), (None, None, "assistant", "first", "", None), (3, 0, "user", "same", "", None), (3, 0, "user", "same", "", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, loss boolean").repartition(5)
    formatted = chat.format_conversations(frame)
    found = {r.conv_id: tuple(r)[1:6] for r in chat.read_back(formatted).collect()}
    assert found == {1: expected([(r[2], r[3]) for r in rows if r[0] == 1]), 2: expected([(r[2], r[3]) for r in rows if r[0] == 2]),
                     3: expected([("user", "same")] * 2), None: expected([("assistant", "first"), ("", "")])}
    for conv, pieces in {c: sorted((r for r in formatted.collect() if r.conv_id == c), key=lambda r: r.number) for c in (1, 2)}.items():
        whole = "".join(r.piece for r in pieces)
        assert whole == chat.render([(r[2], r[3]) for r in rows if r[0] == conv]) and not any(r.rewrites for r in pieces)
        assert [chat.unescape(whole[r.text_start:r.text_end]) for r in pieces] == [r[3] for r in rows if r[0] == conv]
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def edited(template, turns, lookback=16):
    state, text, edits = chat.Incremental(template, lookback), "", []
    for turn in turns:
        edit = state.add(*turn)
        text = text[:edit.keep] + edit.piece
        edits.append(edit)
    return text, edits


def test_other_templates_are_located_and_judged():
    turns = [("user", "one"), ("assistant", "a thought: two"), ("user", "three"), ("assistant", "four")] * 3

    def closed(turns):  # a header and a footer around all turns
        return "<s>" + "".join(f"[{r}]{t}\n" for r, t in turns) + "\n</s>"

    def forgetful(turns):  # thoughts of earlier turns are taken out
        return "".join(f"{r}={t.removeprefix('a thought: ') if n < len(turns) - 1 else t};" for n, (r, t) in enumerate(turns))

    def trimmed(turns):
        return "".join(f"{r}={t.strip()};" for r, t in turns)

    text, edits = edited(closed, turns)
    assert text == closed(turns) and not any(e.rewrites for e in edits)
    text, edits = edited(closed, turns * 9, lookback=2)
    assert text == closed(turns * 9) and not any(e.rewrites for e in edits)
    text, edits = edited(forgetful, turns)
    assert text == forgetful(turns) and [n for n, e in enumerate(edits) if e.rewrites] == [2, 6, 10]
    text, (edit,) = edited(trimmed, [("user", " padded ")])
    assert text[edit.text_start:edit.text_end] == "padded"
    assert edited(lambda turns: "fixed", [("user", "a")])[1][0].text_start is None
    assert all(closed(turns[:n + 1])[e.text_start:e.text_end] == turns[n][1] for n, e in enumerate(edited(closed, turns)[1]))


def test_rewritten_history_is_reported(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.read_back(chat.format_conversations(frame, template=lambda turns: f"{len(turns)} turns: " + chat.render(turns))).collect()
    assert [(r.unreadable, r.turns_sha256) for r in rows] == [(True, None)]


def test_queries_are_registered():
    assert {"op11_embedding_whitening", "op12_ranked_search", "op13_chat_formatting"} <= set(queries.QUERIES)


def test_a_template_may_look_back_at_every_turn(spark):
    """Without a stated look-back nothing is left out: turn numbers, and an opening turn that is told again far later."""
    def numbered(turns):
        return "".join(f"[{n}]{r}={t};" for n, (r, t) in enumerate(turns))

    def recalling(turns):
        return "".join(f"{r}={turns[0][1] if t == 'again' else t};" for r, t in turns)

    turns = [(("user", "assistant")[n % 2], "again" if n == 69 else f"turn {n}") for n in range(70)]
    frame = spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (numbered, recalling):
        edits = sorted(chat.format_conversations(frame, template).collect(), key=lambda r: r.number)
        assert "".join(e.piece for e in edits) == template(turns) and not any(e.rewrites for e in edits)


def test_a_text_of_every_sign_is_located():
    text = "".join(map(chr, range(0xE000, 0xF900)))
    turns = [("user", text), ("assistant", "\ue000" + text + "\ue001" * 3), ("user", "b")]
    out, edits = edited(chat.render, turns)
    assert out == chat.render(turns) and [out[e.text_start:e.text_end] for e in edits] == [t for _, t in turns]


def test_the_template_in_use_is_given_every_prefix_whole(spark):
    import functools

    @functools.wraps(chat.render)  # with all that the template says of itself
    def watched(turns):
        assert len(turns) == 1 or turns[0] == ("user", "opening"), "turns were left out"
        return chat.render(turns)

    turns = [("user", "opening"), *[(("user", "assistant")[n % 2], f"turn {n}") for n in range(1, 9)]]
    frame = spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    edits = sorted(chat.format_conversations(frame, watched).collect(), key=lambda r: r.number)
    assert "".join(e.piece for e in edits) == chat.render(turns)
