"""Every corpus operator against plain Python, on rows with nulls, empties, ties and clashing columns."""

import base64
import collections
import gzip
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratiowatch.llm import (archive, components, contamination, counts, dac, language, lines, near, packing, quality, secrets,
                            token_ids)
from ratiowatch.llm.encoding import WordEncoder, batches_of, vocabulary, word_encoder
from ratiowatch.session import scratch_path

LONG = " ".join(f"wörd{n % 997}" for n in range(30_000))
TEXTS = [None, "", " ", "one", "One two  three\n\nfour\tfive", "same line here\nsame line here\nother", "Same Line Here \nother",
         "a  b\n c\r\n", "x" * 5000, LONG, LONG, "don't 12 <|endoftext|> é́\x1c!", "password = abcdefghijklmn AKIA" + "Z" * 16]
SCHEMA = "doc_id long, text string, lang string, h1 long, n_words string, pos string, node string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "en", 1, "x", "y", "z") for n, t in enumerate(TEXTS)]
    rows += [(None, "same line here", None, 0, "", "", ""), (4, TEXTS[4], "en", 2, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def encoded(name, text):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary(name))
    tool.encode_special_tokens = True
    return tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")])
def test_word_encoder_equals_the_tokenizer(name, style):
    texts = [t or "" for t in TEXTS]
    ids, lengths = word_encoder(vocabulary(name), style).encode(texts)
    assert ids.tolist() == [i for t in texts for i in encoded(name, t)]
    assert lengths.tolist() == [len(encoded(name, t)) for t in texts]
    assert [t for a, b in batches_of(texts, 100) for t in texts[a:b]] == texts


@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")])
def test_encoder_on_odd_spaces_letters_and_little_memory(name, style):
    from tokenizers import Tokenizer

    texts = ["a\xa0b", "\xa0", "x\u3000\u2028y z\x85w", "p\x1cq r\x1f", "\x0b\x0ca\r", "ÀÉ ÿß, Straße. İI ΣΑΣ J\u030c \u0301a ẞ", "WORD Word word, word", "日本語 テキスト",
             "nul\x00l a\x00 b", "it's 1st $%&| (x)", *(f"w{n % 40}x É{chr(97 + n % 26) * (n % 30)}, again" for n in range(200))] * 2
    encoder = WordEncoder(vocabulary(name), style, remembered=50)
    tool = Tokenizer.from_file(vocabulary(name))
    wanted = [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    for given in ([texts[n:n + 7] for n in range(0, len(texts), 7)], [pa.array(["skipped", *texts]).slice(n + 1, 30) for n in range(0, len(texts), 30)]):
        found = [encoder.encode(part) for part in given]
        assert [i for ids, _ in found for i in ids.tolist()] == [i for ids in wanted for i in ids]
        assert [n for _, lengths in found for n in lengths.tolist()] == list(map(len, wanted))


@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")])
def test_a_resting_encoder_keeps_few_words_and_encodes_alike(name, style):
    texts = [" ".join(f"{chr(97 + n % 26) * (n % 7)}w{n % 900}x" for n in range(at, at + 400)) for at in range(0, 8000, 800)]
    encoder, wanted = WordEncoder(vocabulary(name), style), [encoded(name, t) for t in texts]
    for _ in range(3):
        ids, lengths = encoder.encode(texts)
        assert [i.tolist() for i in np.split(ids, np.cumsum(lengths)[:-1])] == wanted
        assert len(encoder.index) > 300
        encoder.encode(texts)  # all words are met again
        encoder.rest(300)
        assert 0 < len(encoder.index) <= 300 and len(encoder.of_run) <= 300
    encoder.again[:] = False
    encoder.rest(0)
    assert not encoder.index and encoder.encode(texts)[0].tolist() == ids.tolist()


def test_workers_of_ended_packing_tasks_keep_few_words(spark):
    """Else a pipeline's later stages run beside the words of an earlier one, in the same workers."""
    path = vocabulary("word_bpe_49k.json")
    words = spark.range(0, 160_000, 1, 1).selectExpr("id div 1000 doc_id", "concat(conv(id, 10, 36), 'q') word")
    docs = words.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("text")).coalesce(1)
    pieces = packing.pieces_of(docs, path, "bare", 0, 2048)
    assert pieces.select("doc_id").distinct().count() == 160

    def held(batches):
        time.sleep(0.1)  # so that every waiting worker gets a task
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(word_encoder(path, "bare").index)], pa.int64())], ["n"])

    assert max(r["n"] for r in spark.range(0, 24, 1, 24).mapInArrow(held, "n long").collect()) <= 50_000


def test_bare_words_are_looked_up_once_a_slice(monkeypatch):
    asked = []
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), "bare")
    monkeypatch.setattr(encoder, "_places", lambda words, places=encoder._places: asked.append(len(words)) or places(words))
    ids, lengths = encoder.encode(["one two, three " * 1000] * 3)
    assert lengths.tolist() == [4000] * 3 and len(ids) == 12_000 and sum(asked) <= 4  # three words, and the empty end


def test_codes_give_any_id():
    rng = np.random.default_rng(1)
    for ids in (np.empty(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 70_000, 3000).astype(np.uint32)):
        opened = dac.Segment(dac.pack(ids))
        assert opened.ids().tolist() == ids.tolist()
        assert [opened.id_at(n) for n in range(len(ids))] == ids.tolist()
        assert opened.ids(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3:len(ids) // 2].tolist()


def test_token_files(spark, docs, none):
    folder = scratch_path(spark)
    token_ids.write_ids(docs, folder, vocabulary("byte_bpe_50k.json"), "spaced", 2)
    rows = sorted(token_ids.digest(spark, folder).collect(), key=lambda r: r.start)
    texts = ["same line here", *TEXTS[:5], TEXTS[4], *TEXTS[5:]]
    start = 0
    for row, text in zip(rows, texts, strict=True):
        ids = encoded("byte_bpe_50k.json", text) + [2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    everything = [i for t in texts for i in encoded("byte_bpe_50k.json", t) + [2]]
    asked = spark.createDataFrame([(0,), (start - 1,), (start,), (start // 2,)], "position long")
    assert {r.position: r.id for r in token_ids.ids_at(spark, folder, asked).collect()} == {p: everything[p] for p in (0, start - 1, start // 2)}
    wanted = spark.createDataFrame([(3,)], "doc_id long")
    assert token_ids.read_ids(spark, folder, wanted).first().ids == encoded("byte_bpe_50k.json", "one") + [2]
    empty = scratch_path(spark)
    token_ids.write_ids(none, empty, vocabulary("byte_bpe_50k.json"), "spaced", 2)
    assert token_ids.digest(spark, empty).count() == 0


def test_single_ids_of_many_segments(spark, monkeypatch):
    batches = token_ids.batches_of
    monkeypatch.setattr(token_ids, "batches_of", lambda texts: batches(texts, 40))
    folder = scratch_path(spark)
    texts = [f"text {n} " + "word " * (n % 7) for n in range(60)]
    token_ids.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, vocabulary("byte_bpe_50k.json"), "spaced", 2)
    assert spark.read.parquet(folder).count() > 10
    everything = [i for t in texts for i in encoded("byte_bpe_50k.json", t) + [2]]
    asked = spark.createDataFrame([(n,) for n in [*range(len(everything) + 3), 0, 5, 5, -1, None]], "position long")
    found = token_ids.ids_at(spark, folder, asked).collect()
    assert len(found) == len(everything) and {r.position: r.id for r in found} == dict(enumerate(everything))


def test_a_repeated_id_is_dealt_to_many_tasks(spark):
    folder = scratch_path(spark)
    texts = [f"text {n} of one id" for n in range(400)]
    rows = [(None if n % 3 else 7, t) for n, t in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        token_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), folder, vocabulary("byte_bpe_50k.json"), "spaced", 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(folder).select("shard").distinct().count() > 3
    found = sorted(token_ids.digest(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: i or 0)
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:n]) for n in range(len(found))]
    sums = sorted(zlib.crc32(np.array(encoded("byte_bpe_50k.json", t) + [2], "<u4").tobytes()) for t in texts)
    assert sorted(r.ids_crc32 for r in found) == sums


def test_lines(docs, none):
    rows = lines.drop_repeated_lines(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and set(rows[0].asDict()) == {*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_dropped", "kept_text"}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].kept_text == "same line here"  # a null is the smallest document
    assert (by_id[5].kept_text, by_id[5].n_dropped, by_id[5].n_lines) == ("other", 2, 3)
    assert by_id[6].kept_text == "other" and by_id[0].kept_text == "" and by_id[0].n_lines == 1
    assert by_id[9].n_dropped == 0 and by_id[10].kept_text == "" and by_id[4].n_dropped == 0
    assert lines.drop_repeated_lines(none).count() == 0


def test_quality(docs, none):
    text = "one two three four " * 30
    plain = quality.read(text)
    assert (plain.n_words, plain.n_repeat_words, plain.base_failed) == (120, 120, True)
    assert quality.repeated_words(b"a b c d a b c".split()) == 6 and quality.repeated_words(b"a a a a".split()) == 4
    assert quality.read("x\nx\n \n \nx").n_dup_lines == 2 and quality.read("#$ ab").n_symbols == 2
    assert quality.read("a b c").n_words == 2
    good = " ".join(f"word{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]}" for n in range(90))
    cases = {"good": good, "loud": good.upper(), "marks": good.replace(" ", "%%% "), "list": good.replace(" ", " | ")}
    frame = docs.sparkSession.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(frame).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}
    assert {r.doc_id: r.n_words for r in quality.judge(docs).collect()}[9] == 30_000
    assert quality.judge(none).count() == 0
    assert {r["seen"] for r in quality.measured(frame).collect()} == {4}


def test_secrets(docs, none):
    key = "password = abcdefghijklmn"
    packed = base64.b64encode(gzip.compress(("hello " + key).encode(), mtime=0)).decode()
    layers = {
        "plain": (key, "assign:0:25"),
        "url": ("see " + key.replace("=", "%3D").replace("word", "wo%72d"), "assign:4:33"),
        "unicode": (key.replace("p", "\\u0070", 1), "assign:0:30"),
        "base64": ("v: " + base64.b64encode(key.encode()).decode(), None),
        "twice": (base64.b64encode(("x%20" + key.replace("=", "%3D")).encode()).decode(), None),
        "compressed": ("blob " + packed, f"assign:5:{5 + len(packed)}")}
    for name, (text, spans) in layers.items():
        found = secrets.written(secrets.all_spans(text))
        assert "assign" in found, name
        assert spans is None or spans in found.split(","), (name, found)
    assert secrets.scan("token = token:abcdefghijklmn") == []  # a failing match is used up
    assert secrets.written(secrets.scan("ſecret=abcdefghijklmn")) == ""
    assert secrets.scan("0123456789abcdef g AKIA" + "B" * 14)[0] == (0, 2, 16)
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert (rows[12].n_assign, rows[12].n_access, rows[0].spans) == (1, 1, "")
    assert secrets.find_secrets(none).count() == 0


def test_secrets_in_layers_that_are_no_plain_utf8():
    key = "password = abcdefghijklmn"
    for data in (key.encode("utf-16"), key.encode("utf-16-be"), key.encode("utf-32-le"), b"\xe9\xff " + key.encode(), f"a\xa0{key}\x0c\x00\ufeff".encode(),
                 gzip.compress(gzip.compress(key.encode())), gzip.compress(key.encode("utf-16-le"))):
        assert "assign" in secrets.written(secrets.all_spans("v: " + base64.b64encode(data).decode())), data
    for data in (b"\xe9" + key.encode(), b"\x00" + key.encode(), f"\xa0{key}".encode()):
        text = "v " + "".join(f"%{c:02X}" for c in data)
        first = 2 + 3 * (len(data) - len(key))
        assert secrets.written(secrets.all_spans(text)) == f"assign:{first}:{len(text)}"
    text = base64.b64encode(b"\xe9\xe9\xe9" + key.encode()).decode()
    assert secrets.written(secrets.all_spans(text)) == f"assign:4:{len(text.rstrip('='))}"


def test_secrets_in_wrapped_and_glued_base64():
    import bz2
    import lzma

    key = "password = abcdefghijklmn"
    rng = np.random.default_rng(3)
    noise = bytes(rng.integers(32, 127, 300).tolist())
    for data in (b"x" * 40 + key.encode() + b" end", *(pack(noise + b" ") + pack(key.encode()) + pack(noise) for pack in (gzip.compress, bz2.compress, lzma.compress)),
                 gzip.compress(noise + key.encode()), gzip.compress(noise + key[:12].encode()) + gzip.compress(key[12:].encode())):
        code = base64.b64encode(data).decode()
        for width, end in ((64, "\n"), (76, "\r\n"), (64, "\n    "), (76, "\n> "), (64, "\\n"), (len(code), "")):
            text = "k: " + end.join(code[n:n + width] for n in range(0, len(code), width))
            assert "assign" in secrets.written(secrets.all_spans(text)), (data, width, end)
    text = "k\n" + base64.b64encode(b"x" * 40 + key.encode()).decode()[:64] + "\n" + base64.b64encode(b"x" * 40 + key.encode()).decode()[64:]
    assert (2 + 53, 0, len(text.rstrip("="))) in secrets.all_spans(text)
    for glue in ("/callback/", "id_", "a", "ab-", "abc+", "abcd"):
        for data in (key.encode(), gzip.compress(key.encode()), zlib.compress(key.encode()), bz2.compress(key.encode())):
            text = glue + base64.b64encode(data).decode().rstrip("=")
            assert "assign" in secrets.written(secrets.all_spans(text)), (glue, data)


def plain_sets(texts, size):
    out = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out.append({tuple(words[n:n + size]) for n in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    return out


@pytest.mark.parametrize("turns,block", [(near.STAR_ROUNDS, near.BLOCK), (0, 8)])  # stars first, or blocks of few rows alone
def test_near_duplicates_equal_all_pairs(spark, docs, none, monkeypatch, turns, block):
    monkeypatch.setattr(near, "STAR_ROUNDS", turns)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 80)]
        for _ in range(12):
            copy = list(words)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                copy[at] = f"w{rng.integers(0, 10_000)}"
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "A B", "a b c d", texts[0]]
    frame = spark.createDataFrame([(n, t, "e") for n, t in enumerate(texts)], "doc_id long, text string, bits string")
    sets, label = plain_sets(texts, 3), list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[n]] == label[n] for n in range(len(label))):
            break
    rows = {r.doc_id: r for r in near.near_duplicates(frame, 3, 85).collect()}
    assert {n: (r.n_shingles, r.component_id, r.kept) for n, r in rows.items()} == {
        n: (len(sets[n]), label[n], label[n] == n) for n in range(len(texts))}
    assert near.near_duplicates(none).count() == 0
    again = near.near_duplicates(docs).collect()
    assert len(again) == len(TEXTS) + 2 and [r.kept for r in again if r.doc_id is None] == [True]


def test_chance_collisions_of_bits_differ_between_minima():
    one, other = (np.array([near.packed_bits(np.uint64(x) * near._FACTORS + near._SHIFTS)]).view(np.uint64) for x in (1, 5))  # equal mod 4
    differing = one ^ other
    agreed = near.MINIMA - int(np.bitwise_count((differing | differing >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
    assert 10 < agreed < 60  # 32 are expected; residues mod 4 alone give all 128


def test_small_sets_skip_the_estimate(spark, monkeypatch):
    monkeypatch.setattr(near, "least_agreement", lambda percent: near.MINIMA + 1)
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i")]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.kept for r in found} == {1: True, 2: False}


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, 101), (7, 7)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{n: 0 for n in range(41)}, 100: 100, 101: 100}


def test_contamination(spark, docs, none):
    passage = [f"p{n}" for n in range(30)]
    body = [f"q{n}" for n in range(200)]
    texts = {0: " ".join(body[:50] + passage[:20] + body[50:]), 1: " ".join(body + passage[:12]), 2: "Short, ITEM! here " + " ".join(body[:30]), 3: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(passage)), (10, "short item"), (2, " ".join(passage[:15])), (3, None), (4, "...")], "item_id long, text string")
    index = contamination.build_index(frame)
    rows = {r.doc_id: r for r in contamination.judged(contamination.find_passages(index, items)).collect()}
    assert (rows[0].n_hit, rows[0].items, rows[0].contaminated) == (20, ["1", "2"], True)
    assert rows[1].n_hit == 0 and rows[3].n_words == 0 and not rows[3].contaminated
    assert (rows[2].n_hit, rows[2].items) == (2, ["10"])
    loose = spark.createDataFrame([(0, "alpha beta x gamma delta")], "doc_id long, text string")
    near_by = contamination.find_passages(contamination.build_index(loose), spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"), slop=1)
    assert near_by.first().items == ["1"]
    assert contamination.find_passages(contamination.build_index(none), items).count() == 0
    assert contamination.find_passages(contamination.build_index(docs), items.limit(0)).count() == len(TEXTS) + 2


def test_contamination_in_many_chunks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(contamination, "CHUNK_CHARACTERS", 400)
    monkeypatch.setattr(contamination, "SEGMENT_CHARACTERS", 900)
    rng = np.random.default_rng(11)
    items = {f"i{n}": [f"w{x}" for x in rng.integers(0, 30, rng.integers(1, 20))] for n in range(30)}
    texts = {n: [f"w{x}" for x in rng.integers(0, 30, 60)] for n in range(40)}
    for n in range(0, 40, 3):  # parts of items, some too short for a window
        found = items[f"i{n % 30}"]
        texts[n][10:10] = found[:rng.integers(1, len(found) + 1)]
    index = contamination.build_index(spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "doc_id long, text string"))
    assert index.count() > 4
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id string, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contamination.find_passages(index, bench, 5).collect()}
    assert len(rows) == len(texts)
    for n, words in texts.items():
        hit, names = set(), set()
        for item, other in items.items():
            size = min(5, len(other))
            windows = {tuple(other[at:at + size]) for at in range(len(other) - size + 1)}
            for at in range(len(words) - size + 1):
                if tuple(words[at:at + size]) in windows:
                    hit.update(range(at, at + size))
                    names.add(item)
        assert rows[n] == (len(words), len(hit), sorted(names))


def test_packing(docs, none):
    rng = np.random.default_rng(5)
    sizes = collections.Counter(np.minimum(rng.lognormal(5.5, 1, 20_000).astype(int) + 1, 2048).tolist())
    groups = packing.plan(dict(sizes), 2048)
    used = collections.Counter()
    for pattern, count in groups:
        assert sum(pattern) <= 2048
        for length in pattern:
            used[length] += count
    total = sum(k * v for k, v in sizes.items())
    assert used == sizes and sum(c for _, c in groups) <= -(-total // 2048) * 1.005 + 1
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), "bare", 0, 2048, with_ids=True).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    whole = [i for r in sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.piece) for i in r.ids]
    assert whole == encoded("word_bpe_49k.json", LONG) + [0]
    assert packing.pack_documents(none, vocabulary("word_bpe_49k.json"), "bare", 0).count() == 0


def test_archive(spark, tmp_path):
    pages = [(3, "u\r\nx", "<p>a\r\n\r\nb</p>", 1), (1, None, "<p>a\r\n\r\nb</p>", 1), (2, "v", None, 1), (4, "w", "", 1), (5, "é", "é", 1), (None, "n", "é", 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    folder = scratch_path(spark)
    archive.write_archive(frame, folder)
    rows = {r.page_id: r for r in archive.read_archive(spark, folder).collect()}
    for page_id, _, html, _ in pages:
        data = (html or "").encode()
        assert bytes(rows[page_id].payload) == data
        assert rows[page_id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items() if k} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None)}
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    for r in archive.warc_records(archive.read_archive(spark, folder)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert len(rest) - 4 == int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    archive.export_warc(archive.read_archive(spark, folder), str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == len(pages)
    archive.write_archive(frame.limit(0), empty := scratch_path(spark))
    assert archive.read_archive(spark, empty).count() == 0


def test_counts_equal_the_unigram_tokenizer(docs, none):
    from tokenizers import Tokenizer, models

    path = vocabulary("piece_bpe_32k.model")
    tool = Tokenizer(models.Unigram(counts.pieces_of(path), 0, True))
    rows = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, path).collect()}
    for n, text in enumerate(TEXTS):
        assert rows[n] == (len(tool.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), n
    ties = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0), ("bc", -2.0)]
    small, exact = counts.Counter(ties), Tokenizer(models.Unigram(ties, 0, True))
    assert all(small.best(t) == len(exact.encode(t).tokens) for t in ("abc", "ab", "bcabc", "cab"))
    assert counts.count_tokens(none, path).count() == 0


def test_language(spark, docs, none):
    words = {"aa": "kala mato sivu ranta", "bb": "grusch pfelt stork wend"}
    rng = np.random.default_rng(2)
    rows = [(n, " ".join(rng.choice(words[lang].split(), 12)), lang) for n in range(200) for lang in words]
    frame = spark.createDataFrame(rows + [(900, "Kala MATO", None), (901, None, "aa"), (902, "12 !!", "bb")], "doc_id long, text string, lang string")
    model = language.train(frame)
    found = {(r.doc_id, r.lang): r for r in language.identify(frame, model).collect()}
    assert all(r.lang_pred == lang for (n, lang), r in found.items() if n < 200)
    assert found[900, None].lang_pred == "aa" and found[901, "aa"].lang_pred == "und" and found[902, "bb"].score == 0
    text = model._symbols("kalamatograntax").tolist()
    for number, name in enumerate(model.languages):
        sample = model._symbols("\n".join([t for _, t, lang in rows if lang == name]))
        phrases = at = 0
        table = model.table.reshape(-1, model.width) // model.width
        while at < len(text):
            state, begun = model.roots[number] // model.width, at
            while at < len(text) and table[state][text[at]]:
                state = table[state][text[at]]
                at += 1
            at = max(at, begun + 1)
            phrases += 1
        assert model.phrases(["kalamatograntax"])[0][number, 0] == phrases and len(sample)
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_pipeline(spark, tmp_path):
    words = [f"w{n}" for n in range(400)]
    texts = ["!!! 12", " ".join(words[:60]), " ".join(words[:60]) + " end", "shared line of text\n" + " ".join(words[100:160]),
             "shared line of text\n" + " ".join(words[200:260]), " ".join(words[300:320]), None]
    frame = spark.createDataFrame([(n, t, "en" if n % 2 else None, "s", len(t or "")) for n, t in enumerate(texts)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words[300:320]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == frame.columns
    assert set(kept["language_id"]) == {1, 2, 3, 4, 5}
    assert kept["line_dedup"][4] == " ".join(words[200:260]) and kept["line_dedup"][3] == texts[3]
    assert set(kept["near_dedup"]) == {1, 3, 4, 5} and set(kept["decontaminate"]) == {1, 3, 4}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 3, 4} and sum(r.length for r in rows) <= 2048


def test_pipeline_keeps_texts_without_any_label(spark):
    rows = [(1, "some words", None, 5), (2, "12 !!", None, 6), (None, "más", None, 7), (4, None, None, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    kept = corpus_pipeline.language_id(spark, frame, "")
    assert kept.columns == frame.columns and sorted(r.score for r in kept.collect()) == [5, 7]


def test_pipeline_judges_rows_with_null_and_repeated_ids(spark, tmp_path):
    words = [f"w{n}" for n in range(900)]
    a, b, c, d, e, f = (" ".join(words[n:n + 60]) for n in range(0, 360, 60))
    rows = [(1, a, "x"), (5, a + " end", "lost"), (5, b, "x"), (None, c, "x"), (None, c + " end", "lost"), (None, d, "x"), (7, e, "x"), (7, e, "x"),
            (8, None, "x"), (8, None, "x"), (None, f, "x"), (None, f, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    # which of two near copies with null ids stays is open
    found = sorted((r.doc_id or 0, (r.text or "").removesuffix(" end")) for r in kept.collect())
    assert kept.columns == frame.columns and found == sorted([(1, a), (5, b), (0, c), (0, d), (7, e), (8, ""), (0, f)])
    spark.createDataFrame([(1, a), (2, c)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.createDataFrame([(1, a), (1, b), (None, c), (None, d), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.decontaminate(spark, frame, str(tmp_path))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, b), (None, d), (None, None)}


def plain_parse(text, samples):
    """Phrases and unmatched symbols by plain substring search."""
    matched = missed = 0
    at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in samples:
            size += 1
        matched, missed, at = matched + (size > 0), missed + (size == 0), at + max(size, 1)
    return matched, missed


def symbols_of(text):
    return re.sub(r"[^\W\d_]|(?:[\W\d_])+", lambda m: m[0] if m[0].isalpha() else "·", text.lower()).lstrip("·")


def test_cross_parsing_equals_plain_substring_search():
    samples = {"a": "the cat sat on the mat. a cat, a hat", "b": "le chat est sur la table; der Hund", "c": "日本語の文章と漢字"}
    model = language.Model({k: [v] for k, v in samples.items()})
    texts = ["the hat on the table", "der chat", "漢字と日本", "zzz", "9 9", "the cat sat on the mat " * 9, "la " * 70]
    counts, literals, lettered = model.phrases(texts)
    for n, name in enumerate(sorted(samples)):
        for t, text in enumerate(texts):
            assert (counts[n, t] - literals[n, t], literals[n, t]) == plain_parse(symbols_of(text), symbols_of(samples[name] + "\n")), (name, text)
    assert lettered.tolist() == [True, True, True, True, False, True, True]


def test_blocks_cut_no_phrase_twice(monkeypatch):
    model = language.Model({"a": ["abcdefghij" * 30]})
    text = "abcdefghij" * 28
    whole = [x.tolist() for x in model.phrases([text])[:2]]
    monkeypatch.setattr(language, "BLOCK", 40)
    assert whole == [[[1]], [[0]]] and model.phrases([text])[0].tolist() == [[1]] and model.phrases([text + "!ab"])[0][0][0] <= 3


def test_every_letter_of_the_samples_is_a_symbol():
    import random

    draw = random.Random(2)
    signs = {"latin": [chr(97 + n) for n in range(26)], "han": [chr(0x4E00 + n) for n in range(600)], "hangul": [chr(0xAC00 + n) for n in range(600)]}
    samples = {name: ["".join(draw.choices(s, k=1200))] for name, s in signs.items()}
    model = language.Model(samples)
    for name, s in signs.items():
        found, _ = model.predict(["".join(draw.choices(s, k=60)) for _ in range(50)])
        assert collections.Counter(found)[name] == 50


def test_short_samples_are_judged_alike_and_shared_by_rows():
    import random

    draw = random.Random(3)
    syllables = {"x": ["ba", "to", "ri", "mel", "sa"], "y": ["ku", "to", "ven", "ri", "osh"]}

    def text(name, n):
        return " ".join("".join(draw.choices(syllables[name], k=3)) for _ in range(n))

    model = language.Model({"x": [text("x", 600)] * 5, "y": [text("y", 30)]})
    found, _ = model.predict([text("y", 25) for _ in range(40)] + [text("x", 25) for _ in range(40)])
    assert found == ["y"] * 40 + ["x"] * 40
    assert language.shared_quota([5, 100, 30], 60) == [5, 28, 27] and language.shared_quota([1, 2], 60) == [1, 2]
    many = language.Model({f"l{n}": ["abc def"] for n in range(3000)}, all_symbols=1000)
    assert len(many.languages) == 3000 and min(many.costs) > 2


def test_variety_is_judged_alike_at_all_lengths():
    words = [f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(50)]
    import random

    draw = random.Random(1)
    text = " ".join(draw.choices(words, k=9000)).split(" ")
    found = {n: quality._poor_vocabulary(quality.read(" ".join(text[:n]))) for n in (1400, 1999, 2000, 2001, 2500, 9000)}
    assert found == {1400: False, 1999: True, 2000: True, 2001: True, 2500: True, 9000: True}
    assert not quality._few_letters(quality.read("a b c " * 60))


def plain_base(text):
    """Base spans of the contract, by its patterns alone."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text or "") if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_and_counts_of_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in secrets.find_secrets(table).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_spans == base and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    for r in quality.judge(table).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[n:n + 3]) for n in range(len(words) - 2)]
        seen = collections.Counter(windows)
        repeated = {p for n, w in enumerate(windows) if seen[w] > 1 for p in range(n, n + 3)}
        lines_ = text.split("\n")
        copies = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines_[:n] for n, line in enumerate(lines_))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_a_small_text_that_unpacks_to_much_is_scanned_in_little_memory():
    import bz2
    import os
    import subprocess
    import sys

    tool, parts = bz2.BZ2Compressor(), []
    for n in range(6):
        parts.append(tool.compress(bytes([33 + n]) * (1 << 24)))
    parts += [tool.compress(b"password = abcdefghijklmn"), tool.flush()]
    text = "v " + base64.b64encode(bz2.compress(b"".join(parts))).decode()
    assert len(text) < 1000
    code = ("import resource, sys; from ratiowatch.llm import secrets; found = secrets.written(secrets.all_spans(sys.argv[1])); "
            "print(found, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, text], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}).stdout.split()
    assert out[0] == f"assign:2:{len(text.rstrip('='))}" and int(out[1]) < 250
