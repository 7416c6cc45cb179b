"""Near duplicates by b-bit MinHash, with links confirmed on full shingle sets.

Each document gets 128 minima. Bands of four full minima name the buckets in which
candidates meet. Of each minimum two low bits are kept, 256 bits a document; equal pairs of
bits, corrected for chance collisions, estimate the similarity of a candidate, and those
far below the threshold are let go before any set is read, unless a set is small. The others
are confirmed on whole sets.

Copies are folded into classes first. Buckets are then searched by stars, never by all
pairs: every member meets one pivot of its bucket, and only while the bucket still holds
different components. What stars leave open is settled in blocks: members outside the
largest component of a bucket against all of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratiowatch.llm.components import components
from ratiowatch.llm.encoding import batches_of
from ratiowatch.session import cut_lineage, drop_scratch

MINIMA, ROWS, BITS = 128, 4, 2
BANDS = MINIMA // ROWS
#: Standard deviations that an estimate may fall below the threshold.
SLACK = 4.5
#: Pairs with a smaller set go straight to the exact check: there the estimate saves little.
SMALL = 64
STAR_ROUNDS = 2
#: Rows on either side of a block of comparisons.
BLOCK = 256
#: A set of ids up to this size is sent to all tasks; a larger one meets the texts by a shuffle.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20_240_607)
_BYTES = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _random.integers(0, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, MINIMA, np.uint64)
_PLACES = _random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z folded, and the number of words of each text."""
    raw = [t.encode().lower() for t in texts]  # bytes fold A-Z alone
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    firsts = np.cumsum(lengths) - lengths
    depth = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    sums = np.add.reduceat(_BYTES[data[inside]] * powers[depth], firsts)
    offsets = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, offsets), prepend=0)
    return _mixed(sums + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word windows of each text; all words are one window if fewer."""
    hashes, counts = word_hashes(texts)
    if len(hashes) >= size:
        windows = sum((hashes[n:len(hashes) - size + 1 + n] * _PLACES[n] for n in range(size)), np.uint64(0))
        windows = _mixed(windows + np.uint64(size))
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(np.unique(windows[at:at + count - size + 1]))
        elif count:
            whole = (hashes[at:at + count] * _PLACES[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(_mixed(np.array([whole])))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def minima(items: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(items), 2048):
        block = items[None, at:at + 2048] * _FACTORS[:, None]
        block += _SHIFTS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Low bits of all minima, in 64-bit words. Mixed first, as the low bits of factors and shifts
    alone would let two items agree in all minima or in none."""
    low = (_mixed(least) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = (_mixed(least) .reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mixed(grouped + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SIGNATURES = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bits array<bigint>, bands array<bigint>"


def signatures(docs: DataFrame, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, 128 bits of hash of the whole set, packed bits and band keys."""
    import xxhash

    def signed(rows):
        for batch in rows:
            doc_ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
            for first, last in batches_of(texts, 1_000_000):
                out = []
                for doc_id, mark, items in zip(doc_ids[first:last], hashes[first:last], shingle_sets(texts[first:last], size)):
                    if not len(items):
                        out.append((doc_id, mark, 0, None, None, None, None))
                        continue
                    least, name = minima(items), xxhash.xxh3_128_digest(items.tobytes())
                    out.append((doc_id, mark, len(items), int.from_bytes(name[:8], "little", signed=True),
                                int.from_bytes(name[8:], "little", signed=True), packed_bits(least).tolist(), band_keys(least).tolist()))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bits", "bands"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
                       F.col(text_column).alias("text")).mapInArrow(signed, SIGNATURES)


def equal_minima(left: str, right: str) -> Column:
    """How many of the minima agree in their low bits."""
    differing = F.lit(0)
    for n in range(MINIMA * BITS // 64):
        x = F.get(left, F.lit(n)).bitwiseXOR(F.get(right, F.lit(n)))
        differing = differing + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(MINIMA) - differing


def least_agreement(percent: int) -> int:
    """Agreeing minima below which a pair cannot be at the threshold: J = (agreed / 128 - C) / (1 - C), C = 1 / 4."""
    chance = 0.5 ** BITS
    share = chance + (1 - chance) * percent / 100
    return int(MINIMA * share - SLACK * (MINIMA * share * (1 - share)) ** 0.5)


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(node, items): the full sets of the wanted nodes, made again from their texts."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("node"), F.col(text_column).alias("text"))
    small = wanted.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(wanted) if small else wanted, "node", "left_semi")

    def made(batches):
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in batches_of(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[first:last], pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts[first:last], size)], pa.binary())],
                    ["node", "items"])

    return rows.mapInArrow(made, "node long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def checked(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long")


def _settled(cells: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between components that still share a bucket; one for each member and component.

    In a bucket, members outside its largest component are compared with all members, in
    blocks of ``BLOCK`` by ``BLOCK`` rows that lie in tasks of their own. Blocks are compared in
    place, so pairs are never rows. A pair is compared only in its first common band, and
    only if bits and sizes allow the threshold.
    """
    parts = cells.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select(
        "band", F.col("top.label").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("xs"),
        F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("int").alias("ys"))
    rows = cells.join(buckets, "band")
    salt = F.xxhash64("node", F.lit(5))
    all_ = rows.select("band", "node", "label", F.pmod(salt, "xs").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"),
                       F.lit(False).alias("outside"))
    outside = rows.where("label <> top").select("band", "node", "label", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"),
                                                F.pmod(salt, "ys").cast("int").alias("y"), F.lit(True).alias("outside"))
    known = classes.select("node", "bits", "bands").join(sets, "node")
    full = all_.unionByName(outside).join(known, "node").select("band", "x", "y", "node", "label", "outside", "bits", "bands", "items")

    def compared(block: pa.Table) -> pa.Table:
        side = np.array(block["outside"].to_pylist(), bool)
        node, label = block["node"].to_numpy(), block["label"].to_numpy()
        bits = np.array(block["bits"].to_pylist(), np.int64).view(np.uint64)
        bands = np.array(block["bands"].to_pylist(), np.int64)
        items = [np.frombuffer(i, np.uint64) for i in block["items"].to_pylist()]
        band, others = block["band"][0].as_py(), np.flatnonzero(~side)
        sizes = np.array([len(i) for i in items])
        found = []
        if len(others):
            flat, firsts = np.concatenate([items[n] for n in others]), np.cumsum(sizes[others]) - sizes[others]
            for y in np.flatnonzero(side).tolist():
                common = bands[others] == bands[y]
                first = bands[y][common.argmax(axis=1)]
                differing = bits[others] ^ bits[y]
                differing = np.bitwise_count((differing | differing >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
                small, large = np.minimum(sizes[others], sizes[y]), np.maximum(sizes[others], sizes[y])
                fit = (first == band) & (label[others] != label[y]) & ((small < SMALL) | (MINIMA - differing.astype(np.int64) >= limit)) & (
                    100 * small >= percent * large)
                if not fit.any():
                    continue
                at = np.searchsorted(items[y], flat)
                at[at == sizes[y]] = 0
                shared = np.add.reduceat(items[y][at] == flat, firsts, dtype=np.int64)
                linked = np.flatnonzero(fit & (100 * shared >= percent * (sizes[others] + sizes[y] - shared)))
                _, once = np.unique(label[others[linked]], return_index=True)
                found += [(int(node[y]), int(node[others[n]])) for n in linked[once]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("band", "x", "y").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id and
    kept, which is true for the smallest id of a component.

    Sets are distinct windows of ``size`` words, A-Z folded; fewer words are one window.
    Documents are linked if 100 * intersection >= percent * union. Documents without words,
    null texts and null ids are linked with nothing, and a null id is kept with a null
    component. Rows that share an id are one node of the graph. Other columns are ignored.
    A pair at the threshold of 80 misses all 32 bands once in 20 million cases.
    """
    base = cut_lineage(signatures(docs, size, id_column, text_column))
    usable = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut_lineage(usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bits", "bands")).alias("m")).select(
        "k1", "k2", F.col("m.doc_id").alias("node"), "m.n_shingles", "m.bits", "m.bands"))
    spread = classes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") < F.col("high")).select("band")
    cells = cut_lineage(spread.join(shared, "band"))
    labels = None
    links = []
    held = cut_lineage(cells.select("node").distinct())
    bits = cut_lineage(classes.join(held, "node", "left_semi").select("node", "n_shingles", "bits"))
    sets = cut_lineage(_sets_of(docs, held, size, id_column, text_column))
    limit = least_agreement(percent)

    def plausible(pairs: DataFrame) -> DataFrame:
        a = bits.select(F.col("node").alias("a"), F.col("bits").alias("p"), F.col("n_shingles").alias("n"))
        b = bits.select(F.col("node").alias("b"), F.col("bits").alias("q"), F.col("n_shingles").alias("m"))
        both = pairs.join(a, "a").join(b, "b")
        plausible_bits = (F.least("n", "m") < SMALL) | (equal_minima("p", "q") >= limit)
        return both.where(plausible_bits & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("a", "b").distinct()

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def grown(found: DataFrame) -> DataFrame:
        links.append(cut_lineage(found))
        everything = links[0]
        for more in links[1:]:
            everything = everything.unionByName(more)
        return components(everything)

    for turn in range(STAR_ROUNDS):
        now = labelled(cells)
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
        pivots = now.groupBy("band").agg(F.min(order).alias("p"), F.min("label").alias("low"), F.max("label").alias("high")).where(
            F.col("low") < F.col("high")).select("band", "p.pivot", "p.pivot_label")
        pairs = now.join(pivots, "band").where(F.col("label") != F.col("pivot_label")).select(
            F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        labels = grown(_confirmed(plausible(pairs), sets, percent))
    rest = cut_lineage(_settled(labelled(cells), classes, sets, percent, limit))
    labels = grown(rest)
    drop_scratch(cells, held, bits, sets, rest, *links)
    named = classes.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"))
    result = base.join(named, ["k1", "k2"], "left").select("doc_id", "text_hash", "n_shingles", F.coalesce(F.when(
        F.col("doc_id").isNotNull(), F.col("label")), F.col("doc_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
