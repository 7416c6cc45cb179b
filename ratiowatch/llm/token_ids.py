"""Token ids of a corpus in files of directly addressable codes (see ``dac``).

Documents are dealt by ranges of doc_id and a hash of the text, sorted and encoded; each task appends segments of
some two million characters, or of one longer document, to its shard. A shard is a Parquet
file without compression whose rows are segments: the codes, and the doc_ids and lengths
of the documents in them. Spark commits whole files, so a task that is repeated after a
lost executor leaves each segment once. A text crosses the network once; ids never do.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratiowatch.llm import dac
from ratiowatch.llm.encoding import batches_of, crc32_of, word_encoder

SHARDS = "shard long, segment long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, codes binary"
DIGEST = "shard long, segment long, doc_id long, place long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, style: str, end_id: int, id_column: str = "doc_id",
              text_column: str = "text", remembered: int = 1_000_000) -> None:
    """Encode every whole text, append ``end_id`` and write the shards in ascending id order.

    Null and empty texts have the end id alone. A null id comes first. Rows that share an id
    are documents of their own, ordered by a hash of their text. Other columns are ignored. An empty table
    gives a folder without segments. ``remembered`` bounds the distinct words a worker keeps:
    nothing else in this job needs memory, so more than the common bound.
    """
    import numpy as np

    def encoded(rows):
        shard, segment = TaskContext.get().partitionId(), 0
        encoder = word_encoder(vocabulary, style, remembered)
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in batches_of(texts):
                ids, lengths = encoder.encode(texts[first:last])
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([segment]), pa.array([doc_ids[first:last]], pa.list_(pa.int64())),
                     pa.array([(lengths + 1).tolist()], pa.list_(pa.int64())), pa.array([len(ids)]),
                     pa.array([dac.pack(ids)], pa.binary())],
                    ["shard", "segment", "doc_ids", "lengths", "n_ids", "codes"])
                segment += 1

    place = ["doc_id", "text_hash"]  # a repeated id is dealt to many tasks
    ordered = (docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
               .withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).repartitionByRange(*place).sortWithinPartitions(*place, "text"))
    ordered.select("doc_id", "text").mapInArrow(encoded, SHARDS).write.option("compression", "uncompressed").parquet(folder)


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Per segment, the number of ids before it. Only the counts are read.

    Segments are summed inside their shards; just one row a shard meets in one place.
    """
    counts = spark.read.parquet(folder).select("shard", "segment", "n_ids")
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (counts.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "shard")
            .select("shard", "segment", (F.col("base") + F.col("inner")).alias("segment_start")))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: per document its doc_id, start, n_tokens and ids_crc32."""
    def summed(rows):
        for batch in rows:
            shards, segments, doc_ids, lengths, codes = (batch.column(n).to_pylist() for n in range(5))
            for shard, segment, docs, sizes, data in zip(shards, segments, doc_ids, lengths, codes):
                opened, place, out = dac.Segment(data), 0, []
                ids = opened.ids()
                for doc, size in zip(docs, sizes):
                    out.append((shard, segment, doc, place, size, crc32_of(ids[place:place + size])))
                    place += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["shard", "segment", "doc_id", "place", "n_tokens", "ids_crc32"])

    found = spark.read.parquet(folder).select("shard", "segment", "doc_ids", "lengths", "codes").mapInArrow(summed, DIGEST)
    return found.join(segment_starts(spark, folder), ["shard", "segment"]).select(
        "doc_id", (F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of those whose doc_id is in ``wanted``."""
    def opened(rows):
        for batch in rows:
            for docs, sizes, data in zip(*(batch.column(n).to_pylist() for n in range(3))):
                segment, place, ids = dac.Segment(data), 0, []
                for size in sizes:
                    ids.append(pa.array(segment.ids(place, place + size), pa.int64()))
                    place += size
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([x.to_pylist() for x in ids], pa.list_(pa.int64()))],
                                                 ["doc_id", "ids"])

    shards = spark.read.parquet(folder).select("doc_ids", "lengths", "codes")
    found = shards.mapInArrow(opened, "doc_id long, ids array<bigint>")
    return found if wanted is None else found.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def ids_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """(position, id): single ids at places of the whole corpus, each read by direct access.

    ``positions`` has one column of that name. A null or a place outside the corpus gives no
    row; repeated places give one. Places meet their segment through a common cell of the
    position axis, without its codes, and are gathered per segment, which holds at most as
    many distinct places as ids; then each segment's codes cross the network once at most.
    """
    cell = 1 << 22
    counts = spark.read.parquet(folder).select("shard", "segment", "n_ids")
    starts = counts.join(segment_starts(spark, folder), ["shard", "segment"]).withColumn("end", F.col("segment_start") + F.col("n_ids")).where("n_ids > 0")
    held = starts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("segment_start") / cell), F.floor((F.col("end") - 1) / cell))))
    asked = positions.select(F.col("position").cast("bigint").alias("position")).distinct().withColumn("cell", F.floor(F.col("position") / cell))
    inside = asked.join(held, "cell").where((F.col("position") >= F.col("segment_start")) & (F.col("position") < F.col("end")))
    gathered = inside.groupBy("shard", "segment", "segment_start").agg(F.collect_list("position").alias("positions"))
    opened = gathered.join(spark.read.parquet(folder).select("shard", "segment", "codes"), ["shard", "segment"])

    def fetched(rows):
        for batch in rows:
            for start, places, data in zip(*(batch.column(n).to_pylist() for n in range(3))):
                codes = dac.Segment(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int64()), pa.array([codes.id_at(p - start) for p in places], pa.int64())], ["position", "id"])

    return opened.select("segment_start", "positions", "codes").mapInArrow(fetched, "position long, id long")
