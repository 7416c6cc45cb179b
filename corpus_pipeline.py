"""A corpus in five stages: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage reads what the one before kept, and its decisions take effect: rows it rejects
are gone, texts it edits are edited. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratiowatch.llm import contamination, language, lines, near, packing
from ratiowatch.llm.encoding import vocabulary
from ratiowatch.session import cut_lineage

#: SQL has no tokenizer, so the whole pipeline has no SQL; tests compare it with plain Python.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a null or empty text is one of them. Missing labels remove nothing."""
    model = language.train(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_pipeline_row"), F.col("text").alias("_pipeline_text"))
    return language.identify(rows, model, "_pipeline_text").where("has_letter").select("_pipeline_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts, and n_chars follows; every document stays."""
    kept = lines.drop_repeated_lines(docs)
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}).select(*docs.columns)


def _node(seed: int) -> Column:
    """A hash of id and text that is never null: ids may be null or repeat."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_pipeline_node``, the same for equal rows and different for others.

    It is a hash of 64 bits, and a second one tells documents apart that share the first:
    those, some hundreds in 10^11, are numbered by a third.
    """
    hashed = docs.withColumns({"_pipeline_node": _node(1), "_pipeline_check": _node(2)})
    shared = hashed.groupBy("_pipeline_node").agg(F.min("_pipeline_check").alias("least"), F.max("_pipeline_check").alias("most"))
    shared = cut_lineage(shared.where("least <> most").select(F.col("_pipeline_node").alias("_pipeline_shared")))
    if shared.isEmpty():
        return hashed.drop("_pipeline_check")
    marked = hashed.join(shared, F.col("_pipeline_node") == F.col("_pipeline_shared"), "left")
    node = F.when(F.col("_pipeline_shared").isNull(), F.col("_pipeline_node")).otherwise(_node(3))
    return marked.withColumn("_pipeline_node", node).drop("_pipeline_check", "_pipeline_shared")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Of rows with equal id and text one stays. Rows with equal or null ids and other texts are
    documents of their own; null ids are the largest.
    """
    docs, node = _marked(docs), "_pipeline_node"
    keys = cut_lineage(docs.groupBy(node).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    found = near.near_duplicates(docs, size=5, percent=80, id_column=node).select(F.col("doc_id").alias(node), "component_id").distinct()
    found = cut_lineage(found.join(keys.select(node, "doc_id"), node))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", node)).alias("m")).select(F.col(f"m.{node}").alias(node))
    lost = cut_lineage(found.select(node).join(first, node, "left_anti"))
    repeated = keys.where("n > 1").select(node)
    once = docs.join(lost.unionByName(repeated), node, "left_anti")
    many = docs.join(repeated.join(lost, node, "left_anti"), node, "left_semi").dropDuplicates([node])
    return once.unionByName(many).drop(node)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if hit words of benchmark windows are at least one in 20; each row is judged by its own text."""
    docs, node = _marked(docs), "_pipeline_node"
    index = contamination.build_index(docs, id_column=node)
    found = contamination.judged(contamination.find_passages(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    lost = found.where("contaminated").select(F.col("doc_id").alias(node)).distinct()
    return docs.join(lost, node, "left_anti").drop(node)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), "bare", end_id=0, capacity=2048)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
