"""A corpus from documents: toxicity, exact dedup, near dedup, mixing, encoding. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.llm import jaccard, mixing, naming, pieces, toxicity
from plinth.llm.keys import doubtful, without
from plinth.llm.queries import PIECE_MODEL, read
from plinth.llm.scratch import Scratch
from plinth.operators.relational import with_position


#: Bounds of a worker's memory in encoding; every text is encoded whole whatever they are.
ENCODING = {"memory": 60_000, "arcs": 120_000, "most": 512 << 10}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones of them, scores under the threshold. Those without words score 0 and stay; without labels of both kinds all stay."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the digest that tells rows of one id apart (as exact_duplicates gives it), and the whole row under one name, so that no column of it clashes."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select("doc_id", "text", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("_digest"), row.alias("_doc"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts (null counts as empty) the document with the largest id, and one without an id only if none has one.

    Where ids are null or repeat, rows are dropped by id and digest, so other
    texts of the id stay, and of rows equal in both one stays.
    """
    judged = Scratch(spark, "pipeline").keep(naming.exact_duplicates(docs).select("doc_id", "text_sha256", "kept"), "judged")
    if not doubtful(judged, "doc_id"):
        return without(docs, judged.where("not kept").select("doc_id"), "doc_id")
    texts = judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"))
    out = without(packed(docs), texts.where("not kept").select("doc_id", "text_sha256"), "doc_id", "_digest")
    return out.dropDuplicates(["doc_id", "_digest"]).select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 the one with the smallest id, and one without an id only if none has one.

    Identical texts are gone before. Documents without words link with nothing.
    Where ids are null or repeat, rows are numbered by id and digest and dropped
    by their number.
    """
    scratch = Scratch(spark, "pipeline")
    if not doubtful(docs, "doc_id"):
        groups = jaccard.join_groups(docs, shingle=5, num=80, den=100)
        return without(docs, scratch.keep(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped"), "doc_id")
    order = [F.col("doc_id").asc_nulls_last(), F.col("_digest").asc()]
    rows = scratch.keep(with_position(packed(docs), order, "_row"), "numbered")
    groups = jaccard.join_groups(rows, key="_row", shingle=5, num=80, den=100)
    dropped = scratch.keep(groups.where("_row <> component_id").select("_row"), "dropped")
    return without(rows, dropped, "_row").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it. A null source is a source; documents without words have size 0 and are taken as their place in the seeded order says."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts, checksum and ids of every row; a null text has null ids. Workers remember less than by default: the JVM beside them still holds the heap that the stages before took."""
    return pieces.encode(docs, PIECE_MODEL, **ENCODING)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Training, flows and piece encoding are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
