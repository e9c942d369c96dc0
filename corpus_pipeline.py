"""A corpus pipeline: quality filter, near-duplicate removal, redaction of personal data, packing for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import pii, quality
from quillgraph.llm.ngram_join import ngram_classes
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.text import vocabulary
from quillgraph.storage import materialize


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but the ``used`` ones under names of their own, so that none of them meets a column that a
    stage makes."""
    return docs.toDF(*(name if name in used else f"column_{k}_of_the_input" for k, name in enumerate(docs.columns)))


def restored(out: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` from what a stage made of the shielded ones, in their order."""
    return out.select(*(F.col(name if name in used else f"column_{k}_of_the_input").alias(name) for k, name in enumerate(docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: each row by its own text, null and empty ones and repeated rows
    too. Labels of documents that are not there, null labels, and none at all are allowed; columns of any name are kept as
    they are. Texts are read twice, to fit and to score, and never shuffled."""
    given, docs = docs, shielded(docs, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.with_statistics(docs.select("doc_id", "text")), labels, ~quality.held_out())
    scored = quality.score(quality.with_statistics(docs.withColumn("_text", F.col("text")), "_text"), model)
    return restored(scored.where("predicted = 1"), given, "doc_id", "text")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least doc_id (none comes last), then the least key. Rows are
    known by a key over doc_id and text, so rows that share a doc_id are judged by their own texts. Of rows that agree
    in both, the least by all columns stays; texts without words are in no group and all stay. Columns of any name are kept
    as they are."""
    given, docs = docs, shielded(docs, "doc_id", "text")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    classes = ngram_classes(keyed.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0")
    classes = classes.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    rows = keyed.groupBy("_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")).join(classes, "_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key", "rows")).alias("w"))
    first = materialize(first.select("w._key", "w.rows"), "kept")
    several = materialize(first.where("rows > 1"), "kept_of_several")
    # as many keys as documents: a shuffle at every size; those of repeated rows are a table of their own and mostly few
    chosen = keyed.join(first.where("rows = 1").hint("merge"), "_key", "left_semi").select(*docs.columns)
    repeated = keyed.join(several, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return restored(chosen.unionByName(repeated).unionByName(wordless), given, "doc_id", "text")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced; n_chars follows the text where it changes. Null texts stay null; columns
    of any other name are kept as they are."""
    given, docs = docs, shielded(docs, "text", "n_chars")
    verdicts = pii.learn(materialize(pii.candidates(docs.select("text")), "pii_candidates"))
    out = pii.redact(docs.withColumn("_before", F.col("text")), verdicts)
    changed = F.col("text") != F.col("_before")
    out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(out, given, "text", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their place. A null text is empty (its one token is the end id), a null
    doc_id is kept, and repeated rows are packed each."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("personal_data", redact), ("packing", pack)]
#: Learnt classifiers and a subword vocabulary are beyond SQL; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
