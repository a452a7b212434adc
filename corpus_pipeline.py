"""The corpus pipeline: language ID, near-duplicate removal, surrogates for
personal data, mixing to target weights and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, ngram_join, packing, pii
from tidemark.llm.common import fresh_path, small_or_not, written
from tidemark.llm.queries import tokenizer_path

#: Columns that pass from stage to stage.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts. It learns from the
    labelled rows among those not held out; without any, all documents are
    rejected. Null texts and texts without letters are rejected; repeated rows
    are judged alike; columns beyond those of documents go."""
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).filter("accepted").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the group's
    smallest doc_id, null being the largest, and of rows with this id that of
    the smallest text hash. A row is known by doc_id and text hash, so that an
    id in several groups stays in each. Documents without words are in no
    group."""
    labels = written(ngram_join.component_labels(docs.select("doc_id", "text")).filter("n > 0"), "pipeline-groups")
    # false comes before true, so ids come before nulls
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = labels.groupBy(F.col("label").alias("_label")).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(firsts.select("_label", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h")), "pipeline-firsts")
    marked = labels.join(small_or_not(firsts), F.col("label") == F.col("_label"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    gone = written(marked.filter(~is_first).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_gone_h")).distinct(), "pipeline-gone")
    hashed = docs.withColumn("_h", ngram_join.text_hash("text"))
    left = hashed.join(small_or_not(gone), F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_h") == F.col("_gone_h")), "left_anti")
    # equal rows count once
    twice = marked.filter(is_first).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = written(twice.select(F.col("doc_id").alias("_twice"), F.col("h").alias("_twice_h")), "pipeline-twice")
    if not twice.head(1):
        return left.select(*COLUMNS)
    both = left.join(small_or_not(twice), F.col("doc_id").eqNullSafe(F.col("_twice")) & (F.col("_h") == F.col("_twice_h")), "left")
    single = both.filter("_twice_h is null").select(*COLUMNS)
    first = both.filter("_twice_h is not null").groupBy("doc_id", "_h").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    return single.unionByName(first.select("doc_id", "d.text", "d.lang", "d.source", "d.n_chars"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced, and
    n_chars that of the new text. Null texts stay; repeated rows are replaced
    alike; columns beyond those of documents go."""
    return pii.replace(docs).withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are
    never taken, a null source is one source, and equal rows are drawn apart."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. A null or
    empty text is the end id alone; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", one_of_each),
    ("PII", replace_private),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL expresses the first stage, a classifier learned by compression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before has
    written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"pipeline-stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
