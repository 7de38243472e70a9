"""The corpus pipeline: documents through toxicity, near duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to
the shared folder and reads again as the next one's docs, so that a lost executor costs a stage
at most. All but the last return the columns of documents.

Rows are told apart by id and text together, so that rows of null and repeated ids are judged by
their own texts. Rows equal in both are one document, of which the near-duplicate stage keeps one;
only rows with neither id nor words, which nothing tells apart, all stay. Columns of any name
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.decontaminate import contaminated
from corpusloom.llm.jaccard import jaccard_components
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.sharding import assign_shards
from corpusloom.llm.toxicity import accepted_documents, fit_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject."""
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return accepted_documents(docs, chain)


def _row_key() -> Column:
    """128 bits of id and text, as text; nulls are told from empty ones."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "\0").otherwise("\1"), F.coalesce("text", F.lit(""))))


def _number() -> Column:
    """64 bits of the same, as the Jaccard join numbers its documents."""
    return F.xxhash64("doc_id", "text")


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id (of null ids the last); repeated rows are one document.

    Where two documents share a number, both stay if it is a group's first: no document is lost by that, at
    most a copy is kept.
    """
    named_or_worded = F.col("doc_id").isNotNull() | F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(named_or_worded)
    found = jaccard_components(named.select(_number().alias("doc_id"), "text")).documents.select(F.col("doc_id").alias("k"), "component_id").distinct()
    ids = named.select(_number().alias("k"), "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k"))
    stay = found.join(ids, "k").groupBy("component_id").agg(first.alias("s"))
    number, row = _unused(docs, "__number"), _unused(docs, "__row")
    kept = named.withColumn(number, _number()).join(stay.select(F.col("s.k").alias(number)), number, "left_semi")
    kept = kept.withColumn(row, _row_key()).dropDuplicates([row])
    return kept.select(*docs.columns).unionByName(docs.where(~named_or_worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    row = _unused(docs, "__row")
    found = contaminated(docs.select(_row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, _row_key()).join(found, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixed_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of the mix."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: SQL has no form of trained classifiers and label propagation; tests hold run() against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
