"""An extension beyond batch runs: headings and token estimates of files as they arrive in a folder of texts.

Each file is parsed on its own, so the stream keeps no state; numbering of equal slugs needs all
paths and stays with the batch run, so files are told apart by path here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import structure as S


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(file_path, text) of new files under folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.select(F.url_decode(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("text")).where(F.col("file_path").rlike(T.MARKDOWN))


def parsed_stream(corpus: DataFrame) -> DataFrame:
    """(file_path, title, language, token_estimate, n_headings, n_links) of each file."""
    rows = corpus.select("file_path", T.newlines(F.col("text")).alias("text")).withColumn("body", S.body_of(F.col("text")))
    heads = S.headings_of(F.col("body"))
    title = F.coalesce(F.get(F.filter(heads, lambda h: h["level"] == 1), F.lit(0))["text"], T.humanize(F.col("file_path")))
    links = F.size(S.links_of(F.col("body"), F.col("file_path")))
    return rows.select("file_path", title.alias("title"), T.detect_language(F.col("body")).alias("language"), T.token_estimate(F.col("text")).alias("token_estimate"), F.size(heads).alias("n_headings"), links.alias("n_links"))


def write_stream(parsed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet what is there now, then ends; a later call goes on where it stopped."""
    return parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
