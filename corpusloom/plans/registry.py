"""The registered queries, the same in DuckDB's SQL, and what all of them read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import structure
from ..sources.derived import derived_corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed(spark: SparkSession, sf_dir: str) -> structure.Structure:
    return structure.parse(derived_corpus(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> structure.Structure:
    """The structure, parsed once and written, for plans that read links and headings more than once; those that need headings alone parse nothing else, and are faster without."""
    return structure.parse(derived_corpus(spark, sf_dir), keep=True)
