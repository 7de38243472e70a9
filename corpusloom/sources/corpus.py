"""Corpora on disk: Markdown files found and read by tasks, level by level; and a Python data source for folders that one process can list."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cut import cut
from .sinks import local

#: Folders left out by name, unless the reader is told others.
EXCLUDES = (".git", ".claude", ".corpusloom", "node_modules", "dist", "build", ".venv", "venv", "__pycache__")
EXTENSIONS = (".md", ".markdown")


def list_files(root: str, excludes: tuple[str, ...] = EXCLUDES) -> list[str]:
    """Paths of the corpus's files from its root, sorted; folders in excludes are not entered, links not followed."""
    if not os.path.isdir(root) or not os.access(root, os.R_OK):
        raise ValueError(f"{root} is not a readable folder")
    out = []
    for folder, inside, names in os.walk(root):
        inside[:] = [d for d in inside if d not in excludes]
        out += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if n.lower().endswith(EXTENSIONS)]
    return sorted(out)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CorpusReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.excludes = tuple(options["excludes"].split(",")) if options.get("excludes") else EXCLUDES
        self.per_part = int(options.get("filesPerPartition", "500"))

    def partitions(self):
        paths = list_files(self.root, self.excludes)
        return [Part(paths[i : i + self.per_part]) for i in range(0, len(paths), self.per_part)] or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        for path in part.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            try:
                yield path, raw.decode("utf-8"), True
            except UnicodeDecodeError:
                yield path, None, False


class CorpusSource(DataSource):
    """spark.read.format("mdcorpus").load(root): (file_path, text, valid); text is null where a file isn't UTF-8. The folder has to be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "mdcorpus"

    def schema(self) -> str:
        return "file_path string, text string, valid boolean"

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


def discover(spark: SparkSession, root: str, excludes: tuple[str, ...] = EXCLUDES, tasks: int | None = None) -> DataFrame:
    """(file_path) of the corpus's files below root, listed by tasks: one level of folders a round, whose subfolders are the next round's. Folders in excludes are not entered, links not followed, unreadable folders passed over."""
    top = local(root).rstrip("/") or "/"
    if not os.path.isdir(top) or not os.access(top, os.R_OK | os.X_OK):
        raise ValueError(f"{root} is not a readable folder")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(folder: str) -> Iterator[tuple[str, bool]]:
        try:
            with os.scandir(os.path.join(top, folder)) as inside:
                for e in inside:
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        is_folder = e.is_dir()
                    except OSError:
                        is_folder = False
                    if is_folder:
                        if e.name not in excludes and not e.is_symlink():
                            yield path, True
                    elif e.name.lower().endswith(EXTENSIONS):
                        yield path, False
        except OSError:
            return

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                rows = list(entries(folder))
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=["path", "folder"])

    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = cut(frontier.repartition(tasks, "path").mapInPandas(listed, "path string, folder boolean"))
        levels.append(level.where("not folder").select(F.col("path").alias("file_path")))
        frontier = level.where("folder").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(file_path, text, valid) of paths(file_path) below root, read by tasks; text is null where a file isn't UTF-8, files that cannot be read are left out."""
    top = local(root).rstrip("/") or "/"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["file_path"]:
                try:
                    with open(os.path.join(top, path), "rb") as f:
                        raw = f.read()
                except OSError:
                    continue
                try:
                    row = (path, raw.decode("utf-8"), True)
                except UnicodeDecodeError:
                    row = (path, None, False)
                yield pd.DataFrame([row], columns=["file_path", "text", "valid"])

    return paths.mapInPandas(load, "file_path string, text string, valid boolean")


def read_corpus(spark: SparkSession, root: str, excludes: tuple[str, ...] = EXCLUDES) -> tuple[DataFrame, DataFrame]:
    """corpus(file_path, text), and the paths of skipped files that are not UTF-8."""
    df = read_files(discover(spark, root, excludes), root)
    return df.where("valid").select("file_path", "text"), df.where("not valid").select("file_path")


def from_table(df: DataFrame, path: str, text: str) -> DataFrame:
    """A corpus from any table, by expressions of path and text."""
    return df.selectExpr(f"{path} AS file_path", f"{text} AS text")
