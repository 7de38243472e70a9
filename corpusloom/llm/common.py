"""Shared pieces of the training-data operators: lineage cuts, distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes that an Arrow batch of texts holds at most.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch sizes: batches of whole texts are buffered outside of the heap by every task, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Spark's setting that deletes the shuffles of a plan once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage, and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}
        path = self._path(self.top)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # with the session's end

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read again; the shuffles of the write are deleted at its end, as nothing reads them after it."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, df: DataFrame) -> None:
        """Deletes the table behind a DataFrame that cut() returned."""
        if found := self.paths.pop(id(df), None):
            path = self._path(found[0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that a task may well have; of a larger table, this share of its rows.
HOT_ROWS, HOT_SHARE = 1_000, 100_000


def join_counted(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined to facts by key (one or several columns), where facts has one row a key with the count of its rows. Keys of very many rows do not meet in a task.

    Keys of more than a HOT_SHAREth of all rows are fewer than HOT_SHARE, whatever the table, so
    that their facts are broadcast and their rows stay where they are; all others are joined by a
    shuffle that the hot rows are not part of. rows should be a written table: it is read twice.
    """
    most = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = F.broadcast(facts.where(F.col(count) > most))
    rest = rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(facts.where(F.col(count) <= most).hint("shuffle_hash"), key)
    return rows.join(hot, key).unionByName(rest)


def ranked(df: DataFrame, bucket: Column, order: list[Column], by: list[str], into: str, weight: Column | None = None) -> DataFrame:
    """Adds the running sum of weight (default 1) before each row, within by, in the order of (bucket, order).

    No task sees more than one bucket of one key: sums by bucket are taken first (with
    map-side combine), prefix-summed over the few buckets, and added to ranks inside a bucket.
    bucket has to be a non-null integer that does not decrease along the order.
    """
    weight = F.lit(1) if weight is None else weight
    df = df.withColumns({"__b": bucket, "__w": weight.cast("long")})
    keys = [*by, "__b"]
    sums = df.groupBy(*keys).agg(F.sum("__w").alias("__sum"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__off", F.coalesce(F.sum("__sum").over(upto), F.lit(0).cast("long"))).drop("__sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0).cast("long")))
    sums = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__off")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    df = df.join(sums, cond, "left")
    return df.withColumn(into, F.col("__in") + F.col("__off")).drop("__b", "__w", "__in", "__off", *[f"__k_{k}" for k in keys])


def buckets_for(rows: int) -> int:
    """The root of the rows: as many buckets as rows in a bucket, so that neither window grows faster."""
    return max(1, int(rows**0.5))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by randomised contraction: (node, root) for each node of the edges.

    In each round every node points to its least neighbour (by id in even rounds, by a hash of
    the round in odd ones), the edges are rewritten to the nodes pointed to, and loops fall away.
    Edges shrink by a constant factor a round. Mappings stay in the shared folder until they are
    composed. root is some node of the component; a caller takes its own minimum.
    """
    left = scratch.cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    maps: list[DataFrame] = []
    for step in range(60):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if left.isEmpty():
            break
        if step % 2:
            key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("k"), F.col(c).alias("v"))
        else:
            key = lambda c: F.struct(F.col(c).alias("k"), F.col(c).alias("v"))
        least = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        to = scratch.cut(least.select(F.col("a").alias("node"), F.least(F.col("m"), key("a")).getField("v").alias("root")))
        maps.append(to)
        at = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))  # noqa: E731, B023
        moved = left.join(at("a"), "a").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        after = scratch.cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(left)
        left = after
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("__r"))
        out = scratch.cut(earlier.join(later, "root", "left").select("node", F.coalesce("__r", "root").alias("root")))
    return out


#: States that running() gathers before it starts another array.
RUN = 256


def running(items: str, start: str, step: str, kind: str) -> str:
    """SQL of the states after each element of an array, each made of the one before and the element; kind is their type.

    step is an expression of the state, `t.at`, and the element, `x`. A fold that appends to one
    array copies it at each element. Here a fold over blocks of RUN elements appends to a short
    array, and arrays of blocks are strung together at the end, so that arrays of any length take
    time in proportion to it, but for a small share. (SQL, as column functions take a call to the
    JVM for each of its parts.)
    """
    none = f"cast(array() AS array<{kind}>)"
    inside = f"aggregate(b, named_struct('at', s.at, 'out', {none}), (t, x) -> get(transform(array({step}), n -> named_struct('at', n, 'out', concat(t.out, array(n)))), 0))"
    blocks = f"transform(sequence(1, size(v), {RUN}), i -> slice(v, i, {RUN}))"
    done = f"aggregate({blocks}, named_struct('at', cast({start} AS {kind}), 'out', cast(array() AS array<array<{kind}>>)), (s, b) -> get(transform(array({inside}), r -> named_struct('at', r.at, 'out', concat(s.out, array(r.out)))), 0))"
    return f"get(transform(array({items}), v -> if(size(v) > 0, flatten({done}.out), {none})), 0)"
