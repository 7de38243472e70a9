"""N-gram Jaccard join (operator 2): a blocked sparse product of the document by n-gram incidence.

Documents of equal shingle sets are one row (class) of the incidence matrix M. Links are the
entries of M M^T that reach the threshold. The columns are put in one global order and the
product is taken in two column blocks:

1. The prefix block: of each row its first |x| - ceil(t |x|) + 1 columns. Two rows that reach
   the threshold t share one of them. Where a shared column is the first one, all columns before
   it are known not to overlap, so pairs are discarded whose columns left, on either side, stay
   below t / (1 + t) (|x| + |y|); that bounds their sizes, too.
2. The rest, for the pairs that are left: whole sparse rows are multiplied, blocked by the row,
   and the accumulated overlap is compared exactly.

The order puts rare columns first, so that prefixes seldom meet by chance. A column's count is
needed only where prefixes can reach: at first, columns with a hash below REGION of the hash
range are ordered by (count, hash), the others come after them by hash. Columns of a single
class cannot make a pair: they only push others back, and are dropped once counted. Rows whose
prefix holds no shared column have no partner. Among the rows left, which are few, all columns
are counted and ordered anew, which again leaves out rows that share common passages alone.

Components need not all entries of a large group of near copies. In each round a few pivot rows
per column are multiplied with that column's rows of other components; what links is contracted.
A pivot is done with its column and leaves it, and a column leaves when its rows are one
component. Rounds go on until no column is left, with GROWTH times as many pivots in each next
one, so that they are few and no step depends on how many pairs are left. No link between rows
of different components is left out. A column's rows, and a pivot's pairs, are dealt to tasks by
their number, however many they are.

Edge cases: null or empty texts, or texts without words, have the empty set and link to
nothing; a text of fewer words than a shingle has all of them as its only one; a row of null
id has component null and passes no link on; repeated rows and ids are linked to
themselves; an empty table gives no rows; other columns are ignored. Shingles are
compared by 64-bit hashes, classes likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, Scratch, components, join_counted, small_batches, table
from .words import WordHash, shingle_hashes, word_hashes

SHINGLE_WORDS, PERCENT = 5, 80
REGION = 0.26
#: How many times as many pivots a column has in each next round; one in the first.
GROWTH = 4


def _sets(batch: pa.RecordBatch, column: str, k: int, seen: WordHash) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    texts = batch.column(batch.schema.get_field_index(column))
    for t in texts.cast(pa.binary()):
        t = t.as_py()
        yield np.unique(shingle_hashes(word_hashes(t, seen), k)) if t else np.zeros(0, np.uint64)


def _class(found: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty one."""
    if not len(found):
        return 0
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)) or 1


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sizes(k: int, percent: int, region: float):
    """(doc_id, n, c, inside, cols): size and class of each set, and its columns that can be in a prefix: the first ones by hash, all of the region (inside of them), and beyond it as many as a prefix may lack."""
    bound = np.uint64(int(region * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for b in batches:
            sets = list(_sets(b, "text", k, seen))
            inside = [int(np.searchsorted(s, bound)) for s in sets]
            cols = [s[: max(m, prefix_size(len(s), percent))].view(np.int64) for s, m in zip(sets, inside, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array(inside, pa.int64()), pa.array(cols, pa.list_(pa.int64()))], ["doc_id", "n", "c", "inside", "cols"])

    return run


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for b in batches:
            sets = list(_sets(b, "text", k, seen))
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c", "row"])

    return run


def _pairable(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of a written table the rows of columns that hold a possible partner: one not too large for the row's slack, and one with slack enough for the row. rows is dropped."""
    lists = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("slack").alias("most")).where("m > 1")
    both = join_counted(rows, scratch.cut(lists), "h", "m")
    fits = F.col("slack") >= percent * F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    out = scratch.cut(both.where(fits & (F.col("most") >= percent * F.col("n"))).select(*rows.columns))
    scratch.drop(rows)
    return out


def _enough(percent: int, overlap: Column, x: Column, y: Column) -> Column:
    """100 overlap >= percent (x + y - overlap), in whole numbers."""
    return (100 + percent) * overlap >= percent * (x + y)


class Joined:
    """documents: (doc_id, n_shingles, c, component_id); links: (a, b) of classes that were multiplied and reach the threshold."""

    def __init__(self, documents: DataFrame, links: DataFrame, classes: DataFrame):
        self.documents, self.links, self.classes = documents, links, classes


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, region: float = REGION, doc_id: str = "doc_id", text: str = "text") -> Joined:
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = scratch.cut(rows.mapInArrow(_sizes(k, percent, region), "doc_id long, n long, c long, inside long, cols array<long>"))
    named = sizes.where("c <> 0 and doc_id is not null")
    classes = scratch.cut(named.groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("inside").alias("inside")))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    byte_order = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  hashes are unsigned
    order = Window.partitionBy("c").orderBy("m", byte_order("h"))

    # columns of two classes or more, with their counts; counted before any row of them is brought together
    entries = named.select("c", "inside", F.posexplode("cols").alias("i", "h")).select("h", "c", F.when(F.col("i") >= F.col("inside"), F.col("i")).alias("i"))
    counts = entries.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h", "m")
    shared = entries.join(counts, "h").groupBy("h", "c").agg(F.max("m").alias("m"), F.max("i").alias("i"))
    # the place of each shared column in its row: columns of one class come first in the region
    placed = scratch.cut(shared).join(classes, "c")
    inner = placed.where("i is null").withColumn("at", F.col("inside") - F.count("*").over(Window.partitionBy("c")) + F.row_number().over(order) - 1)
    placed = inner.unionByName(placed.where("i is not null").withColumn("at", F.col("i").cast("long"))).where(F.col("at") < prefix)
    some = scratch.cut(placed.select("c", F.col("rep").alias("doc_id")).distinct())

    # all other rows have no partner; among those left, all columns are counted and ordered anew
    # (one plan at all sizes: texts are dealt by id once, and looked up in that part of the ids)
    full = rows.join(some.hint("shuffle_hash"), "doc_id", "left_semi").select("text").mapInArrow(_rows(k), "c long, row array<long>")
    full = scratch.cut(full.join(some, "c", "left_semi").dropDuplicates(["c"]))
    entries = full.select("c", F.explode("row").alias("h"))
    counts = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    placed = entries.join(counts, "h").join(classes.select("c", "n"), "c")
    placed = placed.withColumn("at", F.col("n") - F.count("*").over(Window.partitionBy("c")) + F.row_number().over(order) - 1)
    # slack: what 100 + percent times the most that may still overlap leaves for the partner's size; pairs need slack >= percent * n both ways
    slack = (100 + percent) * (F.col("n") - F.col("at")) - percent * F.col("n")
    prefixes = scratch.cut(placed.where(F.col("at") < prefix).select("h", "c", "n", slack.alias("slack")))
    prefixes = _pairable(_pairable(prefixes, percent, scratch), percent, scratch)
    labels = scratch.cut(prefixes.select("c", F.col("c").alias("comp")).distinct())
    full = scratch.cut(full.join(labels, "c", "left_semi"))
    links = tried = None

    step = 0
    while True:
        mine = scratch.cut(prefixes.join(labels, "c"))
        open_h = mine.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        groups = scratch.cut(join_counted(mine, scratch.cut(open_h.select("h", "m")), "h", "m"))
        scratch.drop(mine)
        if groups.isEmpty():
            break
        # one row of a component stands for it (at first that of most slack, which has the fewest columns of its
        # own); of the components the smallest, which are done soonest, give the pivots; more of them in each round
        key = F.struct((F.xxhash64("c", F.lit(step)) if step else -F.col("slack")).alias("k"), "c", "n", "slack")
        reps = groups.groupBy("h", "comp").agg(F.count("*").alias("size"), F.first("m").alias("m"), F.min(key).alias("p"))
        deal = F.pmod(F.xxhash64("comp", F.lit(step)), F.lit(GROWTH**step))
        pivots = reps.groupBy("h", deal.alias("d")).agg(F.first("m").alias("m"), F.min(F.struct("size", "p", "comp")).alias("z"))
        pivots = scratch.cut(pivots.select("h", "m", F.col("z.p.c").alias("c"), F.struct("z.p.c", "z.p.n", "z.p.slack", "z.comp").alias("p")))
        # a column's rows are dealt to tasks by their number
        x = lambda name: F.col(f"p.{name}")
        spread = lambda m: F.ceil(F.col(m) / HOT_ROWS)
        copies = pivots.select("h", "p", F.explode(F.sequence(F.lit(0).cast("long"), spread("m") - 1)).alias("s"))
        pairs = groups.withColumn("s", F.pmod(F.xxhash64("c"), spread("m"))).join(copies, ["h", "s"]).where(F.col("comp") != x("comp"))
        # the first column that two rows share passes this test if they reach the threshold
        pairs = pairs.where((F.col("slack") >= percent * x("n")) & (x("slack") >= percent * F.col("n")))
        near = pairs.groupBy(F.least("c", x("c")).alias("a"), F.greatest("c", x("c")).alias("b")).agg(F.max(F.struct(x("c").alias("c"), "m")).alias("z"))
        if tried is not None:
            near = near.join(tried, ["a", "b"], "left_anti")
        other = F.when(F.col("z.c") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        near = scratch.cut(near.select("a", "b", F.col("z.c").alias("p"), other.alias("q"), F.pmod(F.xxhash64(other), F.ceil(F.col("z.m") / HOT_ROWS)).alias("s")))
        rows_of = lambda c, into: full.select(F.col("c").alias(c), F.col("row").alias(into))
        most = pivots.groupBy(F.col("c").alias("p")).agg(F.max("m").alias("m"))
        wide = rows_of("p", "y").join(most, "p").select("p", "y", F.explode(F.sequence(F.lit(0).cast("long"), spread("m") - 1)).alias("s"))
        found = near.join(rows_of("q", "x"), "q").join(wide, ["p", "s"])
        found = found.withColumn("overlap", F.size(F.array_intersect("x", "y"))).where(_enough(percent, F.col("overlap"), F.size("x"), F.size("y")))
        found = scratch.cut(found.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        near = near.select("a", "b")
        tried = near if tried is None else tried.unionByName(near)
        la, lb = (labels.select(F.col("c").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
        roots = components(found.join(la, "a").join(lb, "b"), scratch, "ca", "cb")
        labels = scratch.cut(labels.join(roots, F.col("comp") == F.col("node"), "left").select("c", F.coalesce("root", "comp").alias("comp")))
        # a pivot has met its column's rows; columns of one component are done
        prefixes = scratch.cut(groups.select("h", "c", "n", "slack").join(pivots.select("h", "c"), ["h", "c"], "left_anti"))
        scratch.drop(groups)
        step += 1
    named = classes.join(labels, "c", "left").select("c", "rep", F.coalesce("comp", "c").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = scratch.cut(named.join(smallest, "comp").select("c", "component_id"))
    out = sizes.drop("cols").join(named, "c", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("c") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "c", component.cast("long").alias("component_id"))
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    return Joined(out, links, classes)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).documents.select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
entries AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
often AS (SELECT g FROM entries GROUP BY g HAVING count(*) > 1),
shared AS (SELECT e.* FROM entries e JOIN often o ON e.g = o.g),
pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM shared x JOIN shared y ON x.g = y.g AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS v, a AS r FROM sym UNION SELECT sym.b AS v, reach.r FROM reach JOIN sym ON sym.a = reach.v WHERE reach.r < sym.b),
comp AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(p.r, c.rep) END AS component_id
FROM sets s JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN comp p ON p.v = c.rep
"""
