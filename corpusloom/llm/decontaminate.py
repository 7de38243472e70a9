"""Benchmark decontamination (operator 7): SimHash of item-sized windows, multi-index search, exact check.

Native Spark expressions only. Words are the runs of letters and digits, lower-cased; shingles
are SHINGLE_WORDS words (of a shorter item, all its words).

1. Windows. A window as long as an item that reaches the similarity shares nearly all shingles
   with it, wherever they stand in either. So places are sought where a document has a shingle
   of an item, and windows are cut at each such place that has enough of them behind it, within
   the window: as many as the similarity asks for at least. A window that begins with another
   shingle can be moved on to the next such place, and is not less similar there. So the best
   window is always cut, whether the item's parts are in their order or not.
2. Search. 64-bit SimHash fingerprints of windows and items are cut into RADIUS + 1 blocks;
   fingerprints within the radius agree on a block, so joins on (item, block, bits) find all. A
   window is searched for among the items that it was cut for, so that rows are linear in
   windows. At the similarity of just PERCENT a bit differs with p = 0.15 (mean 9.7 of 64, standard
   deviation 2.9); the radius is five deviations above, so that about one such pair in a million
   is lost. Blocks of ten bits would need a radius of 5, which would lose nearly all of them.
3. Check. The shingles' weights are their counts in the window and in the item; a pair
   stays if the sum of minima is at least PERCENT of the sum of maxima.

Items are broadcast only if they have at most MOST_BROADCAST shingles; larger sets are joined
by shuffles.

Edge cases: null or empty texts and items match nothing; documents of null id are not
reported; repeated rows are reported once; of items with equal texts each is reported, also those
of null id; without documents or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHINGLE_WORDS, PERCENT, RADIUS = 5, 80, 24
MOST_BROADCAST = 500_000


def words(text: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bag(w: Column, k: Column) -> Column:
    """The hashes of all runs of k words, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))


def simhash(hashes: Column) -> Column:
    """64 bits: the sign of the votes of all hashes, repeated ones voting repeatedly."""
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int")
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + bit(h, b) * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(votes(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def block_edges(radius: int) -> list[int]:
    return [round(k * 64 / (radius + 1)) for k in range(radius + 2)]


def block(mark: Column, k: int, edges: list[int]) -> Column:
    width = edges[k + 1] - edges[k]
    return F.shiftrightunsigned(mark, edges[k]).bitwiseAND(F.lit((1 << width) - 1))


def common_weight(x: Column, y: Column) -> Column:
    """Sum over shingles of the lesser of the counts in two bags."""
    times = lambda a, g: F.size(F.filter(a, lambda v: v == g))
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda a, g: a + F.least(times(x, g), times(y, g)))


def _runs(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity, distance): the best window of each document and item that pass; start counts words from 0."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_id).alias("item_id"), words(item_text).alias("w")).where(F.size("w") > 0)
    # an item's own key, for null and repeated ids
    items = items.select("item_id", F.xxhash64("item_id", "w").alias("item"), "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(k)).alias("k"))
    items = items.withColumn("bag", bag(F.col("w"), F.col("k")))
    items = scratch.cut(items.withColumn("mark", simhash(F.col("bag"))))
    small = items.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()[0] <= MOST_BROADCAST
    side = F.broadcast if small else lambda df: df

    # places where a document has a shingle of an item
    hits = None
    texts = rows.select("doc_id", words("text").alias("w"))
    for n in [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]:  # one number a length up to k
        keys = items.where(F.col("k") == n).select("item", "len", F.size("bag").alias("m"), F.posexplode(_runs(n)).alias("at", "run"))
        keys = keys.select("item", "len", "m", "at", F.xxhash64(*[F.get("run", F.lit(j)) for j in range(n)]).alias("h"))
        places = texts.where(F.size("w") >= n).select("doc_id", "w", (F.size("w") - n + 1).alias("places"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("pos"))
        places = places.select("doc_id", "places", "pos", F.xxhash64(*[F.get("w", F.col("pos") + j) for j in range(n)]).alias("h"))
        found = places.join(side(keys), "h").select("doc_id", "places", "item", "len", "m", "at", "pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return items.where(F.lit(False)).select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(0).alias("start"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"))
    hits = scratch.cut(hits)
    # shingles repeated in an item count as often as they stand in it, each place being held
    held = hits.groupBy("doc_id", "item").agg(F.size(F.collect_set("at")).alias("held"), F.max("m").alias("m")).where(100 * F.col("held") >= percent * F.col("m"))
    spots = hits.join(held.select("doc_id", "item"), ["doc_id", "item"], "left_semi").groupBy("doc_id", "item", "len", "m", "pos").agg(F.max("places").alias("places"))
    along = Window.partitionBy("doc_id", "item")
    spots = spots.withColumn("nth", F.row_number().over(along.orderBy("pos")))
    # places in order, each with the end of the window that begins there: how many are up to that end
    marks = F.array(F.struct(F.col("pos").alias("at"), F.lit(0).alias("end")), F.struct((F.col("pos") + F.col("m") - 1).alias("at"), F.lit(1).alias("end")))
    spots = spots.withColumn("mark", F.explode(marks)).withColumn("upto", F.sum(1 - F.col("mark.end")).over(along.orderBy("mark.at", "mark.end").rowsBetween(Window.unboundedPreceding, 0)))
    spots = spots.where("mark.end = 1").withColumn("before", F.lag("upto", 1, 0).over(along.orderBy("pos")))
    # of m shingles of the item and as many of the window, or those up to the text's end, so many have to be common
    least = F.ceil(percent * (F.col("m") + F.least("m", F.col("places") - F.col("pos"))) / (100 + percent))
    # a whole window that holds no other place than the one before it is not more similar than that one
    idle = (F.col("upto") == F.col("before")) & (F.col("pos") + F.col("m") <= F.col("places"))
    pairs = spots.where((F.col("upto") - F.col("nth") + 1 >= least) & ~idle)
    # a window that several items of one length ask for is cut once
    pairs = scratch.cut(pairs.groupBy("doc_id", "len", F.col("pos").alias("start")).agg(F.array_sort(F.collect_set("item")).alias("items")))

    cut = rows.join(pairs, "doc_id").select("doc_id", "len", "start", "items", words("text").alias("w"))
    cut = cut.select("doc_id", "len", "start", "items", F.slice("w", F.col("start") + 1, F.col("len")).alias("w")).distinct()
    cut = cut.withColumn("bag", bag(F.col("w"), F.least(F.size("w"), F.lit(k)))).drop("w")
    cut = scratch.cut(cut.withColumn("mark", simhash(F.col("bag"))))

    edges = block_edges(radius)
    blocks = lambda mark: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col(mark), b, edges).alias("v")) for b in range(radius + 1)]))
    left = cut.select("doc_id", "start", "bag", "mark", F.explode("items").alias("item")).withColumn("key", blocks("mark"))
    right = items.select("item", "item_id", F.col("bag").alias("ibag"), F.col("mark").alias("imark"), blocks("mark").alias("key")).dropDuplicates(["item", "key"])
    found = left.join(side(right), ["item", "key"])
    differ = F.col("mark").bitwiseXOR(F.col("imark"))
    # a pair that agrees on several blocks counts at the first
    at = F.array_position(F.array(*[block(differ, b, edges) == 0 for b in range(radius + 1)]), True) - 1
    found = found.where((F.bit_count(differ) <= radius) & (at == F.col("key.b")))
    found = found.withColumn("both", common_weight(F.col("bag"), F.col("ibag"))).withColumn("all", F.size("bag") + F.size("ibag") - F.col("both"))
    found = found.where(100 * F.col("both") >= percent * F.col("all"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"), F.bit_count(differ).alias("distance"))).alias("z"))
    return best.select("doc_id", "item_id", (-F.col("z.start")).alias("start"), F.col("z.similarity").alias("similarity"), F.col("z.distance").alias("distance"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
