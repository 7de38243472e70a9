"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

Each document draws an exponential key -ln(u) / w, with u from a hash of its id and text and w its
quality weight. Documents of a source are sorted by key and their sizes prefix-summed to the
source's budget. Targets above a source's size first take complete epochs (every document
that often), and only the rest of the budget is filled by the sorted order.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; rows of null id, or of one id, draw by their texts; rows equal in both share a draw
and are taken one by one; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the most epochs of a source.
WEIGHTS, MOST = (1, 2, 3), 3
#: Weight of a document in the draw, by its quality label (null: not labelled).
QUALITY_WEIGHT = {1: 2.0, 0: 0.5, None: 1.0}


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", text_key: str = "text_key") -> Column:
    """u in (0, 1), from the first 13 hex digits of the md5 of the id and the text's md5."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_key), F.lit("")))
    digits = F.conv(F.substring(F.md5(both), 1, 13), 16, 10)
    return (digits.cast("double") + 1) / F.lit(float(2**52 + 2))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target: weighted shares of the total, capped, the excess reshared.

    Resharing until none is above its cap is water filling: in ascending order of cap / weight,
    sources are capped as long as the level over the others, (total - caps so far) / weights left,
    is at least their ratio. Integers up to the last division, so that reruns and engines agree.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranks = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    ranks = ranks.withColumns({
        "left": total - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    ranks = ranks.withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights"))
    level = ranks.where(~F.col("capped")).agg(F.max(F.struct("weights", "left")).alias("l"))
    share = F.col("weight") * F.col("l.left") / F.col("l.weights")
    return ranks.crossJoin(F.broadcast(level)).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, text_key, size, source, source_size, target, copies, taken) for each row of docs; text_key is the text's md5.

    quality: (doc_id, quality) rows that weigh the draw; several for one id count as their
    greatest. A document is taken whole in the last, fractional epoch if at least half of it lies within the
    budget, so that a source misses its target by half a document at most.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).select("doc_id", "source", word_count().alias("size"), F.md5("text").alias("text_key"))
    rows = Scratch(docs.sparkSession).cut(rows)  # five plans below read the sizes: words are counted once
    weight = F.lit(QUALITY_WEIGHT[None])
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(best, "doc_id", "left")
        weight = F.when(F.col("quality") == 1, QUALITY_WEIGHT[1]).when(F.col("quality") == 0, QUALITY_WEIGHT[0]).otherwise(QUALITY_WEIGHT[None])
    rows = rows.select("doc_id", "text_key", "source", "size", (-F.log(draw()) / weight).alias("key"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    targets = targets.join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the number of sources is far below that of documents, but not bounded: Spark decides on the join
    rows = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    many = F.ceil(F.sqrt("n"))  # as many buckets as rows in a bucket: neither window grows faster than the root
    bucket = F.least(many - 1, F.floor((1 - F.exp(-F.col("key"))) * many))
    rows = ranked(rows, bucket, [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_key")], ["source"], "before", F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when((F.col("size") > 0) & (F.col("before") * 2 + F.col("size") <= rest * 2), 1).otherwise(0)
    copies = F.least(copies, F.lit(most)) * (F.col("size") > 0).cast("long")
    return rows.withColumn("copies", copies.cast("long")).select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Rows of one id and text are interchangeable and share their copies."""
    mine = mix(docs, quality, doc_id=doc_id, text=text, **options).where("copies > 0")
    copies = mine.groupBy(F.col("doc_id").alias("__i"), F.col("text_key").alias("__t")).agg(F.sum("copies").alias("__n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__id"), F.md5(F.col(text)).alias("__k"))
    rows = rows.join(copies, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__t"))).dropDuplicates(["__id", "__k"])
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).select("__row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((CAST('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(md5(d.text), '')), 1, 13) AS BIGINT)::DOUBLE + 1) / 4503599627370498.0)
      / (CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN best q ON d.doc_id = q.doc_id),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS cap FROM totals),
sorted AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighed),
flagged AS (SELECT *, remaining * weight >= cap * weights AS capped FROM sorted),
level AS (SELECT remaining, weights FROM flagged WHERE NOT capped ORDER BY weights DESC LIMIT 1),
targets AS (
  SELECT f.source, f.source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (f.weight * l.remaining)::DOUBLE / l.weights::DOUBLE END AS target
  FROM flagged f LEFT JOIN level l ON true),
ordered AS (
  SELECT r.*, t.source_size, t.target,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
chosen AS (
  SELECT *, CASE WHEN size > 0 THEN least(3, epochs + CASE WHEN before * 2 + size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS copies
  FROM ordered)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM chosen
"""
