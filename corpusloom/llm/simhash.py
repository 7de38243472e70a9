"""Document fingerprints (operator 4): SimHash with permuted block tables.

A text's terms are its runs of three words (fewer words: all of them as one), each weighted by
1 + ln(count). Every term's 128-bit hash votes with its weight on each bit; the sign of the sum
is the bit. Two fingerprints' likeness estimates the cosine of their weighted term vectors:
cos(pi * distance / 128), not below 0.

Search (near): 128 bits are cut into BLOCKS blocks; a table is kept for each choice of
BLOCKS - radius blocks, keyed by those blocks' bits. Fingerprints within the radius differ in at
most radius blocks, so they agree on the key of at least one table: all are found. Equal
fingerprints are looked up once, whatever the number of their documents.

Counts (near_counts): near copies at a Jaccard similarity of 0.8 of five-word shingles lie up to
about NEAR of 128 bits apart, too far for keys of whole blocks. 128 bits are cut into 8 blocks of
16; fingerprints within NEAR < 8 * (FLIPS + 1) differ by at most FLIPS bits in some block, so each
query looks up its blocks with up to FLIPS bits flipped: all are found. Only counts leave a task,
never pairs.

Neighbours (pair_with_next): documents are dealt to ranges of the id cut at quantiles; each
range also receives the first row of the next one (a halo), so that no task needs more than its range
and texts are shuffled once.

Edge cases: a null text counts as empty; a text without words has the fingerprint 0, with
likeness 1 to itself and 0 to others (unless both are without words); rows of null id come
last; repeated rows stand next to each other; a single document's next one is itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .words import WordHash, mix64, shingle_hashes, word_hashes

TERM_WORDS, BITS = 3, 128
BLOCKS, RADIUS = 5, 3
NEAR, FLIPS = 23, 2
MARKS_PER_TASK, ASKED_PER_TASK, CANDIDATES = 250_000, 500_000, 1 << 20
ROWS_PER_RANGE, MOST_RANGES = 1_000, 20_000
PIECE = 1 << 15


def simhash(text: str, seen: WordHash) -> bytes:
    """16 bytes; of a text without words, zeros."""
    terms = shingle_hashes(word_hashes(text.encode("utf-8", "replace"), seen), TERM_WORDS)
    if not len(terms):
        return bytes(BITS // 8)
    terms, counts = np.unique(terms, return_counts=True)
    weights, votes = 1 + np.log(counts), np.zeros(BITS)
    for at in range(0, len(terms), PIECE):
        t = terms[at : at + PIECE]
        with np.errstate(over="ignore"):
            both = np.column_stack([t, mix64(t ^ np.uint64(0xA5A5A5A5A5A5A5A5))])
        bits = np.unpackbits(both.view(np.uint8), axis=1)
        w = weights[at : at + PIECE]
        votes += 2 * (w.astype(np.float32) @ bits.astype(np.float32)).astype(float) - w.sum()
    out = np.packbits(votes > 0).tobytes()
    return out if any(out) else b"\1" + out[1:]  # zeros are for texts without words


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; texts without words are like each other only."""
    if a == b:
        return 1.0
    if not any(a) or not any(b):
        return 0.0
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return round(max(0.0, float(np.cos(np.pi * apart / BITS))), 6)


def ranges(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> tuple[np.ndarray, dict[int, int]]:
    """Ascending cuts of -id into ranges of about equal counts (MOST_RANGES at most), and the greatest id of each range that has rows."""
    ids = rows.select(F.col("doc_id").cast("long")).where("doc_id is not null")
    many = max(1, min(MOST_RANGES, ids.count() // rows_per_range))
    cuts = ids.approxQuantile("doc_id", [k / many for k in range(1, many)], 1 / (4 * many)) if many > 1 else []
    cuts = np.unique(-np.array(cuts, np.int64))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            part = np.searchsorted(cuts, -ids, side="right")
            order = np.lexsort((-ids, part))
            parts, at = np.unique(part[order], return_index=True)
            for r, i in zip(parts.tolist(), ids[order][at].tolist(), strict=True):
                most[r] = max(i, most.get(r, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.int64())], ["r", "top"])

    tops = ids.mapInArrow(top, "r long, top long").groupBy("r").agg(F.max("top").alias("top")).orderBy("r").collect()
    return cuts, {r["r"]: r["top"] for r in tops}


def _dealer(cuts: np.ndarray, tops: dict[int, int]):
    """Adds part and halo to rows; the first row of a range comes again, as a halo, in the range before it (of the first: in the last)."""
    parts = np.array(list(tops) or [0], np.int64)
    firsts = np.array([*tops.values()] or [0], np.int64)
    before = np.roll(parts, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            part = np.where(missing, parts[-1], np.searchsorted(cuts, -ids, side="right"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int64()), pa.array(np.zeros(len(ids), np.int32))], ["doc_id", "text", "part", "halo"])
            if tops:
                at = np.searchsorted(parts, part).clip(0, len(parts) - 1)
                again = np.nonzero(~missing & (firsts[at] == ids))[0]
                if len(again):
                    some = b.take(pa.array(again))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(before[at[again]], pa.int64()), pa.array(np.ones(len(again), np.int32))], ["doc_id", "text", "part", "halo"])

    return deal


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, halo and descending id -> the result row of each document and the one after it."""
    seen = WordHash()
    held = first = part = None  # (doc_id, text, fingerprint) of the last document, and of the part's first row
    out: list[tuple] = []

    def close(after: tuple) -> None:
        i, text, mark = held
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        other = mark if edited == text else simhash(edited, seen)
        out.append((i, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, after[2])))

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, list(FIELDS))

    for b in batches:
        for i, text, p, halo in zip(*(b.column(k) for k in range(4)), strict=True):
            i, text, p, halo = i.as_py(), text.as_py(), p.as_py(), halo.as_py()
            if p != part:
                if held:
                    close(first)
                held, first, part = None, None, p
            elif halo and not held:
                continue  # a further row of the halo's id
            row = (i, text, simhash(text, seen))
            if held:
                close(row)
            held = None if halo else row
            first = first or row
        yield made()
    if held:
        close(first)
    yield made()


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """FIELDS of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(_dealer(*ranges(rows, rows_per_range)), "doc_id long, text string, part long, halo int")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Masks of the two 64-bit halves of each permuted table's key."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << (BITS - edges[k + 1]) for k in kept)
        out.append((signed(mask >> 64), signed(mask & ((1 << 64) - 1))))
    return out


def near(marks: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, mark: str = "fingerprint") -> DataFrame:
    """All (query, found, distance, n) with n documents of marks whose fingerprint found is within radius of a query's fingerprint.

    Both sides are collapsed to distinct fingerprints before the block tables are joined.
    """
    half = lambda at: F.conv(F.substring(mark, at, 16), 16, -10).cast("long")
    # conv gives a signed 64-bit value for a negative base
    shape = lambda df: df.where(F.col(mark).isNotNull()).groupBy(F.col(mark)).agg(F.count("*").alias("n")).select(F.col(mark).alias("mark"), "n", half(1).alias("hi"), half(17).alias("lo"))
    keyed = lambda df: df.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("hi").bitwiseAND(F.lit(a)).alias("a"), F.col("lo").bitwiseAND(F.lit(b)).alias("b")) for t, (a, b) in enumerate(tables(radius, blocks))])).alias("key"))
    left = keyed(shape(queries)).select(F.col("mark").alias("query"), F.col("hi").alias("qhi"), F.col("lo").alias("qlo"), "key")
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("qhi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("qlo")))
    found = keyed(shape(marks)).join(left, "key").withColumn("distance", distance).where(F.col("distance") <= radius)
    return found.groupBy("query", F.col("mark").alias("found")).agg(F.first("distance").alias("distance"), F.first("n").alias("n"))


def _counter(radius: int, flips: int, most: int = CANDIDATES):
    """Of a table of marks (hi, lo, n) and one of queries (query, hi, lo): each query with the sum of n over the marks within radius."""
    masks = np.array([sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(16), k)], np.uint16)

    def words(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(c).to_numpy().astype(np.int64, copy=False) for c in ("hi", "lo")]).view(np.uint64)

    def count(marks: pa.Table, asked: pa.Table) -> pa.Table:
        m, q, n, total = words(marks), words(asked), marks.column("n").to_numpy(), np.zeros(asked.num_rows, np.int64)
        m_blocks, q_blocks = m.view(np.uint16).reshape(-1, 8), q.view(np.uint16).reshape(-1, 8)
        for k in range(8 if len(m) and len(q) else 0):
            order = np.argsort(m_blocks[:, k], kind="stable")
            starts = np.searchsorted(m_blocks[order, k], np.arange((1 << 16) + 1))
            for mask in masks:
                at = q_blocks[:, k] ^ mask
                first, many = starts[at], starts[at.astype(np.int64) + 1] - starts[at]
                ends = np.cumsum(many)
                for low in range(0, int(ends[-1]), most):  # candidates low to high, in order of the queries
                    place = np.arange(low, min(low + most, int(ends[-1])))
                    i = np.searchsorted(ends, place, side="right")
                    j = order[first[i] + place - (ends[i] - many[i])]
                    near = np.bitwise_count(m[j] ^ q[i]).sum(1) <= radius
                    i, j = i[near], j[near]
                    if len(i):
                        # a pair counts at the first of its blocks that are alike
                        fresh = (np.bitwise_count(m_blocks[j, :k] ^ q_blocks[i, :k]) > flips).all(1)
                        np.add.at(total, i[fresh], n[j[fresh]])
        return pa.table({"query": asked.column("query"), "near": pa.array(total, pa.int64())})

    return count


def near_counts(marks: DataFrame, queries: DataFrame, radius: int = NEAR, flips: int = FLIPS, marks_per_task: int = MARKS_PER_TASK, asked_per_task: int = ASKED_PER_TASK, mark: str = "fingerprint") -> DataFrame:
    """(query, near): for each distinct fingerprint of queries the number of rows of marks within radius of it.

    Both sides are collapsed to distinct fingerprints and dealt to parts; each pair of parts is a task.
    """
    if radius >= 8 * (flips + 1):
        raise ValueError(f"{flips} flips in each of 8 blocks do not find all within {radius}")
    half = lambda at: F.conv(F.substring("query", at, 16), 16, -10).cast("long")
    shape = lambda df: df.where(F.col(mark).isNotNull()).groupBy(F.col(mark).alias("query")).agg(F.count("*").alias("n")).select("query", "n", half(1).alias("hi"), half(17).alias("lo"))
    parts, asked_parts = (max(1, -(-df.count() // most)) for df, most in ((marks, marks_per_task), (queries, asked_per_task)))
    place = lambda n: F.pmod(F.xxhash64("hi", "lo"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shape(marks).select("hi", "lo", "n", place(parts).alias("p"), others(asked_parts).alias("a"))
    right = shape(queries).select("query", "hi", "lo", others(parts).alias("p"), place(asked_parts).alias("a"))
    found = left.groupBy("p", "a").cogroup(right.groupBy("p", "a")).applyInArrow(_counter(radius, flips), "query string, near long")
    return found.groupBy("query").agg(F.sum("near").alias("near"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_near: for rows whose id is divisible by 20, the number of other documents within NEAR."""
    made = Scratch(spark).cut(fingerprint_documents(table(spark, sf_dir, "documents")))
    asks = F.col("doc_id") % 20 == 0
    counts = near_counts(made, made.where(asks))
    joined = made.join(counts, (F.col("fingerprint") == F.col("query")) & asks, "left")
    return joined.select(*FIELDS, F.when(asks, F.col("near") - 1).alias("n_near"))
