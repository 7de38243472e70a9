"""Suffix-array dedup (operator 5): removes every byte inside a LENGTH-byte string that also starts elsewhere.

A corpus is too large for one suffix array, so strings that may be equal are brought together first.

1. Anchors. Every window of LENGTH bytes picks its least GRAM-byte gram by hash (leftmost of
   equals). Equal windows pick equal grams at the same offset. Only grams picked at two places
   or more matter; documents without any are done.
2. Blocks. A window is told apart, at its anchor, by its offset. Runs of STEP offsets form a
   block with a core (the bytes all its windows share) and a hull (all bytes of its windows).
   A core met once: no window of the block repeats. A hull met twice: all of them do.
3. Suffix arrays. What is left are cores met with different hulls, the ends of repeats. The
   different hulls of a core are laid side by side in a text of bounded size, with one symbol for
   the core that all of them and all their windows hold; its suffix array is built by linear
   grouping (see suffixes), and neighbours in it that agree on a window's length are repeats.
4. A core with more than MOST_HULLS hulls is not taken into one task: its blocks are cut up,
   with cores and hulls counted anew (with map-side combine), until they are single windows.

Passages of PASSAGE words, which may be shorter than LENGTH bytes, are found besides: every run
of that many words picks its least gram of PASSAGE_GRAM words in the same pass, and runs at shared
grams are compared by hash. They mark a document (shares_passage); nothing is removed for them.

All counts are over distinct texts by place; texts that occur twice are removed whole, if long
enough. Nothing is sampled or capped, and work is linear in the bytes that repeat.

A gram that very many places pick (periodic texts, copies, common passages) is hot: its places
are marked by a broadcast of such grams, whose number is bounded, not brought together.

Edge cases: null texts count as empty; texts shorter than LENGTH lose nothing; repeated rows are
copies of each other; long texts are read in pieces of PIECE windows; matches may overlap
themselves; an empty table gives no rows; other columns are ignored. Places are compared by
64-bit hashes of texts and positions, strings by 64-bit polynomial hashes of random symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, small_batches, table
from .suffixes import suffix_array
from .words import mix64

LENGTH, GRAM, STEP = 400, 64, 42
MOST_HULLS, HULLS_A_TASK, BLOCK_SYMBOLS = 400, 8_000, 1 << 16
PIECE = 1 << 19
#: Keys of texts that a task remembers.
KNOWN = 200_000
#: A passage is a run of so many words or more; runs are found by grams of so many words.
PASSAGE, PASSAGE_GRAM = 51, 20
BLANK = r"\x20\x09-\x0D"
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOLS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


class Hasher:
    """Hashes of any substring of a piece in constant time: prefix sums of symbol * base^place, times the base's inverse to the place."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, piece: np.ndarray) -> "Hasher":
        n = len(piece) + 1
        if n > len(self.up):
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)))
                self.down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[piece] * self.up[: n - 1], dtype=np.uint64)])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least(marks: np.ndarray, w: int) -> np.ndarray:
    """For each w marks in a row the place of the least, by all but the last 24 bits; the first of equals."""
    low = np.uint64((1 << 24) - 1)
    keys = (marks & ~low) | np.arange(len(marks)).astype(np.uint64)
    fill = -len(keys) % w
    grid = np.concatenate([keys, np.full(fill, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(marks) - w + 1
    return (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)


def picked(hasher: Hasher, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the loaded piece of n bytes the place of its gram; and the hashes of all grams."""
    at = np.arange(n - gram + 1)
    marks = hasher.of(at, at + gram)
    return least(marks, length - gram + 1), marks


def pieces(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that have each window of the text once."""
    a = np.frombuffer(raw, np.uint8)
    for at in range(0, len(a) - length + 1, PIECE):
        yield at, a[at : at + PIECE + length - 1]


def word_pieces(a: np.ndarray, hasher: Hasher, loaded: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, starts, ends) of the words of pieces that have each run of PASSAGE words once, with the piece loaded; loaded: the whole text is."""
    edge = np.diff(np.concatenate([[True], _BLANK[a], [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge < 0)[0], np.nonzero(edge > 0)[0]
    for at in range(0, len(starts) - PASSAGE + 1, len(starts) + 1 if loaded else PIECE // 8):
        s, e = (starts, ends) if loaded else (x[at : at + PIECE // 8 + PASSAGE - 1] for x in (starts, ends))
        offset = 0 if loaded else int(s[0])
        if not loaded:
            hasher.load(a[offset : int(e[-1])])
        yield offset, s - offset, e - offset


def word_picked(hasher: Hasher, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of PASSAGE words the first word of its gram; and the hashes of all grams of PASSAGE_GRAM words."""
    marks = hasher.of(s[: len(s) - PASSAGE_GRAM + 1], e[PASSAGE_GRAM - 1 :]) ^ np.uint64(_BASE)
    return least(marks, PASSAGE - PASSAGE_GRAM + 1), marks


def _binary(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield t.as_py() or b""


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), set()
        for b in batches:
            keys = b.column(0).to_numpy()
            h, k, a = [], [], []
            for key, raw in zip(keys, _binary(b, "text"), strict=True):
                if key in known:  # a copy in the same task has the same places
                    continue
                if len(known) > KNOWN:
                    known.clear()
                known.add(key)
                found: list[np.ndarray] = []
                whole = len(raw) <= PIECE
                if whole:
                    hasher.load(np.frombuffer(raw, np.uint8))
                for at, piece in pieces(raw, length):
                    place, marks = picked(hasher if whole else hasher.load(piece), len(piece), length, gram)
                    place = np.unique(place)
                    h.append(marks[place])
                    found.append(place + at)
                for at, s, e in word_pieces(np.frombuffer(raw, np.uint8), hasher, whole):
                    place, marks = word_picked(hasher, s, e)
                    place = np.unique(place)
                    h.append(marks[place])
                    found.append(~(s[place] + at))  # places of words are told from others by their sign
                if found:
                    a += found
                    k.append(np.full(sum(map(len, found)), key))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(k)), pa.array(np.concatenate(a))], ["h", "key", "a"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, hull, key, runs) for each shared gram h of words: the hashes of the runs of PASSAGE words that pick it, and of all their bytes."""
    hasher = Hasher()
    for b in batches:
        keys, shared, out = b.column(0).to_numpy(), b.column(2), []
        for j, raw in enumerate(_binary(b, "text")):
            mine = np.asarray(shared[j].values, np.int64)
            mine = ~mine[mine < 0]
            if not len(mine):
                continue
            a = np.frombuffer(raw, np.uint8)
            whole = len(a) <= PIECE
            if whole:
                hasher.load(a)
            for at, s, e in word_pieces(a, hasher, whole):
                place, marks = word_picked(hasher, s, e)
                first = np.nonzero(np.concatenate([[True], np.diff(place) != 0]))[0]
                last = np.append(first[1:], len(place)) - 1
                keep = np.isin(s[place[first]] + at, mine)
                first, last = first[keep], last[keep]
                sizes = last - first + 1
                each = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out.append((marks[place[first]], hasher.of(s[first], e[last + PASSAGE - 1]), np.full(len(first), keys[j]), sizes, hasher.of(s[each], e[each + PASSAGE - 1])))
        if out:
            h, hull, key, sizes, runs = (np.concatenate(c) for c in zip(*out, strict=True))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(key), lists], ["h", "hull", "key", "runs"])


def _met(rows: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """Keys of a written table's rows whose by another key has, too."""
    facts = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(by, "n")
    return scratch.cut(join_counted(rows.select(by, "key"), scratch.cut(facts), by, "n").select("key").distinct())


def passage_keys(full: DataFrame, scratch: Scratch) -> DataFrame:
    """(key) of texts of full(key, text, anchors) with a run of PASSAGE words that another one has.

    Most have all runs of some gram in common, which one hash tells; only at the grams of the
    others are single runs compared.
    """
    blocks = scratch.cut(full.mapInArrow(_passages, "h long, hull long, key long, runs array<long>"))
    found = _met(blocks, "hull", scratch)
    marked = blocks.select("h", "key").join(found.withColumn("met", F.lit(True)), "key", "left")
    left = marked.groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("met").isNull()).alias("open")).where("open > 0").select("h", "n")
    runs = scratch.cut(join_counted(blocks, scratch.cut(left), "h", "n").select("key", F.explode("runs").alias("w")))
    return found.unionByName(_met(runs, "w", scratch)).distinct()


def place_id(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.view(np.uint64) * np.uint64(_BASE) + at.astype(np.uint64)).view(np.int64)


def _blocks(length: int, gram: int, step: int):
    """(core, hull, id, key, s, e, a) of the blocks at shared anchors; s to e are starts of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            keys, shared, out = b.column(0).to_numpy(), b.column(2), []
            for j, raw in enumerate(_binary(b, "text")):
                mine = np.unique(np.asarray(shared[j].values, np.int64))
                for at, piece in pieces(raw, length):
                    place, _ = picked(hasher.load(piece), len(piece), length, gram)
                    s = np.arange(len(place))
                    kind = (place - s) // step
                    first = np.nonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(kind) != 0)]))[0]
                    last = np.append(first[1:], len(place)) - 1
                    a, kind = place[first], kind[first]
                    keep = np.isin(a + at, mine)
                    first, last, a, kind = first[keep], last[keep], a[keep], kind[keep]
                    near, far = kind * step, np.minimum(kind * step + step - 1, length - gram)
                    core = _mark(hasher.of(a - near, a - far + length), near, far)
                    hull = _mark(hasher.of(first, last + length), first - a, last - a)
                    out.append((core, hull, np.full(len(a), keys[j]), first + at, last + at, a + at))
            if out:
                core, hull, key, s, e, a = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core, hull, place_id(key, s), key, s, e, a)], ["core", "hull", "id", "key", "s", "e", "a"])

    return run


def _mark(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h + (x * 4096 + y).astype(np.int64).view(np.uint64) * np.uint64(_BASE)).view(np.int64)


def repeated_windows(strings: list[list[int]], windows: list[int], lengths: list[int]) -> list[np.ndarray]:
    """Of each string, the starts below windows of runs of its length that are found at two such places in the strings, by one suffix array. Strings of different lengths have no run in common."""
    text: list[int] = []
    begins = [0]
    for s in strings:
        text += s
        text.append(1)
        begins.append(len(text))
    order = np.array(suffix_array(text), np.int64)
    owner = np.searchsorted(begins, order, side="right") - 1
    order = order[order - np.array(begins)[owner] < np.array([*windows, 0])[owner]]
    hit, before = np.zeros(len(text) + 1, bool), None
    sizes = np.repeat(lengths, np.diff(begins)).tolist()
    for i, p in enumerate(order.tolist()):
        window = text[p : p + sizes[p]]
        if window == before:
            hit[p] = hit[order[i - 1]] = True
        before = window
    return [np.nonzero(hit[begins[i] : begins[i + 1] - 1])[0] for i in range(len(strings))]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (core, key, s, n, left, right, length), those of a core together: n windows from s on, the bytes before and behind the core, and a window's length with the core as one symbol -> (key, s, e) of runs of repeated windows."""
    held: list[tuple[int, int, int, int]] = []
    strings: list[list[int]] = []
    size, core, symbol = 0, None, 257

    def made() -> pa.RecordBatch:
        rows: list[tuple[int, int, int]] = []
        for (key, s, _, _), found in zip(held, repeated_windows(strings, [h[2] for h in held], [h[3] for h in held]), strict=True):
            if len(found):
                cut = np.nonzero(np.diff(found) > 1)[0]
                rows += [(key, s + int(x), s + int(y)) for x, y in zip(found[np.append(0, cut + 1)], found[np.append(cut, len(found) - 1)], strict=True)]
        held.clear()
        strings.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["key", "s", "e"])

    for b in batches:
        for c, key, s, n, left, right, length in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if c != core:
                if size > BLOCK_SYMBOLS:  # cores are kept whole; several fill a block
                    yield made()
                    size, symbol = 0, 257
                core, symbol = c, symbol + 1
            held.append((key, s, n, length))
            strings.append([*(x + 1 for x in left), symbol, *(x + 1 for x in right)])
            size += len(strings[-1])
    if held:
        yield made()


def _parts(length: int, step: int):
    """Rows (key, s, e, a, near, far, bytes): windows at offsets near to far before the anchor a -> runs of step of these offsets, with cores and hulls of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            out = []
            for key, s, e, a, near, far, raw in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                lo = np.arange(near, far + 1, step)
                hi = np.minimum(lo + step - 1, far)
                first, last = np.maximum(s, a - hi), np.minimum(e, a - lo)
                keep = first <= last
                lo, hi, first, last = lo[keep], hi[keep], first[keep], last[keep]
                hasher.load(np.frombuffer(raw, np.uint8))
                core = _mark(hasher.of(a - lo - s, a - hi - s + length), lo, hi)
                hull = _mark(hasher.of(first - s, last - s + length), first - a, last - a)
                ids = place_id(np.full(len(lo), key), first)
                out += [(*row, raw[row[4] - s : row[5] - s + length]) for row in zip(*(x.tolist() for x in (core, hull, ids, np.full(len(lo), key), first, last, np.full(len(lo), a), lo, hi)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(9)] + [pa.array([r[9] for r in out], pa.binary())], ["core", "hull", "id", "key", "s", "e", "a", "near", "far", "bytes"])

    return run


def _counted(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(core, hull, again, places, one, hulls): again tells whether the hull has two places, places how many rows it has; hulls, how many different ones its core has. Cores that need no further look have hulls 0; cores of one place are left out."""
    by_hull = blocks.groupBy("core", "hull").agg(F.count("*").alias("places"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("id", "key", "s", "e", "a")).alias("one"))
    by_hull = scratch.cut(by_hull.select("core", "hull", (F.col("lo") != F.col("hi")).alias("again"), "places", "lo", "hi", "one"))
    by_core = by_hull.groupBy(F.col("core").alias("c")).agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("hulls"), F.count_if(~F.col("again")).alias("open")).where("l <> h")
    by_core = by_core.select("c", F.when(F.col("open") > 0, F.col("hulls")).otherwise(0).alias("hulls"))
    return scratch.cut(by_hull.join(by_core, F.col("core") == F.col("c")).select("core", "hull", "again", "places", "one", "hulls"))


def repeated_runs(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, step: int = STEP, most_hulls: int = MOST_HULLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts(doc_id, key, text), equal texts having equal keys -> (key, text) of documents with shared anchors, (key, s, e) of runs of window starts that repeat in other texts or elsewhere in their own, and (key) of texts with a run of PASSAGE words that another text has."""
    anchors = scratch.cut(texts.select("key", "text").where(F.octet_length("text") >= min(length, 2 * PASSAGE - 1)).mapInArrow(_anchors(length, gram), "h long, key long, a long"))
    place = F.xxhash64("key", "a")
    shared = scratch.cut(anchors.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h", "n"))
    hits = join_counted(anchors, shared, "h", "n").groupBy("key").agg(F.collect_set("a").alias("anchors"))  # bounded by a text's own length
    hits = scratch.cut(hits)
    scratch.drop(anchors)
    reps = texts.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("r")).withColumnRenamed("key", "k")
    hits = hits.join(reps, F.col("key") == F.col("k")).drop("key")
    full = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("key") == F.col("k"))).select("key", "text", "anchors").dropDuplicates(["key"])
    full = scratch.cut(full)

    blocks = scratch.cut(full.mapInArrow(_blocks(length, gram, step), "core long, hull long, id long, key long, s long, e long, a long"))
    counted = _counted(blocks, scratch)
    sure = lambda blocks, counted: join_counted(blocks, counted.where("again").select("core", "hull", "places"), ["core", "hull"], "places").select("key", "s", "e")
    runs = sure(blocks, counted)

    # the different hulls of cores that are not settled, with their bytes
    some = counted.where("hulls > 1").select("core", "hulls", "one.*")
    spots = F.transform("spots", lambda p: F.struct(p["core"].alias("core"), p["hulls"].alias("hulls"), p["s"].alias("s"), p["e"].alias("e"), p["a"].alias("a")))
    lists = some.groupBy("key").agg(F.collect_list(F.struct("core", "hulls", "s", "e", "a")).alias("spots")).select(F.col("key").alias("k"), spots.alias("spots"))
    cut = full.join(lists, F.col("key") == F.col("k")).select("key", F.col("text").cast("binary").alias("raw"), F.explode("spots").alias("p"))
    hulls = scratch.cut(cut.select("key", "p.*", F.substring(F.col("raw"), (F.col("p.s") + 1).cast("int"), (F.col("p.e") - F.col("p.s") + length).cast("int")).alias("bytes")))
    # all hulls of a core have its bytes in common: one symbol stands for them
    kind = F.floor((F.col("a") - F.col("s")) / step)
    near, far = kind * step, F.least(kind * step + step - 1, F.lit(length - gram))
    before = (F.col("a") - near - F.col("s")).cast("int")
    core = F.lit(length) - (far - near)
    few = hulls.where(F.col("hulls") <= most_hulls).select(
        "core", "key", "s", (F.col("e") - F.col("s") + 1).alias("n"), F.substring("bytes", F.lit(1), before).alias("left"),
        F.substring(F.col("bytes"), (before + core + 1).cast("int"), F.lit(length)).alias("right"), (far - near + 1).alias("length"),
    )
    # a task's work is bounded by its bytes of text, however many there are
    few = few.repartition(max(1, hulls.count() // HULLS_A_TASK), "core").sortWithinPartitions("core").mapInArrow(_arrays, "key long, s long, e long")
    runs = runs.unionByName(few)

    # cores of very many hulls: their blocks are cut up until each is one window
    many = hulls.where(F.col("hulls") > most_hulls).select("key", "s", "e", "a", near.alias("near"), far.alias("far"), "bytes")
    while step > 1:
        step = max(1, round(step**0.5)) if step > 4 else 1
        parts = scratch.cut(many.mapInArrow(_parts(length, step), "core long, hull long, id long, key long, s long, e long, a long, near long, far long, bytes binary"))
        if parts.isEmpty():
            break
        counted = _counted(parts.select("core", "hull", "id", "key", "s", "e", "a"), scratch)
        runs = runs.unionByName(sure(parts, counted))
        # one place of every hull goes on, also of settled ones, as open hulls may share windows with them
        open_ones = counted.where("hulls > 1").select("core", "hull", F.col("one.id").alias("id"))
        many = parts.join(open_ones, ["core", "hull", "id"]).select("key", "s", "e", "a", "near", "far", "bytes")
    return full.select("key", "text"), runs, passage_keys(full, scratch)


def _removal(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, ends, out = b.column(0), b.column(2), b.column(3), []
            for j, raw in enumerate(_binary(b, "text")):
                s, e = np.asarray(starts[j].values, np.int64), np.asarray(ends[j].values, np.int64) + length
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                first = np.append(True, s[1:] > e[:-1])
                s, e = s[first], e[np.append(first[1:], True)]
                kept, at = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                out.append((int((e - s).sum()), len(s), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["key", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, most_hulls: int = MOST_HULLS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage) of each row of docs.

    shares_passage tells whether the text has a run of PASSAGE words or more, with the same blanks
    between them, that another row's text has, too, whatever its bytes.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    full, runs, passages = repeated_runs(rows, scratch, length, gram, step, most_hulls)
    lists = runs.groupBy("key").agg(F.collect_list("s").alias("s"), F.collect_list(F.struct("s", "e")).alias("p")).select(F.col("key").alias("k"), F.col("p.s").alias("s"), F.col("p.e").alias("e"))
    parts = full.join(lists, F.col("key") == F.col("k")).select("key", "text", "s", "e").mapInArrow(_removal(length), "key long, n_removed long, n_spans long, kept_sha256 string")
    parts = scratch.cut(parts)

    facts = scratch.cut(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha"), F.col("text").rlike(rf"^[{BLANK}]*+(?:[^{BLANK}]++[{BLANK}]*+){{{PASSAGE}}}").alias("many")))
    copies = facts.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = copies.join(parts, "key", "full").join(passages.withColumn("shares", F.lit(True)), "key", "full").select("shares", F.col("key").alias("k"), "copies", "n_removed", "n_spans", "kept_sha256")
    out = facts.join(marks, F.col("key") == F.col("k"), "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    pick = lambda all_of_it, part, none: F.when(whole, all_of_it).otherwise(F.coalesce(F.col(part), none))
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("sha")).alias("kept_sha256"),
        (F.col("many") & (F.col("copies").isNotNull() | F.coalesce("shares", F.lit(False)))).alias("shares_passage"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS u FROM texts),
passages AS (
  SELECT r, md5(array_to_string(u[i:i + 49], '') || regexp_extract(u[i + 50], '^[^\x20\x09-\x0D]+')) AS p
  FROM (SELECT r, u, unnest(range(1, len(u) - 49)) AS i FROM words WHERE len(u) >= 51)),
sharing AS (SELECT DISTINCT r FROM passages WHERE p IN (SELECT p FROM passages GROUP BY p HAVING count(DISTINCT r) > 1)),
windows AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM texts WHERE length(h) >= 800)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, i FROM windows JOIN again USING (k)),
runs AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e FROM (
    SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM (
      SELECT r, i, CASE WHEN i > 400 + lag(i) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS opens FROM starts))
  GROUP BY r, run),
gaps AS (
  SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS since, e, row_number() OVER (PARTITION BY r ORDER BY s DESC) AS back FROM runs),
kept AS (
  SELECT g.r, count(*) AS n_spans, sum(g.e - g.s) AS n_removed,
    string_agg(substr(t.h, 2 * since + 1, 2 * (g.s - since)) || CASE WHEN back = 1 THEN substr(t.h, 2 * g.e + 1) ELSE '' END, '' ORDER BY g.s) AS h
  FROM gaps g JOIN texts t ON g.r = t.r GROUP BY g.r)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256, t.r IN (SELECT r FROM sharing) AS shares_passage
FROM texts t LEFT JOIN kept k ON t.r = k.r
"""
