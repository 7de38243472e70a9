"""Toxicity (operator 1): a chain of linear classifiers.

Categories are predicted one after the other. Each category's logistic model sees the words of
the whole text (and word beginnings, for inflected forms) and the probabilities of all
categories before it. In training those probabilities are out-of-fold predictions, so that
later models learn from inputs as uncertain as the ones they will get.

Training takes a bounded sample of labelled rows (sample_rows, chosen by a hash of the id) and
keeps the max_features features that tell a category best; scoring reads every whole text. The
sample meets in one task, which is as large as sample_rows allows; the driver gets the models alone.

Edge cases: null and empty texts, and texts without letters, have no features and get the
models' base rates, but are never rejected; labels with nulls are left out of a category's
training; ids labelled more than once count with the greatest label; a category of which the
sample lacks either class always gets probability 0; repeated rows get equal results; an empty
table gives none; other columns pass through untouched, but for those named like a result, which
only accepted_documents returns. Rows of one id and text count once in training; where ids repeat
so often that the sample would be over twice its size, a share of its texts by hash is taken.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .linear import Sparse, fit, sigmoid
from .words import WordHash

#: Name of a category, and the SQL condition over the labels table that makes a row positive.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0"))
REJECT = "toxic"
SAMPLE_ROWS, MAX_FEATURES, FOLDS = 6_000, 3_000, 3
PREFIXES = (4, 5, 6, 7)
_LETTERS = re.compile(r"[^\W\d_]+")


def _features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k))


def _hashes(text: str | None, seen: WordHash) -> np.ndarray:
    words = set(_LETTERS.findall((text or "").lower()))
    found = {seen[f.encode()] for w in words for f in _features(w)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHash()
    for b in batches:
        made = [_hashes(t, seen).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(made, pa.binary())], [*b.schema.names[:-1], "hashes"])


class Chain:
    """names: the categories; vocabulary: feature hash -> column; models: (weights, chain weights, bias) or None each; threshold: of the rejecting category."""

    def __init__(self, names: list[str]):
        self.names, self.columns, self.models, self.threshold = names, np.zeros(0, np.uint64), [], 2.0

    def probabilities(self, x: Sparse) -> np.ndarray:
        out = np.zeros((x.n, len(self.names)))
        for j, model in enumerate(self.models):
            if model is not None:
                w, chain, bias = model
                out[:, j] = sigmoid(x.dot(w) + (out[:, :j] - 0.5) @ chain + bias)
        return out


def train_chain(hashes: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, names: list[str], reject: str = REJECT, max_features: int = MAX_FEATURES) -> Chain:
    """labels: a column of 0, 1 or NaN for each category; folds: a fold number for each row."""
    chain = Chain(names)
    if not hashes:
        chain.models = [None] * len(names)
        return chain
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    sizes, n = [len(h) for h in hashes], len(hashes)
    hashes.clear()  # the caller's list: a few hundred MB are not needed twice
    inverse, rows = inverse.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
    best = np.zeros(len(every))
    for j in range(len(names)):  # signed root of the likelihood ratio of each feature, with a doubt for rare ones
        ok, y = ~np.isnan(labels[:, j]), np.nan_to_num(labels[:, j])
        pos, neg = max(1.0, (y * ok).sum()), max(1.0, ((1 - y) * ok).sum())
        a = np.bincount(inverse, weights=(y * ok)[rows], minlength=len(every))
        b = np.bincount(inverse, weights=((1 - y) * ok)[rows], minlength=len(every))
        expected = (a + b) * pos / (pos + neg)
        chi = (a - expected) ** 2 / np.maximum(expected, 1e-9) * (pos + neg) / neg
        best = np.maximum(best, np.where((a + b >= 5) & (a > expected), chi, 0))
    width = min(max_features, int((best > 6).sum()))
    chosen = np.sort(np.argsort(-best, kind="stable")[:width])
    chain.columns = every[chosen]
    column = np.full(len(every), -1)
    column[chosen] = np.arange(width)
    at = column[inverse]
    x = Sparse([])
    x.n, keep = n, at >= 0
    x.row, x.col, x.val = rows[keep], at[keep], np.ones(int(keep.sum()), np.float32)
    held = np.zeros((n, len(names)))  # out-of-fold probabilities
    for j in range(len(names)):
        ok, y = ~np.isnan(labels[:, j]), np.nan_to_num(labels[:, j])
        inputs = held[:, :j] - 0.5
        if len(np.unique(y[ok])) < 2:
            chain.models.append(None)
            continue
        for f in np.unique(folds):
            fold = folds == f
            part = ok & ~fold
            w, c, bias = fit(x.take(part), inputs[part], y[part], width)
            held[fold, j] = sigmoid(x.take(fold).dot(w) + inputs[fold] @ c + bias)
        chain.models.append(fit(x.take(ok), inputs[ok], y[ok], width))
        if names[j] == reject:  # the threshold of best F1 on out-of-fold predictions
            order = np.argsort(-held[:, j], kind="stable")
            order = order[ok[order]]
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(order) + 1) + y[ok].sum())
            k = int(np.argmax(f1))
            after = held[order[k + 1], j] if k + 1 < len(order) else 0.0
            chain.threshold = float((held[order[k], j] + after) / 2)
    nothing = chain.probabilities(Sparse([np.zeros(0, np.int64)]))[0]
    if reject in names:  # a text without a known feature stays
        chain.threshold = max(chain.threshold, round(float(nothing[names.index(reject)]), 6) + 1e-5)
    return chain


def _trainer(names: list[str]):
    """The columns, models and threshold of the chain of all rows of a task, pickled; no row of none."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("hashes", "ascending")])
        y = np.column_stack([got.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names])
        hashes = [np.frombuffer(h, np.uint64) for h in got.column("hashes").to_pylist()]
        folds = got.column("fold").to_numpy()
        del got
        chain = train_chain(hashes, y, folds, names)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((chain.columns, chain.models, chain.threshold))], pa.binary())], ["chain"])

    return train


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Learns the chain from a sample of labelled documents of at most about sample_rows rows."""
    small_batches(docs.sparkSession)
    names = [n for n, _ in categories]
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.expr(f"cast(({c}) as int)")).alias(n) for n, c in categories])
    share = sample_rows / max(1, marks.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    marks = marks.where(place < int(share * 1_000_000))  # about 4 MB of ids at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")
    found = rows.select("doc_id").count()
    if found > 2 * sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 2_000_000 * sample_rows // found)
    rows = rows.select("doc_id", *names, F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    kinds = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, T.IntegerType()) for n in [*names, "fold"]], T.StructField("hashes", T.BinaryType())])
    made = rows.mapInArrow(_featurise, kinds).distinct().repartition(1).mapInArrow(_trainer(names), "chain binary").first()
    chain = train_chain([], np.zeros((0, len(names))), np.zeros(0), names)
    if made is not None:
        chain.columns, chain.models, chain.threshold = pickle.loads(made.chain)
    return chain


def _scorer(chain: Chain):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = WordHash(), {int(h): i for i, h in enumerate(chain.columns)}
        known: dict[str, tuple[int, ...]] = {}
        nothing: tuple[int, ...] = ()

        def columns(text: str | None) -> np.ndarray:
            if len(known) > 300_000:
                known.clear()
            found: set[int] = set()
            for w in set(_LETTERS.findall((text or "").lower())):
                at = known.get(w)
                if at is None:
                    at = known[w] = tuple(place[h] for h in (seen[f.encode()] for f in _features(w)) if h in place) or nothing
                if at:
                    found.update(at)
            return np.sort(np.fromiter(found, np.int64, len(found)))

        for b in batches:
            texts = b.column(b.num_columns - 1)
            p = np.round(chain.probabilities(Sparse([columns(t.as_py()) for t in texts])), 6)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array(p[:, j]) for j in range(len(chain.names)))], [f"c{i}" for i in range(b.num_columns - 1 + len(chain.names))])

    return score


def _scored(docs: DataFrame, chain: Chain, reject: str, text: str, keep: list[str]) -> DataFrame:
    """c0, c1, ...: the columns keep of docs, then the categories' probabilities; and whether a row is rejected. Names of docs clash with none of them."""
    small_batches(docs.sparkSession)
    fields = [T.StructField(f"c{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]
    made = [T.StructField(f"c{len(keep) + j}", T.DoubleType()) for j in range(len(chain.names))]
    out = docs.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)], F.col(text).alias("text")).mapInArrow(_scorer(chain), T.StructType(fields + made))
    return out.withColumn("hit", F.col(f"c{len(keep) + chain.names.index(reject)}") >= chain.threshold)


def score_toxicity(docs: DataFrame, chain: Chain, reject: str = REJECT, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default all but those named like the next ones), p_<category> for each category, and rejected (boolean). A narrow map."""
    made = [*(f"p_{n}" for n in chain.names), "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    out = _scored(docs, chain, reject, text, keep)
    return out.toDF(*keep, *made)


def accepted_documents(docs: DataFrame, chain: Chain, reject: str = REJECT, text: str = "text") -> DataFrame:
    """The rows of docs that the chain does not reject, with all their columns, whatever their names."""
    out = _scored(docs, chain, reject, text, docs.columns).where(~F.col("hit"))
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(docs.columns)])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain, keep=["doc_id"])
