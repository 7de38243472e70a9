"""Language identification (operator 6) by error-correcting output codes.

Every language has a binary codeword. For each bit a linear classifier over byte n-grams (2 and 3
bytes of the lower-cased letters of the text) says on which side of the bit a text lies. A text
gets the language whose codeword has the least loss against all bits' margins, each bit weighted
by how well its classifier does on rows of the sample that it has not learned from (two halves,
each judged by a classifier of the other); if the runner-up is near, it is flagged.

Training takes a bounded sample (per_language rows of each language, by a hash of the id);
prediction reads every whole text, in pieces of bounded size.

Edge cases: null texts and texts without a letter give `und` with score 0; with no training
rows every text gives `und`; with one language every text with a letter gives that one, score 1;
rows of null lang are never learned from; repeated rows get equal results; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .linear import Sparse, fit

UNKNOWN = "und"
#: Of more than MANY_LANGUAGES languages, each has fewer than PER_LANGUAGE rows in the sample; all are learned.
PER_LANGUAGE, MANY_LANGUAGES = 600, 200
SLOTS = 1 << 16
PIECE = 1 << 18
AMBIGUOUS = 0.2
FIT = {"l2": 3e-4, "steps": 60, "rate": 0.05}
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n different codewords of +1 and -1: all splits for up to 5 languages, else the best of many random codes."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        masks = range(1, 1 << (n - 1))  # the first language has -1 throughout; complements are the same split
        return np.array([[1 if i and m >> (i - 1) & 1 else -1 for m in masks] for i in range(n)], np.int8)
    bits, best, most = int(10 * np.ceil(np.log2(n))), None, -1
    for code in (np.random.default_rng(seed + k).choice(np.array([-1, 1], np.int8), (n, bits)) for k in range(50)):
        apart = np.min((bits - code.astype(int) @ code.T.astype(int))[~np.eye(n, dtype=bool)])
        if apart > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart
    return best


def _letters(text: str | None) -> bytes:
    """The letters of the text, lower-cased, in runs with a blank around each; empty if there are none."""
    if not text or not _LETTER.search(text):
        return b""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def _slots(raw: bytes) -> Iterator[np.ndarray]:
    """Slots of all 2- and 3-byte windows, piece by piece; each window comes once. (Single bytes count through pairs.)"""
    a = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(a) - 2), PIECE):
        x = a[at : at + PIECE + 2].astype(np.uint32)
        three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
        two = (x[:-2] * np.uint32(0x27D4EB2F) + x[1:-1] * np.uint32(0x165667B1)) ^ np.uint32(0x5BD1E995)
        yield np.concatenate([three, two]) >> np.uint32(16)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots, shares = [], []
        for t in b.column("text").to_pylist():
            n, total = np.zeros(SLOTS, np.int64), 0
            for piece in _slots(raw) if (raw := _letters(t)) else ():
                n += np.bincount(piece, minlength=SLOTS)
                total += len(piece)
            at = np.nonzero(n)[0]
            slots.append(at.astype(np.int32).tobytes())
            shares.append((n[at] / max(1, total)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())], ["id", "lang", "slots", "shares"])


class Coder:
    """languages, their codewords, weights (SLOTS x bits), bias of each bit, and the bits' weights in decoding."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of margins: the index of the best language, its share (softmin of the losses), whether it is ambiguous."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, 1)[:, -2:] if p.shape[1] > 1 else np.column_stack([np.zeros(len(p)), p[:, 0]])
        return loss.argmin(1), p.max(1), two[:, 1] - two[:, 0] < AMBIGUOUS


def _held_margins(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Margins of each row by a classifier of the other half of the rows."""
    out, half = np.zeros(x.n), np.arange(x.n) % 2 == 0
    for part in (half, ~half):
        w, _, bias = fit(x.take(part), np.zeros((int(part.sum()), 0)), y[part], SLOTS, **FIT)
        out[~part] = x.take(~part).dot(w) + bias
    return out


def fit_languages(docs: DataFrame, learn: Column | None = None, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Coder:
    """Learns from at most about per_language documents of each language among the rows where learn holds."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if learn is None else learn))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().collect()  # one row a language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Coder([], np.ones((0, 0)), np.zeros((SLOTS, 0), np.float32), np.zeros(0), np.zeros(0))
    most = max(1, min(per_language, per_language * MANY_LANGUAGES // len(languages)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, int(min(1.0, most / r["count"]) * 1_000_000)))])
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1_000_000))  # null or repeated ids are no one place
    sample = rows.where(place < F.try_element_at(share, F.col(lang))).select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    got = sample.mapInArrow(_histogram, "id string, lang string, slots binary, shares binary").distinct().orderBy("id", "lang", F.xxhash64("slots", "shares")).toArrow()
    x = Sparse([np.frombuffer(s, np.int32) for s in got.column("slots").to_pylist()], [np.sqrt(np.frombuffer(s, np.float32)) for s in got.column("shares").to_pylist()])
    mine = np.array([languages.index(v) for v in got.column("lang").to_pylist()], np.int64)
    code = codewords(len(languages))
    # the model is linear in shares when it predicts, so it is fitted on shares scaled to unit columns
    x.val = x.val**2
    scale = 1 / np.sqrt(np.bincount(x.col, weights=x.val**2, minlength=SLOTS) / max(1, x.n) + 1e-7)
    x.val = (x.val * scale[x.col]).astype(np.float32)
    weights, bias, trust = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for j in range(code.shape[1]):
        y = (code[mine, j] > 0).astype(float)
        w, _, bias[j] = fit(x, np.zeros((x.n, 0)), y, SLOTS, **FIT)
        margins = x.dot(w) + bias[j]
        right = ((_held_margins(x, y) > 0) == (y > 0.5)).mean() if x.n else 0.5
        usual = float(np.median(np.abs(margins))) or 1.0  # margins are given in units of the sample's, so that shares aren't overconfident
        weights[:, j], bias[j] = w * scale / usual, bias[j] / usual
        trust[j] = max(1e-3, 2 * right - 1)
    return Coder(languages, code, weights, bias, trust / trust.sum() * code.shape[1] if len(trust) else trust)


def _predictor(model: Coder):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            margins, known = np.zeros((len(texts), model.code.shape[1])), np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                if raw := _letters(t.as_py()):
                    known[i], n = True, 0
                    for piece in _slots(raw) if len(model.languages) > 1 else ():
                        margins[i] += model.weights[piece].sum(0, dtype=np.float64)
                        n += len(piece)
                    margins[i] = margins[i] / max(1, n) + model.bias
            if model.languages:
                best, share, unsure = model.decode(margins)
            else:
                known[:] = False
                best, share, unsure = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(names, pa.string()), pa.array(np.where(known, np.round(share, 6), 0.0)), pa.array(np.where(known, unsure, True))], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return predict


def predict_languages(docs: DataFrame, model: Coder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row; a narrow map over whole texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(model), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, ~held_out())
    return predict_languages(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
