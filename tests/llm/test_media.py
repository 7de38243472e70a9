"""Operator 12: exact round trips, and fingerprints against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import media

NOISE = bytes(random.Random(2).choices(range(32, 127), k=40_000))
TEXTS = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "été 😀\x00\r\n", "same text " * 300, "same text " * 300, NOISE.decode(), "ab " * 400_000]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("media")
    spark.createDataFrame([(i if i != 2 else None, t, "x", b"x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, payload binary, n_bytes int").repartition(3).write.parquet(f"{top}/documents.parquet")
    return media.op12_media(spark, str(top)).collect()


def test_round_trip(rows):
    assert len(rows) == len(TEXTS) and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        raw = (TEXTS[2 if r.doc_id is None else r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.from_wav(stored) == payload
        time, code = plain(payload)
        assert r.n_pairs == len(time) and r.feature == hashlib.sha256(",".join(f"{t}:{c}" for t, c in zip(time, code, strict=True)).encode()).hexdigest()
    assert rows[0].feature is not None and len({r.feature for r in rows if r.doc_id in (7, 8)}) == 1


def plain(payload):
    """Frame by frame, band by band."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    n = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * media.HOP + media.FRAME - len(x))])
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / media.FRAME) for i in range(media.FRAME)])
    tops = []
    for f in range(n):
        frame = x[f * media.HOP : f * media.HOP + media.FRAME]
        power = np.rint(np.abs(np.fft.rfft((frame - frame.mean()) * window)) ** 2 * media.STEPS)
        tops.append([(max(range(a, b), key=lambda i: (power[i], -i)), power[a:b].max()) for a, b in zip(media.BANDS, media.BANDS[1:], strict=False)])
    found = []
    for f, row in enumerate(tops):
        for k, (at, p) in enumerate(row):
            before, after = tops[f - 1][k][1] if f else 0.0, tops[f + 1][k][1] if f + 1 < n else 0.0
            if p > 0 and p >= before and p > after:
                found.append((f, at))
    pairs = sorted((f, (a << 16) | (b << 8) | (g - f)) for i, (f, a) in enumerate(found) for g, b in found[i + 1 : i + 1 + media.FAN] if g - f <= media.REACH)
    return [p[0] for p in pairs], [p[1] for p in pairs]


def test_blocks_change_nothing(monkeypatch):
    whole = media.fingerprint(NOISE)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(NOISE), strict=True))


def test_excerpts_are_found_at_one_distance():
    """An excerpt that starts on a frame has its pairs in the whole, all moved by as many frames."""
    start = 50 * media.HOP
    time, code = media.fingerprint(NOISE)
    have = set(zip(time.tolist(), code.tolist(), strict=True))
    t, c = media.fingerprint(NOISE[start : start + 20_000])
    shared = sum((a + 50, b) in have for a, b in zip(t.tolist(), c.tolist(), strict=True))
    other = sum((a + 51, b) in have for a, b in zip(t.tolist(), c.tolist(), strict=True))
    assert shared > 0.9 * len(t) > 50 * max(other, 1)


def test_silence_and_other_formats():
    assert len(media.fingerprint(b"\x80" * 64)[0]) == 0 and len(media.fingerprint(b"\x80" * 10_000)[0]) == 0
    bad = bytearray(media.to_wav(b"1234"))
    bad[22] = 2
    with pytest.raises(ValueError, match="mono"):
        media.from_wav(bytes(bad))


def test_empty_table(spark):
    empty = media.with_media(spark.createDataFrame([], "k string, payload binary"), "k")
    assert media.with_fingerprints(empty, "k").collect() == []
