import hashlib
import random
import re
from collections import Counter

import pytest

from corpusloom.llm import repeats
from corpusloom.llm.suffixes import suffix_array


def sharing_rows(rows):
    """Rows with a run of PASSAGE words that another row has."""
    held = {}
    for n, (_, text) in enumerate(rows):
        words = list(re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
        for a, b in zip(words, words[repeats.PASSAGE - 1 :], strict=False):
            held.setdefault((text or "").encode()[a.start() : b.end()], set()).add(n)
    return {n for found in held.values() if len(found) > 1 for n in found}


def brute(rows, length):
    seen, sharing = Counter(), sharing_rows(rows)
    for _, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for n, (i, text) in enumerate(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), n in sharing))
    return Counter(out)


def corpus(seed, length):
    draw = random.Random(seed)
    noise = lambda n, a="abcdefgé😀 ": "".join(draw.choice(a) for _ in range(n))
    passages = [noise(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length + 7)]
    rows = []
    for i in range(120):
        text = noise(draw.randint(0, 2 * length))
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            a, b = sorted(draw.choices(range(len(p) + 1), k=2)) if draw.random() < 0.5 else (0, len(p))
            text += p[a:b] + noise(draw.randint(0, length))
        rows.append((i, text))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "x" * 5 * length, "ab" * 2 * length, rows[3][1], rows[3][1], noise(8, "ab") * length, "\0" * (length + 3)])]
    return rows + [rows[5], (None, rows[7][1] + "tail"), (None, None)]


@pytest.mark.parametrize("seed,most", [(1, 400), (2, 3), (3, 0)])
def test_equals_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 97)  # many pieces a text
    monkeypatch.setattr(repeats, "PASSAGE", 7)
    monkeypatch.setattr(repeats, "PASSAGE_GRAM", 3)
    length = 60
    rows = corpus(seed, length)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = Counter(map(tuple, repeats.remove_repeats(df, length, gram=16, step=9, most_hulls=most).collect()))
    assert got == brute(rows, length)


def test_production_parameters(spark):
    rows = corpus(5, 400)[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.remove_repeats(df).collect())) == brute(rows, 400)
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_passages_shorter_than_what_is_removed(spark):
    draw = random.Random(8)
    words = lambda n: " ".join(draw.choice("abcdefgh") + draw.choice("xyz") * draw.randint(0, 3) + str(draw.randint(0, 999)) for _ in range(n))
    passage = words(51)
    assert len(passage.encode()) < 400
    rows = [(0, f"{words(30)} {passage} {words(9)}"), (1, f"\n{passage}\t{words(40)}"), (2, words(60) + " " + " ".join(passage.split()[1:])), (3, passage.replace(" ", "  ", 1)), (4, passage), (5, words(51)), (6, "a " * 50), (7, "a " * 50), (8, "b\f" * 51), (9, "b\f" * 51), (10, None), (11, "c " * 5000), (12, "c " * 60), (13, "éé " * 120), (14, "x" * 390), (15, "x" * 390)]
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(got).collect()}
    assert {i for i, r in got.items() if r.shares_passage} == sharing_rows(rows) == {0, 1, 4, 8, 9, 11, 12}
    assert got[0].n_removed == got[1].n_removed == 0


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(2000):
        t = [draw.randint(1, draw.randint(1, 4)) for _ in range(draw.randint(0, 40))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    for t in ([1] * 200, [2, 1] * 100, [1, 1, 2] * 70, [3, 1, 2] * 70, list(b"banana" * 9)):
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
