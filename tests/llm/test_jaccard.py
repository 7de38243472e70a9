import random
from collections import Counter

import pytest

from corpusloom.llm import common, jaccard


def brute(rows):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(x), None if i is None else least[find(a)] if x else i) for a, (i, x) in enumerate(sets))


def corpus(seed):
    draw = random.Random(seed)
    sentence = lambda n: [draw.choice("abcdefghijklmnop") + str(draw.randint(0, 30)) for _ in range(n)]
    rows, passage, base = [], sentence(40), sentence(60)
    for i in range(150):
        kind = i % 6
        w = sentence(draw.randint(0, 50))
        if kind == 0:
            w = w + passage
        elif kind in (1, 2):  # a group of near copies of many degrees
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = f"new{draw.randint(0, 99)}"
        elif kind == 3:
            w = passage + sentence(draw.randint(0, 6))
        rows.append((1000 - 3 * i, " ".join(w)))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", " \t\n", "one", "ONE", "one two three", "One\x0btwo\fthree", "é É", "É é", "x " * 3000, "X " * 2990, "a b c d e"])]
    return rows + rows[3:6] + [(None, rows[1][1]), (None, "lone null id words here five six"), (7000, "y" * 100_000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    out = jaccard.jaccard_components(df).documents
    assert Counter(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


@pytest.mark.parametrize(("growth", "hot"), [(1, 1000), (4, 3), (64, 10)])
def test_rounds_of_pivots_lose_nothing(spark, monkeypatch, growth, hot):
    rows = corpus(4)
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    for module in (jaccard, common):  # columns of more rows are hot
        monkeypatch.setattr(module, "HOT_ROWS", hot)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_components(df, region=0.1).documents
    assert Counter(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_many_texts_of_one_passage_and_groups_of_copies(spark):
    draw = random.Random(9)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(50)]
    rows = [(i, " ".join(passage + [word() for _ in range(draw.randint(4, 14))])) for i in range(150)]
    for i in range(150):
        w = list(base)
        w[draw.randrange(50)] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:k])) for i, k in enumerate(range(36, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard.jaccard_components(df).documents
    assert Counter(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).documents.count() == 0
