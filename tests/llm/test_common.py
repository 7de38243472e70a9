import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, components, ranked


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    want = defaultdict(set)
    for v in list(root):
        want[find(v)].add(v)
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_ranked(spark):
    rows = [(i % 3, i, (i * 31) % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int, w int")
    out = ranked(df, (F.col("v") / 17).cast("long"), [F.col("v")], ["k"], "before", F.col("w"))
    total = defaultdict(int)
    want = {}
    for k, v, w in sorted(rows, key=lambda r: r[1]):
        want[v] = total[k]
        total[k] += w
    assert {r.v: r.before for r in out.collect()} == want
