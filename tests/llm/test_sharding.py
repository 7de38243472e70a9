import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import sharding

CASES = {
    "empty": [],
    "few": [(1, "a"), (2, "a"), (3, None)],
    "ties and repeats": [(i // 2, "same" if i % 3 else f"t{i}") for i in range(101)],
    "only repeated rows": [(i % 60, f"t{i % 60}") for i in range(177)],
    "hot": [(i, "hot" if i < 400 else f"g{i // 5}" if i < 700 else f"u{i}") for i in range(1003)],
    "very hot": [(i, "hot" * 2000 if i < 9000 else f"g{i // 40}") for i in range(10_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_law_holds(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, shard int")
    got = sharding.assign_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert all(0 <= s < 16 for s in counts)
    assert not rows or max(counts.values()) - (min(counts.values()) if len(counts) == 16 else 0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # groups that fit a shard are cut by its end at most
    where = defaultdict(set)
    text = dict(rows)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    size = Counter(t for _, t in rows)
    if name == "hot":
        room = len(rows) // 16
        assert sum(len(s) > 1 for t, s in where.items() if t and 1 < size[t] <= room) <= 16
        assert len(where["hot"]) <= -(-400 // room) + 1 + 8


def test_reruns_agree(spark):
    df = spark.createDataFrame(CASES["hot"], "doc_id long, text string")
    a, b = (sorted(map(tuple, (sharding.assign_shards(df.repartition(n)).collect())), key=str) for n in (2, 5))
    assert a == b
