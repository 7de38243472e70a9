import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import mixing


def brute(rows, quality):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, text, source in rows:
        digest = lambda t: hashlib.md5(t.encode()).hexdigest()
        u = (int(digest(f"{'' if i is None else i}:{'' if text is None else digest(text)}")[:13], 16) + 1) / (2**52 + 2)
        by[source].append((-math.log(u) / mixing.QUALITY_WEIGHT[quality.get(i)], i if i is not None else -math.inf, size(text), text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(d[2] for d in by[s]) for s in names}
    target, open_ones, left = {}, set(names), sum(total.values())
    while open_ones:  # share by weight, cap, and share again what is left
        w = sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if left * weight[s] >= 3 * total[s] * w}
        if not over:
            target |= {s: left * weight[s] / w for s in open_ones}
            break
        for s in over:
            target[s] = float(3 * total[s])
        left -= sum(3 * total[s] for s in over)
        open_ones -= over
    out = Counter()
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        for _, i, n, _ in sorted(by[s], key=lambda d: d[:3]):
            copies = min(3, epochs + (2 * before + n <= 2 * rest)) if n else 0
            before += n
            out[(None if i == -math.inf else i, n, total[s], round(target[s], 6), copies * n)] += 1
    return out


ROWS = [(i, None if i % 17 == 3 else "w " * ((i * 7919) % 40), None if i % 13 == 0 else f"s{i % 5}" if i % 3 else "hot") for i in range(300)]
ROWS += [(9, ROWS[9][1], ROWS[9][2]), (1000, "", "empty"), (1001, "a\x0bb\xa0c\nd", "é"), (None, "x y z", "hot")]


def test_equals_brute_force(spark):
    quality = {i: i % 2 for i in range(0, 300, 3)}
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, size int").repartition(3)
    marks = spark.createDataFrame([(i, q) for i, q in quality.items()] + [(0, 0)], "doc_id long, quality int")
    got = mixing.mix(df, marks).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(ROWS, quality)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size for r in mine)


def test_documents_come_as_often_as_they_are_taken(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, __n int")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one two", "a")]])
def test_small_tables(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.taken for r in got] == ([2] if rows and rows[0][1] else [0] * len(rows))


def test_rows_of_null_id_are_sampled_by_their_texts(spark):
    rows = [(None, f"t{i} w", "a") for i in range(2000)] + [(i, f"t{i} w w w", "b") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).where("source = 'a'").collect()
    share = got[0].target % got[0].source_size / got[0].source_size
    assert 0.1 < share < 0.9
    more = [r.copies > got[0].target // got[0].source_size for r in got]
    assert abs(sum(more) - share * len(got)) <= 1
    # neither the first nor the last texts in order are preferred
    by_text = [m for _, m in sorted(zip((r.text_key for r in got), more, strict=True))]
    half = sum(by_text[:1000]) / sum(by_text)
    assert 0.4 < half < 0.6
