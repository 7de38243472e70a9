import hashlib

import pytest

from corpusloom.llm import simhash
from corpusloom.llm.words import WordHash


def brute(rows):
    """rows: (doc_id, text) in any order."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (simhash.simhash(t, WordHash()) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_equals_brute_force(spark, n):
    rows = [(i * 3 - 50, None if i % 11 == 5 else " ".join(f"w{(i * j) % 37}é😀" for j in range(i % 23))) for i in range(n)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    got = simhash.fingerprint_documents(df, rows_per_range=20).collect()
    assert len(got) == n
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "x y z"), (5, "x y z"), (1, "q")], "doc_id long, text string")
    got = simhash.fingerprint_documents(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "5", "None"]
    assert all(r.fingerprint == got[0].fingerprint for r in got if r.doc_id == got[0].doc_id)
    only = simhash.fingerprint_documents(df.where("doc_id is null")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
    assert simhash.fingerprint_documents(df.where("false")).count() == 0


def test_search_finds_all_within_radius(spark):
    import random

    draw = random.Random(1)
    base = [draw.getrandbits(128) for _ in range(40)]
    marks = base + [b ^ sum(1 << k for k in draw.sample(range(128), d)) for b in base for d in (0, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    got = {(r["query"], r.found): (r.distance, r.n) for r in simhash.near(df, df).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): ((a ^ b).bit_count(), marks.count(b)) for a in set(marks) for b in set(marks) if (a ^ b).bit_count() <= 3}
    assert got == want


def test_counts_equal_brute_force(spark):
    import random

    draw = random.Random(2)
    base = [draw.getrandbits(128) for _ in range(30)]
    marks = base + [b ^ sum(1 << k for k in draw.sample(range(128), d)) for b in base for d in (0, 3, 16, 20, 22, 23, 24, 30)]
    marks += [base[0] ^ sum(1 << k for k in range(128) if k % 16 in (5, 11, 15) and k // 16 < 7) ^ 3, 0, (1 << 128) - 1]
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    asked = df.limit(40)
    want = {f"{a:032x}": sum((a ^ b).bit_count() <= simhash.NEAR for b in marks) for a in marks[:40]}
    for sizes in ((1000, 1000), (60, 15)):
        got = {r["query"]: r.near for r in simhash.near_counts(df, asked, marks_per_task=sizes[0], asked_per_task=sizes[1]).collect()}
        assert got == want
    assert simhash.near_counts(df.where("false"), asked).where("near > 0").count() == 0


def test_near_copies_are_counted(spark, tmp_path):
    import random

    draw, rows, want = random.Random(3), [], {}
    for g in range(40):  # a text of 250 words and copies of it with 2 to 4 words changed, Jaccard of five-word shingles 0.8 or more
        text, copies = [f"w{draw.randrange(3000)}" for _ in range(250)], []
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for c in range(4):
            other = list(text)
            for at in draw.sample(range(250), c and c + 1):
                other[at] = f"x{draw.randrange(3000)}"
            copies.append(other)
            rows.append((20 * g if c == 0 else 20 * g + c, " ".join(other)))
        alike = [len(shingles(text) & shingles(o)) / len(shingles(text) | shingles(o)) for o in copies[1:]]
        want[20 * g] = sum(a >= 0.8 for a in alike)
        assert want[20 * g] == 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_near for r in simhash.op4_fingerprints(spark, str(tmp_path)).collect() if r.n_near is not None}
    assert got == want
