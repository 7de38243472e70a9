import random
import re
from collections import Counter

from corpusloom.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = set()
    for i, text in docs:
        w = words(text)
        for j, item in items:
            v = words(item)
            k = min(5, len(v))
            if i is None or not v or not w:
                continue
            y = bag(v, k)
            for s in range(len(w)):  # a text's end may hold most of an item
                x = bag(w[s : s + len(v)], min(5, len(w[s : s + len(v)])))
                both = sum((x & y).values())
                if 100 * both >= 80 * (sum(x.values()) + sum(y.values()) - both):
                    out.add((i, j))
    return out


def test_equals_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(60)]
    sentence = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(draw.randint(12, 60)))) for i in range(20)] + [(20, "only three words"), (21, ""), (22, None), (23, "one two three four five"), (24, "a b a b a b a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, "x"), (3, "say only THREE words!"), (4, "one two three four five"), (5, "b a b a b a b a b a b a b a b a b a c")]
    for n in range(6, 90):
        w, item = sentence(draw.randint(0, 80)), words(items[draw.randrange(20)][1])
        for _ in range(n % 4):
            at = draw.randrange(len(item))
            change = draw.randrange(3)
            item = item[:at] + (["new"] if change == 0 else ["more", item[at]] if change == 1 else []) + item[at + 1 :]
        at = draw.randint(0, len(w))
        docs.append((n, "*** ".join(w[:at] + item + w[at:]).title()))
    docs += [(30, dict(docs)[30]), (None, docs[30][1])]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(d, b).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(docs, items)
    assert decontaminate.contaminated(d.where("false"), b).count() == 0
    assert decontaminate.contaminated(d, b.where("false")).count() == 0


def test_windows_are_searched_among_their_own_items(spark, monkeypatch):
    """Rows of the search are linear in windows, also where very many items have one length and long texts hold many of them."""
    draw = random.Random(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(60)] + [(None, "the null item has words of its own and more of them")]
    text = lambda some: " ".join(" ".join(f"x{draw.randint(0, 9999)}" for _ in range(30)) + " " + items[i][1] for i in some)
    docs = [(0, text(range(60))), (1, text([3])), (2, "y " * 200_000 + items[7][1]), (3, "no item"), (4, f"a b c {items[60][1]} d")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    sizes, cut = [], decontaminate.Scratch.cut
    monkeypatch.setattr(decontaminate.Scratch, "cut", lambda self, df: (sizes.append((df.columns, out := cut(self, df))), out)[1])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(0, i) for i in range(60)} | {(1, 3), (2, 7), (4, None)}
    windows = next(df for columns, df in sizes if "mark" in columns and "start" in columns)
    # at the end of three texts, shorter windows that hold enough of the item are looked at, too
    assert windows.count() == 63 + 9 and max(len(r["items"]) for r in windows.collect()) == 1


def test_windows_of_moved_inserted_and_dropped_parts(spark):
    """Against all windows: parts of an item in another order, with words between or without some, often at the threshold."""
    draw = random.Random(8)
    made = lambda n: [f"v{draw.randint(0, 40)}" for _ in range(n)]
    items = [(i, " ".join(made(draw.randint(20, 110)))) for i in range(12)]
    items += [(100, " ".join(["a b c d e f g"] * 8)), (101, " ".join(f"p{i}" for i in range(102)))]
    docs = []
    for n in range(240):
        w = draw.choice(items)[1].split()
        cuts = sorted(draw.randint(0, len(w)) for _ in range(draw.choice([0, 1, 1, 2, 2, 3])))
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        if n % 3:
            draw.shuffle(parts)
        if n % 4 == 0:
            parts.insert(draw.randint(0, len(parts)), made(draw.randint(1, 6)))
        body = [x for p in parts for x in p]
        if n % 5 == 0:
            at = draw.randint(0, len(body))
            del body[at : at + draw.randint(1, 8)]
        docs.append((n, " ".join([*made(draw.choice([0, 0, 30])), *body, *made(draw.choice([0, 0, 30]))])))
    p = items[-1][1].split()
    docs.append((900, " ".join(["junk"] * 20 + p[68:] + p[:34] + p[34:68] + ["junk"] * 20)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (900, 101) in want and len(want) > 150
