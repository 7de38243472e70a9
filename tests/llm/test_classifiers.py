import random

import numpy as np

from corpusloom.llm import langid, toxicity

VOCABULARY = {"xx": "la que de los una por con esta".split(), "yy": "the of and that with from this have".split(), "zz": "der und das nicht ein mit auf fur".split()}
BAD = ["grubble", "snorkish", "vexlump"]


def corpus(n, seed=1):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        words = [draw.choice(VOCABULARY[lang]) + draw.choice(["", "a", "en", "o"]) for _ in range(draw.randint(20, 80))]
        toxic, low = draw.random() < 0.2, draw.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(BAD).title() + draw.choice(["", "s", "ed"]))
        if low:
            words = [w + "***" for w in words] + ["clickbait"] * 2
        docs.append((i, " ".join(words), None if i % 29 == 5 else lang, f"s{i % 4}", "clash"))
        if i % 2:
            labels.append((i, None if i % 31 == 0 else int(not low), int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, hashes string"
ODD = [(90001, None, None, None, None), (90002, "", "yy", None, None), (90003, "12 345 !!! ***", "yy", None, None), (90004, "the and " * 60_000, None, None, None), (90004, "the and " * 60_000, None, None, None), (None, "der und das", None, None, None)]


def test_toxicity_finds_held_out_cases(spark):
    docs, labels = corpus(900)
    df = spark.createDataFrame(docs + ODD, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels + [(labels[0][0], None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(df, marks)
    got = toxicity.score_toxicity(df, chain).collect()
    assert got[0].asDict().keys() >= {"doc_id", "text", "hashes", "p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected"}
    labelled = {i for i, *_ in labels}
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id not in labelled]
    truth = [any(b in r.text.lower() for b in BAD) for r in unseen]
    right = [t == r.rejected for t, r in zip(truth, unseen, strict=True)]
    assert len(unseen) == 450 and np.mean(right) > 0.97
    assert not any(r.rejected for r in got if r.doc_id in (90001, 90002, 90003))
    assert len({(r.p_toxic, r.rejected) for r in got if r.doc_id == 90004}) == 1
    again = toxicity.score_toxicity(df, toxicity.fit_toxicity(df.repartition(5), marks)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = corpus(30)
    df = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(df, marks.where("false"))
    assert not any(r.rejected for r in toxicity.score_toxicity(df, chain).collect())
    assert toxicity.score_toxicity(df.where("false"), chain).count() == 0


def test_later_categories_see_earlier_ones():
    rng = np.random.default_rng(3)
    a = rng.random(400) < 0.5
    hashes = [np.array([1, 7] if x else [2, 7], np.uint64) for x in a]
    labels = np.column_stack([a, a]).astype(float)
    chain = toxicity.train_chain(hashes, labels, np.arange(400) % 3, ["first", "toxic"])
    assert chain.models[1][1][0] > 0  # the weight of the first category's probability


def test_languages_are_right_on_held_out_rows(spark):
    docs, _ = corpus(900, seed=2)
    df = spark.createDataFrame(docs + ODD, SCHEMA).repartition(3)
    model = langid.fit_languages(df, ~langid.held_out())
    rows = langid.predict_languages(df, model).withColumn("held", langid.held_out()).collect()
    truth = {d[0]: ("xx", "yy", "zz")[d[0] % 3] for d in docs}
    held = [r for r in rows if r.held and r.doc_id in truth]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    odd = {r.doc_id: r for r in rows if r.doc_id not in truth}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (90001, 90002, 90003))
    assert odd[90004].lang_pred == "yy" and odd[None].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_small_tables(spark):
    df = spark.createDataFrame([(1, "abc def", "aa", "s", "h"), (2, "abc", None, "s", "h")], SCHEMA)
    one = langid.predict_languages(df, langid.fit_languages(df)).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("aa", 1.0)] * 2
    none = langid.predict_languages(df, langid.fit_languages(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict_languages(df.where("false"), langid.fit_languages(df)).count() == 0


def test_codewords_differ_widely():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else code.shape[1] // 5)


def test_every_language_is_learned(spark):
    import hashlib

    from corpusloom.llm import langid

    word = lambda n: "".join(chr(97 + b % 26) for b in hashlib.sha256(str(n).encode()).digest()[:12])
    rows = [(10 * n + k, " ".join(word((n, j)) for j in range(8)), f"l{n:03}") for n in range(203) for k in range(3 if n < 202 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df)
    assert model.languages == [f"l{n:03}" for n in range(203)]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(df, model).collect()}
    assert got[2020] == "l202" and sum(got[i] == v for i, _, v in rows) > 0.95 * len(rows)


def test_languages_equal_a_plain_decoder(spark):
    import math

    docs, _ = corpus(300, seed=5)
    docs = docs + ODD[:4] + [(90005, "¿Qué? la 12 che'l", "xx", None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(2)
    model = langid.fit_languages(df)
    plain = {}
    for i, text, *_ in docs:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip():
            plain[i] = ("und", 0.0)
            continue
        raw = (" " + " ".join(letters.split()) + " ").encode()
        total, n = [0.0] * model.code.shape[1], 0
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            three = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 16
            two = ((a * 0x27D4EB2F + b * 0x165667B1) % 2**32 ^ 0x5BD1E995) >> 16
            for slot in (three, two):
                n += 1
                for j in range(len(total)):
                    total[j] += float(model.weights[slot, j])
        margins = [t / max(1, n) + model.bias[j] for j, t in enumerate(total)]
        loss = {lang: sum(model.trust[j] * math.log1p(math.exp(-m * model.code[k, j])) for j, m in enumerate(margins)) for k, lang in enumerate(model.languages)}
        best = min(loss, key=lambda v: (loss[v], v))
        plain[i] = (best, 1 / sum(math.exp(loss[best] - v) for v in loss.values()))
        if len(raw) > 100_000:
            break  # one long text is enough
    got = {r.doc_id: r for r in langid.predict_languages(df, model).collect()}
    assert len(plain) > 300
    for i, (lang, score) in plain.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, i


def test_bits_are_trusted_by_rows_they_have_not_seen():
    rng = np.random.default_rng(0)
    x = langid.Sparse([rng.choice(langid.SLOTS, 20, replace=False) for _ in range(40)])
    y = (np.arange(40) // 2 % 2).astype(float)  # nothing to learn
    w, _, bias = langid.fit(x, np.zeros((40, 0)), y, langid.SLOTS, **langid.FIT)
    assert (((x.dot(w) + bias) > 0) == (y > 0.5)).mean() == 1.0
    assert ((langid._held_margins(x, y) > 0) == (y > 0.5)).mean() < 0.8


def test_toxicity_equals_a_plain_chain(spark):
    import math
    import re

    import xxhash

    docs, labels = corpus(400, seed=6)
    docs = docs + ODD[:3]
    df = spark.createDataFrame(docs, SCHEMA).repartition(2)
    chain = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    place = {int(h): k for k, h in enumerate(chain.columns)}
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, chain).collect()}
    for i, text, *_ in docs:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        features = words | {w[:k] + "*" for w in words for k in (4, 5, 6, 7) if len(w) >= k}
        at = {place[h] for h in (xxhash.xxh64_intdigest(f.encode()) for f in features) if h in place}
        before = []
        for model in chain.models:
            w, links, bias = model
            z = sum(float(w[k]) for k in at) + sum((p - 0.5) * float(c) for p, c in zip(before, links, strict=True)) + bias
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        for name, p in zip(chain.names, before, strict=True):
            assert abs(got[i][f"p_{name}"] - p) < 1e-4
        assert got[i].rejected == (got[i].p_toxic >= chain.threshold)


def test_the_driver_gets_no_rows_of_the_sample(spark, monkeypatch):
    seen, train = [], toxicity.train_chain

    def watched(hashes, *rest):
        seen.append(len(hashes))
        return train(hashes, *rest)

    df = spark.createDataFrame([(i, f"{'idiot scum' if i % 2 else 'kind friend'} number {i % 7}") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    want = toxicity.fit_toxicity(df, marks)
    monkeypatch.setattr(toxicity, "train_chain", watched)
    chain = toxicity.fit_toxicity(df, marks)
    assert sum(seen) == 0  # the tasks have copies of the list
    assert all(m is not None for m in chain.models[:2]) and chain.threshold == want.threshold and list(chain.columns) == list(want.columns)
    hits = {r.doc_id for r in toxicity.score_toxicity(df, chain).where("rejected").collect()}
    assert hits == set(range(1, 60, 2))
