"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, jaccard, langid, mixing, pii, repeats, sharding, simhash, toxicity, urls

LONG = " ".join(f"word{i % 9973} of{i}" for i in range(60_000))
LONG_WORDS = LONG.split()
PASSAGE = " ".join(f"passage{i}" for i in range(80))
#: (doc_id, text, lang, source)
ROWS = [
    (None, None, None, None), (None, "a text of no id", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, "", "en", None),
    (4, LONG, "en", "a"), (4, LONG, "en", "a"), (5, LONG + " end", "de", "b"), (6, PASSAGE, "de", "b"), (7, "x " + PASSAGE, None, "b"),
    (8, PASSAGE, "fr", "c"), (9, " \t\x0b ", "fr", "c"), (10, "été 😀 10.0.0.1 a@b.org", "fr", "c"), (2**62, "A b", "en", "c"), (-5, "a B", "en", "c"),
]
#: Names that the operators use within.
CLASHES = ("row", "grp", "size", "shard", "slot", "key", "h", "mark", "bag", "part", "halo", "component_id", "n_shingles", "fit", "rejected", "__b", "__w", "__row", "__n", "__copy", "copies", "item", "start", "base", "all", "fingerprint")
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    wide = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], ", ".join([COLUMNS, *(f"`{c}` string" for c in CLASHES)]))
    return wide.repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (10, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (None, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (4, " ".join(LONG.split()[500:560]), "x"), (4, "short one", None)], "item_id long, text string, doc_id string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


IDS = Counter(r[0] for r in ROWS)
SIZES = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)


def test_toxicity(docs, labels):
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == IDS and all(r.rejected in (True, False) for r in got)


def test_samples_are_bounded(spark, monkeypatch):
    """One id, or none, that holds most rows fills no sample beyond its bound."""
    rows = [(None if i % 3 else 7, f"{'la casa' if i % 2 else 'the house'} {''.join(chr(97 + int(c)) for c in str(i))}", "es" if i % 2 else "en") for i in range(3000)] + [(9, "the same", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sizes, fit, train = [], langid.Sparse, toxicity.train_chain
    monkeypatch.setattr(langid, "Sparse", lambda rows, *a: (sizes.append(len(rows)), fit(rows, *a))[1])
    assert langid.fit_languages(docs, per_language=100).languages == ["en", "es"]
    assert 50 < sizes[0] < 300
    monkeypatch.setattr(toxicity, "train_chain", lambda hashes, *a: (sizes.append(len(hashes)), train(hashes, *a))[1])
    marks = spark.createDataFrame([(7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    toxicity.fit_toxicity(docs, marks, sample_rows=100)
    assert 1 <= sizes[-1] <= 300


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs).documents.collect()}
    assert {i: got[i].component_id for i in (4, 5, 6, 7, 8, 1, 2, 3, 9)} == {4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 1: 1, 2: 2, 3: 3, 9: 9}
    assert (got[1].n_shingles, got[9].n_shingles, got[6].n_shingles) == (0, 0, 76)
    assert got[4].n_shingles == len({tuple(LONG_WORDS[k : k + 5]) for k in range(len(LONG_WORDS) - 4)})
    assert {got[2**62].component_id, got[-5].component_id} == {-5}  # equal once lower-cased


def test_sharding(docs):
    got = sharding.assign_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == SIZES
    assert all(n == 1 for n in Counter(r.shard for r in got).values()) and all(r.slot == 0 for r in got)


def test_fingerprints(docs):
    got = simhash.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, *_ in ROWS)
    mark = {r.doc_id: r.fingerprint for r in got if r.doc_id is not None}
    assert mark[6] == mark[8] and mark[1] == mark[2] == mark[9] == "0" * 32 and mark[4] != mark[6]
    # in descending order of ids, 5 is followed by 4, whose text is the other's but for its end
    five = next(r for r in got if r.doc_id == 5)
    half = len(LONG + " end") // 2
    assert five.edited_sha256 == hashlib.sha256(((LONG + " end")[: len(LONG) + 4 - half] + LONG[:half]).encode()).hexdigest()
    assert five.near_next > 0.99


def test_repeats(docs):
    got = repeats.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    at = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (at[1].n_bytes, at[1].n_removed, at[1].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert (at[4].n_removed, at[5].n_removed, at[6].n_removed) == (len(LONG), len(LONG), len(PASSAGE))
    assert at[7].kept_sha256 == hashlib.sha256(b"x ").hexdigest() and at[7].n_spans == 1
    assert [at[i].shares_passage for i in (1, 4, 5, 6, 7, 10)] == [False, True, True, True, True, False]


def test_language(docs):
    got = langid.predict_languages(docs, langid.fit_languages(docs)).collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 9)} == {1: "und", 2: "und", 9: "und"}
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in got)


def test_decontamination(docs, benchmark):
    got = sorted(((r.doc_id, r.item_id or 0) for r in decontaminate.contaminated(docs, benchmark).collect()))
    assert got == [(4, 4), (5, 4), (6, 0), (6, 1), (7, 0), (7, 1), (8, 0), (8, 1)]


def test_urls(spark):
    path = "/p" * 200_000
    rules = (("allow", "b.org", "/a"), ("block", "a.b.org", "/"), ("block", "org", "/a/b/c"))
    pages = [(1, "http://A.B.ORG/ab", "<p>"), (1, "http://A.B.ORG/ab", "<p>"), (2, "http://b.org" + path, "<a href=//a.b.org/>" * 50_000), (None, "http://b.org/a", None), (3, None, None), (4, "://", ""), (5, "http://x.b.org/a/b/cd", None)]
    df = spark.createDataFrame([(*p, "x", "x", "x") for p in pages], "page_id long, url string, html string, host string, rule string, weight string")
    got = sorted(urls.judge(df, rules).collect(), key=lambda r: r.page_id or 0)
    # a.b.org/ has more characters than b.org/a; of org/a/b/c and the others the longest, too
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in got if r.page_id != 2] == [
        (None, "b.org", "b.org/a", "allow"), (1, "a.b.org", "a.b.org/", "block"), (1, "a.b.org", "a.b.org/", "block"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "x.b.org", "org/a/b/c", "block"),
    ]
    long = next(r for r in got if r.page_id == 2)
    assert (long.host, long.path, long.rule) == ("b.org", path, None) and long.distrust > 0


def test_rules_of_equal_length(spark):
    """Of rules of one length that fit, the one that is later by code points decides."""
    rules = (("block", "a.org", "/x"), ("allow", "org", "/x/y"))
    got = spark.createDataFrame([("a.org", "/x/y")], "h string, p string")
    assert got.select(urls.rule_for(got.h, got.p, rules).alias("r")).first().r.rule == "org/x/y"
    tie = (("block", "a.org", "/x"), ("allow", "a.org", "/"), ("allow", "org", "/x/z"))
    assert got.select(urls.rule_for(got.h, got.p, tie).alias("r")).first().r.rule == "a.org/x"


def test_mixing(docs, labels):
    got = mixing.mix(docs, labels.select("doc_id", "quality")).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    assert next(r for r in got if r.doc_id == 3).source is None
    assert mixing.mixed_documents(docs, labels.select("doc_id", "quality")).columns == docs.columns


def test_pii(docs):
    got = pii.find_pii(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in got}
    assert found[10] == [("ip", 6, 14), ("email", 15, 22)] and found[4] == found[1] == []


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, labels, benchmark, stage, tmp_path):
    name, function = stage
    for table, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    out = function(spark, docs, str(tmp_path))
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    if name != "sharding":
        assert out.columns == docs.columns
    none = function(spark, docs.where("false"), str(tmp_path))
    assert none.count() == 0
    if name == "ngram_jaccard_join":  # rows without words are linked with nothing
        assert ids == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 9: 1, 10: 1, -5: 1})
    if name == "benchmark_decontamination":
        assert ids == Counter({i: n for i, n in IDS.items() if i not in (4, 5, 6, 7, 8)})
    if name == "sharding":
        assert ids == IDS
