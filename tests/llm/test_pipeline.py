from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import decontaminate, pii, sharding, toxicity
from test_classifiers import BAD, SCHEMA, corpus
from test_decontaminate import brute as leaks
from test_jaccard import brute as linked
from test_mixing import brute as mixed

ITEMS = [(0, "a passage of one benchmark item that nobody else would ever write down in these very words"), (1, "another item with words of its own and some more of them to fill the line")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus(240)
    near = docs[1][1] + " one more word"
    leak = " ".join(f"fresh{k}" for k in range(30)) + " " + ITEMS[0][1].title()
    docs += [(1000, docs[0][1], "xx", "s0", None), (1001, near, "yy", "s1", None), (1002, leak, "yy", None, None), (1003, None, None, "s9", None), (1004, "", "yy", "s9", None), (None, "no id here but words", None, "s2", None)]
    docs += [docs[7], docs[7]]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
        ids = Counter(r.doc_id for r in after)
        if name == "toxicity":
            gone = Counter(i for i, _, _ in before) - ids
            assert gone and all(any(b in (t or "").lower() for b in BAD) for i, t, _ in before if i in gone)
        elif name == "ngram_jaccard_join":
            want = {i for i, _, c in linked([(i, t) for i, t, _ in before]) if i is None or i == c}
            assert set(ids) == want and max(ids.values()) == 1
        elif name == "benchmark_decontamination":
            gone = {i for i, _ in leaks([(i, t) for i, t, _ in before], ITEMS)}
            assert 1002 in gone and ids == Counter(i for i, _, _ in before if i not in gone)
        elif name == "source_mixing":
            want = Counter()
            for (i, size, _, _, taken), n in mixed(before, quality).items():
                want[i] += n * (taken // size if size else 0)
            assert ids == +want
        else:
            assert ids == Counter(i for i, _, _ in before)
            counts = Counter(r.shard for r in after)
            assert max(counts.values()) - min(counts.values()) <= 1


def test_run_is_the_stages_in_order(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_native_operators_run_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for df in (pii.find_pii(docs), sharding.assign_shards(docs), decontaminate.contaminated(docs, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.op1_toxicity(spark, str(tmp_path)).count() == 0


def test_rows_of_null_and_repeated_ids_are_judged_by_their_own_texts(spark, sf_dir):
    words = lambda tag, n=30: " ".join(f"{tag}{k}" for k in range(n))
    leak = words("p") + " " + ITEMS[0][1]
    rows = [
        (1, words("a"), "s", 0, "x", 5), (2, words("a") + " more", "s", 0, "x", 5),  # near copies
        (3, words("b"), "s", 0, "x", 5), (3, words("c"), "s", 0, "x", 5), (4, words("c"), "s", 0, "x", 5),  # two texts under one id
        (None, words("d"), "s", 0, "x", 5), (None, words("d") + " more", "s", 0, "x", 5), (None, words("a"), "s", 0, "x", 5),
        (None, None, "s", 0, "x", 5), (None, None, "s", 0, "x", 5), (None, " \n", "s", 0, "x", 5), (6, None, "s", 0, "x", 5), (6, None, "s", 0, "x", 5), (7, "", "s", 0, "x", 5),
        (None, leak, "s", 0, "x", 5), (9, leak, "s", 0, "x", 5), (9, words("e"), "s", 0, "x", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row int, __gone string, __copy long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = Counter((r[0], r[1]) for r in kept.collect())
    nulls = [t for i, t in got if i is None and t and t.startswith("d0")]
    assert len(nulls) == 1 and got[None, nulls[0]] == 1
    blank = {(None, None): 2, (None, " \n"): 1, (6, None): 1, (7, ""): 1}
    assert got == Counter({(1, words("a")): 1, (3, words("b")): 1, (3, words("c")): 1, (None, nulls[0]): 1, (9, leak): 1, (9, words("e")): 1, **blank})
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert Counter((r[0], r[1]) for r in clean.collect()) == Counter((r[0], r[1]) for r in rows if r[1] != leak)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mix_sources):
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.shard(spark, docs, sf_dir).count() == len(rows)


def test_native_operators_write_no_table_through_python(spark, sf_dir, monkeypatch):
    from corpusloom.llm import common

    plans, cut = [], common.Scratch.cut
    monkeypatch.setattr(common.Scratch, "cut", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(self, df))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.assign_shards(docs)
    decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert len(plans) > 5 and not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow"))
