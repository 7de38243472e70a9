"""Typed front matter, digests of tables, places of boxes."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import gates, overview, structure


def fronts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return df.select("k", structure.front_matter(F.coalesce("text", F.lit(""))).alias("front"))


def test_typed_values(spark):
    texts = [
        '---\na: 007\nb: -0\nc: -1.50\nd: Yes\ne: ~\nf: "x\\"\ng: \nh:\n- 1\n- two\n- null\n- \'3\'\ni: é "q" \\ 	t\n---\nx',
        "---\na: " + "9" * 30 + "\nb: " + "9" * 60 + "\nc: " + "9" * 400 + ".0\nk.l-m: 1\n---\n",
        "no front",
        None,
        "---\n- stray\n---\n",
    ]
    got = [r.j and json.loads(r.j) for r in structure.front_typed(fronts(spark, texts)).orderBy("k").select(F.to_json("typed").alias("j")).collect()]
    assert got[0] == {"a": 7, "b": 0, "c": -1.5, "d": True, "e": None, "f": "x\\", "g": "", "h": [1, "two", None, "3"], "i": 'é "q" \\ \tt'}
    assert got[1] == {"a": int("9" * 30), "b": 1e60, "c": "9" * 400 + ".0", "k.l-m": 1}
    assert got[2:] == [None, None, None]


def test_one_schema_over_all_files(spark):
    texts = ["---\na: 1\nb: x\nd:\n- 1\n---\n", "---\na: 2\nb: 3\nc: ~\n---\n", "---\na: ~\nd:\n- 2\n- 3\n---\n"]
    got = {r.key: (r.type, r.files) for r in structure.front_schema(fronts(spark, texts)).collect()}
    assert got == {"a": ("BIGINT", 3), "b": ("VARIANT", 2), "c": ("VOID", 1), "d": ("ARRAY<BIGINT>", 2)}
    assert structure.front_schema(fronts(spark, [])).count() == 0


def test_digests_follow_rows_not_their_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (None, "b")]
    made = lambda r: gates.digest(spark.createDataFrame(r, "x int, y string").repartition(3), "x", "y").first()
    assert made(rows) == made(rows[::-1])
    for other in (rows[:3], rows[:3] + [(None, "c")], [(1, "a"), (2, None), (None, "b"), (None, "b")], [(1, None), (2, "a"), (2, None), (None, "b")]):
        assert made(rows) != made(other)
    assert made([]).n == 0 and made([]) == made([])


def test_compared_repairs(spark):
    empty = "slug string, html string, changed boolean", "slug string, ord int, text string", "bucket string, kind string, slug string, item string"
    run = lambda html, changed: gates.Reconciled(*(spark.createDataFrame(r, s) for r, s in zip(([("a", html, changed)], [], [("genuine_gaps", "anchors", "a", "#x")]), empty, strict=True)))
    same = {r.part: (r.n_rows, r.n_changed, r.equal) for r in gates.compare(run("h", True), run("h", False)).collect()}
    assert same == {"fragments": (1, 0, True), "contracts": (0, 0, True), "genuine_gaps": (1, 0, True)}
    other = {r.part: (r.n_rows, r.n_changed, r.equal) for r in gates.compare(run("h", True), run("i", True)).collect()}
    assert other["fragments"] == (1, 1, False) and other["genuine_gaps"] == (1, 0, True)


def test_boxes_of_several_graphs(spark):
    rows = [("g", "a", 0, 0), ("g", "b", 1, 0), ("g", "c", 1, 1), ("h", "d", 0, 0), (None, "e", 0, 0), (None, "f", 0, 1)]
    got = {r.slug: (r.width, r.height, r.x, r.y) for r in overview.geometry(spark.createDataFrame(rows, "graph_id string, slug string, layer int, index int")).collect()}
    two, one = 2 * 184 + 30 + 48, 184 + 48
    assert got == {"a": (two, 208, 131.0, 24.0), "b": (two, 208, 24.0, 136.0), "c": (two, 208, 238.0, 136.0), "d": (one, 96, 24.0, 24.0), "e": (two, 96, 24.0, 24.0), "f": (two, 96, 238.0, 24.0)}
