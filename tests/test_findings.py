"""Findings: their order, groups, and links to sections."""

from pyspark.sql import functions as F

from corpusloom.operators import overview


def linked(spark, rows, ids):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    return [r.html for r in overview.linkify(df, ids).orderBy("k").collect()]


def test_ids_are_linked_whatever_their_number(spark):
    many = spark.range(1_000_001).select(F.concat(F.lit("f--s"), "id").alias("id"), F.concat(F.lit("<T"), "id", F.lit(">")).alias("title"))
    texts = ["see f--s12 & f--s1000000, f--s9999999", None, "f--", "f--s12"]
    link = lambda n: f'<a href="#f--s{n}">&lt;T{n}&gt;</a>'
    assert linked(spark, texts, many) == [f"see {link(12)} &amp; {link(1000000)}, {link(999999)}9", "", "f--", link(12)]
    assert linked(spark, texts[:1], many.where("false")) == ["see f--s12 &amp; f--s1000000, f--s9999999"]


def test_linking_against_one_alternation_of_all_ids(spark):
    """Ids that begin with or hold others, anchors with hyphens in a row, slugs that end others."""
    import html
    import random
    import re

    ids = {i: f"<{i}>" for i in ("a--b", "a--b-c", "a--b--c", "c--a", "b-c--a", "a--", "a---b", "ab--é x", "b--é", "c--a--b", "x-y--file", "y--file")}
    known = re.compile("|".join(re.escape(i) for i in sorted(ids, key=lambda i: -len(i))))
    draw = random.Random(6)
    texts = ["".join(draw.choice(["a", "b", "c", "-", "--", "é", " x", "x-y", "file", "&", "---"]) for _ in range(draw.randint(0, 14))) for _ in range(1500)]

    def plain(text):
        out, at = [], 0
        for m in known.finditer(text):
            out += [html.escape(text[at : m.start()]), f'<a href="#{html.escape(m[0])}">{html.escape(ids[m[0]])}</a>']
            at = m.end()
        return "".join([*out, html.escape(text[at:])])

    assert linked(spark, texts, spark.createDataFrame(list(ids.items()), "id string, title string")) == [plain(t) for t in texts]


def test_candidates_of_links_grow_with_the_texts(spark):
    """No more rows than characters, at two sizes, however many ids there are."""
    ids = spark.range(2000).select(F.concat(F.lit("s"), "id", F.lit("--file")).alias("id"), F.col("id").cast("string").alias("title"))
    for n in (20, 200):
        text = " ".join(f"see s{i}--file and more" for i in range(n))
        out = overview.linkify(spark.createDataFrame([(0, text)], "k int, text string"), ids)
        assert out.first().html.count("<a href") == n
        plan = out._jdf.queryExecution().executedPlan()
        assert re_rows(plan) <= len(text)


def re_rows(plan):
    """Most rows that a generator of the plan that ran has made."""
    most, stack = 0, [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "GenerateExec":
            most = max(most, node.metrics().get("numOutputRows").get().value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        stack += inner + [children.apply(i) for i in range(children.size())]
    return most


def test_findings_in_groups(spark):
    files = spark.createDataFrame([("a", "a.md", "A"), ("b", "b.md", "")], "slug string, file_path string, title string")
    headings = spark.createDataFrame([("a", "a--x", "x", "", 0), ("a", "a--file", "file", "Mine", 1)], "slug string, id string, anchor string, text string, pos int")
    claim = "array<struct<file:string,claim:string>>"
    rows = [
        (0, "zeta", "low", ["a", ""], "z", None, None), (1, "coverage", "odd", None, "c", "a--file", [("a", "one"), ("b", "  ")]), (2, "coverage", "high", ["b", "gone"], "h", "", [("a", "a--x"), (None, "<2>")]),
        (3, None, None, ["a"], None, "b--file", [("a", "alone")]), (4, "contradiction", "medium", [], "m", "", []), (5, "coverage", "high", [], "i", "", None),
    ]
    findings = spark.createDataFrame(rows, f"ord long, type string, severity string, files array<string>, title string, description string, claims {claim}")
    cards = [r.html for r in overview.findings_zone(findings, files, headings).orderBy("ord").collect()]
    assert [c.split("<h3>")[1][0] for c in cards] == ["m", "h", "i", "c", "<", "z"]
    assert [c.count('<div class="mdhv-findings-group"') for c in cards] == [1, 1, 0, 0, 1, 1] and [c.endswith("</article></div>") for c in cards] == [True, False, False, True, True, True]
    assert '<a class="mdhv-node" href="#b--file">b</a><a class="mdhv-node" href="#gone--file">gone</a>' in cards[1]
    assert '<p><a href="#a--x">x</a></p>' in cards[1] and '<span class="mdhv-node"></span></span><p>&lt;2&gt;</p>' in cards[1]
    assert "finding-compare" not in cards[3] and '<a href="#a--file">Mine</a>' in cards[3] and "mdhv-severity-odd" in cards[3]
    assert "mdhv-severity-low" in cards[4] and '<a href="#b--file">b</a>' in cards[4] and 'data-type="other"' in cards[4]


def test_numbers_in_order(spark):
    from corpusloom.functions.ranks import numbered

    df = spark.range(1000).select(F.hash("id").alias("h"), "id").repartition(7)
    got = numbered(df, [F.col("h").desc(), F.col("id")], "n", ranges=5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == [r.id for r in sorted(got, key=lambda r: (-r.h, r.id))] and sorted(r.n for r in got) == list(range(1000))
    assert numbered(df.where("false"), [F.col("id")], "n").collect() == []
