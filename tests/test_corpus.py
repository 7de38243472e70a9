import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.operators import gates, graph, overview, scope, structure
from corpusloom.sources import corpus as disk
from corpusloom.sources import session
from corpusloom.streaming import incremental

FILES = {
    "skills/auth.md": "---\nname: auth\ncount: 007\nok: yes\nnone: ~\npi: 3.50\nquoted: '5'\ntags:\n- a\n- 2\nname: last\n---\n# Auth `skill`\n[t](../refs/tokens.md) `refs/tokens.md` `sess-ion`\n## Overview\n## Overview\n## Overview\n",
    "refs/tokens.md": "# Tokens\n```\n# not a heading\n~~~\n```\n## After\n[a](http://x.y) [i](p.png \"T\") [m](mailto:a@b) [up](../../x.md) `src/x.py` `auth.md`\n",
    "other/sess-ion.md": "Привет, мир! no headings at all",
    "other/use.md": "# Use\n[s](./tokens.md) [own](use.md) `skills/auth.md`\n",
    "a/foo-bar.md": "x", "a/foo!bar.md": "# A\r\n# A\r# A-1", "README.md": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    return structure.parse(spark.createDataFrame(list(FILES.items()), "file_path string, text string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_slugs_titles_languages(parsed):
    got = {r.file_path: (r.slug, r.title, r.language, r.token_estimate) for r in parsed.files.collect()}
    assert got["a/foo!bar.md"][0] == "a-foo-bar-1" and got["a/foo-bar.md"][:2] == ("a-foo-bar-2", "Foo bar")
    assert got["skills/auth.md"][:2] == ("skills-auth", "Auth skill")
    assert got["other/sess-ion.md"][1:3] == ("Sess ion", "ru") and got["README.md"][1:] == ("README", "en", 1)


def test_headings_and_fences(parsed):
    assert [r[1] for r in rows(parsed.headings.where("slug = 'skills-auth'"), "pos", "anchor")] == ["auth-skill", "overview", "overview-1", "overview-2"]
    assert [r[1] for r in rows(parsed.headings.where("slug = 'refs-tokens'"), "pos", "text")] == ["Tokens", "After"]
    assert [r[1] for r in rows(parsed.headings.where("slug = 'a-foo-bar-1'"), "pos", "anchor")] == ["a", "a-1", "a-1"]


def test_front_matter(parsed):
    got = {r.key: (r.kind, r.value) for r in structure.front_rows(parsed.files).collect()}
    assert got == {"name": ("string", "last"), "count": ("int", "7"), "ok": ("bool", "true"), "none": ("null", None), "pi": ("float", "3.5"), "quoted": ("string", "5"), "tags": ("list", "a,2")}


def test_links(parsed):
    got = rows(parsed.links.where("slug = 'refs-tokens'"), "pos", "target", "type")
    assert [g[1:] for g in got] == [("http://x.y", "external_url"), ("p.png", "other"), ("mailto:a@b", "other"), ("../../x.md", "other"), ("src/x.py", "code_ref"), ("refs/auth.md", "md_ref")]
    assert rows(parsed.tokens, "slug", "token") == [("skills-auth", "sess-ion")]


def test_edges(parsed):
    assert rows(graph.edges_of(parsed), "from", "to", "strength", "reason") == [
        ("other-use", "refs-tokens", "weak", "name match: 'tokens' (tentative)"),
        ("other-use", "skills-auth", "strong", "inline reference"),
        ("refs-tokens", "skills-auth", "weak", "inline name match: 'auth' (tentative)"),
        ("skills-auth", "other-sess-ion", "weak", "bare-name match: 'sess-ion' (tentative)"),
        ("skills-auth", "refs-tokens", "strong", "direct relative link"),
    ]
    resolved = graph.resolve(parsed.links, parsed.files)
    assert ("other-use", "[own](use.md)", "other-use") in [tuple(r) for r in resolved.select("slug", "raw", "resolved_slug").collect()]


def test_layout_of_cycles_and_chains():
    placed = {s: (k, i) for s, k, i in graph._arrange(["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])}
    assert {s: p[0] for s, p in placed.items()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert graph._arrange([], []) == []


@pytest.mark.parametrize("path,want", [("a/./b//../c.md", "a/c.md"), ("../x.md", "../x.md"), ("a/../..", ".."), (".", "."), ("/../x", "/x"), ("a/..", ".")])
def test_normalize_path(spark, path, want):
    assert spark.range(1).select(T.normalize_path(F.lit(path))).first()[0] == want


@pytest.mark.parametrize(
    "needle,hay,want",
    [("must expire after 3600", "tokens must expire after 3600 seconds", True), ("gamma beta", "alpha beta gamma delta", False), ("art", "the start", True), ("", "x", True), ("alpha omega", "alpha " + "x " * 60 + "omega", False), ("a c e", "a b c d e", True), ("a", "", False)],
)
def test_contract_present(spark, needle, hay, want):
    assert spark.range(1).select(T.contract_present(F.lit(needle), F.lit(hay))).first()[0] is want
    if needle:
        assert gates._present(needle, hay) is want


def test_normalize(spark):
    texts = ["  do   <code>NOT</code>\n  use &amp; &lt;x&gt; ", "a <code>b</code> c", "a &lt;b&gt; c", "École muted_keyword²", None]
    got = H.with_normalized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "w").orderBy("i").collect()
    assert [r.w for r in got] == ["do not use x", "a b c", "a b c", "école muted keyword²", None]


def test_html_facets(spark):
    body = '<p class="mdhv-contract x">a<br>b <b class="mdhv-contract">c</b></p><code>&lt;a href="#no"&gt;</code><A href="#yes&amp;1">t</A><!-- <a href="#c"> --><script>"<a href=\'#s\'>"</script><a href="http://x">'
    found = H.html_facets(spark.createDataFrame([("a", body)], "slug string, html string"))
    assert rows(found, "slug", "kind", "ord", "value") == [("a", "contract", 0, "a b c "), ("a", "href", 0, "#yes&1")]


def session_tables(spark, parsed):
    fragments = spark.createDataFrame([("skills-auth", '<section id="s1" data-src-heading="skills-auth--auth-skill"><a href="#gone">x</a><a href="#">y</a><a href="#mdhv-toc">z</a></section>'), ("refs-tokens", "<p>none</p>")], "slug string, html string")
    sections = spark.createDataFrame([("skills-auth", 1, "s2", ["overview"]), ("skills-auth", 0, "s1", ["overview"])], "slug string, ord int, id string, source_headings array<string>")
    contracts = spark.createDataFrame([("skills-auth", 0, "Auth <b>skill</b>"), ("skills-auth", 1, "auth skill"), ("skills-auth", 2, "never said"), ("skills-auth", 3, "")], "slug string, ord int, text string")
    sources = spark.createDataFrame([("skills-auth", FILES["skills/auth.md"]), ("refs-tokens", FILES["refs/tokens.md"])], "slug string, text string")
    return fragments, sections, contracts, sources


def test_gates_and_reconcile(spark, parsed):
    fragments, sections, contracts, sources = session_tables(spark, parsed)
    some = parsed.files.where("slug in ('skills-auth', 'refs-tokens')")
    heads = parsed.headings.join(some.select("slug"), "slug", "left_semi")
    assert rows(gates.dangling_anchors(some, heads, fragments), "slug", "href") == [("skills-auth", "#gone")]
    assert ("refs-tokens", "refs-tokens--after") in rows(gates.coverage_gaps(some, heads, fragments), "slug", "id")
    assert rows(gates.contract_violations(contracts, sources, fragments), "ord", "missing_in") == [(0, "fragment"), (1, "fragment"), (2, "source")]
    done = gates.reconcile(some, heads, fragments, sections, contracts, sources)
    report = rows(done.report.where("slug = 'skills-auth'"), "bucket", "kind", "item")
    assert report == sorted([
        ("auto_closed", "coverage", "skills-auth--overview"), ("genuine_gaps", "coverage", "skills-auth--overview-1"), ("genuine_gaps", "coverage", "skills-auth--overview-2"),
        ("auto_closed", "contracts", "auth skill"), ("auto_closed", "duplicate", "auth skill"), ("genuine_gaps", "contracts", "never said"), ("genuine_gaps", "anchors", "#gone"),
    ])
    fixed = {r.slug: r.html for r in done.fragments.collect()}["skills-auth"]
    assert fixed.startswith('<section id="s1" data-src-heading="skills-auth--auth-skill"><span id="skills-auth--overview"')
    assert fixed.endswith('<div class="mdhv-contract">Auth &lt;b&gt;skill&lt;/b&gt;</div>')
    again = gates.reconcile(some, heads, done.fragments.select("slug", "html"), sections, done.contracts, sources)
    assert again.fragments.where("changed").count() == 0 and again.report.where("bucket = 'auto_closed'").count() == 0


def test_selection(spark, parsed):
    assert {r.slug for r in scope.select_files(parsed.files, "other, README.md ,a/*!*.md,skills-auth").collect()} == {"other-sess-ion", "other-use", "readme", "a-foo-bar-1", "skills-auth"}
    assert scope.select_files(parsed.files, "all").count() == len(FILES)
    for bad in ("", " , ", "nothing-here"):
        with pytest.raises(ValueError):
            scope.select_files(parsed.files, bad)
    lines = [r.line for r in scope.menu(parsed.files).collect()]
    assert lines[0] == "## . — 1 file — ~1 tokens (estimate)" and lines[1] == "- readme — README — ~1 tokens"


def findings(spark):
    kind = "ord long, type string, severity string, files array<string>, title string, description string, claims array<struct<file:string,claim:string>>"
    return spark.createDataFrame([
        (0, "zeta", "low", ["skills-auth", "skills-auth", ""], "t0", "see skills-auth--overview-1 & skills-auth--overview", None),
        (1, "contradiction", "odd", ["nowhere"], "<t1>", None, [("skills-auth", "one"), ("nowhere", "two")]),
        (2, "contradiction", "high", ["skills-auth", "refs-tokens"], "t2", "d", [("skills-auth", "alone")]),
    ], kind)


def test_page(spark, parsed):
    fragments = session_tables(spark, parsed)[0]
    parts = overview.page_parts(parsed.files, parsed.headings, graph.edges_of(parsed), findings(spark), fragments)
    page = overview.write_page(parts, overview.default_shell())
    assert page == overview.write_page(parts, overview.default_shell())
    assert page.index("t2") < page.index("&lt;t1&gt;") < page.index("t0")
    assert '<a href="#skills-auth--overview-1">Overview</a> &amp; <a href="#skills-auth--overview">Overview</a>' in page
    assert page.count("mdhv-finding-claim-file") == 2 and "in 2 findings" in page and "in 1 finding<" in page
    assert "7 files · 2 strong cross-references · 0 hub(s) · 3 isolated" in page
    assert rows(overview.findings_per_file(findings(spark)), "slug", "findings") == [("nowhere", 1), ("refs-tokens", 1), ("skills-auth", 2)]
    with pytest.raises(ValueError):
        overview.write_page(parts, "<html></html>")


def test_remote_resources(spark):
    docs = spark.createDataFrame([(1, '<LINK rel=x href="a"><img alt=b src = \'https://x\'><a href="//y"><style>@import url("http://z")</style>'), (2, "plain <a href='http://ok'>")], "i int, d string")
    got = [r.label for r in gates.external_fetches(docs, "i", "d").collect()]
    assert got == ["external <link href> tag", "<script>/<img> with http(s) src", "@import of a remote url", "url(http...) in styles", "protocol-relative resource url"]


def test_disk_corpus_and_session(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    for hidden in (".git", ".github", "node_modules"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "x.MD").write_text("# x")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    corpus, skipped = disk.read_corpus(spark, str(tmp_path))
    assert {r.file_path for r in corpus.collect()} == {*FILES, ".github/x.MD"}
    assert [r.file_path for r in skipped.collect()] == ["bad.md"]
    with pytest.raises(ValueError):
        disk.read_corpus(spark, str(tmp_path / "missing"))

    now = datetime.datetime(2024, 1, 2, 3, 4, tzinfo=datetime.timezone.utc)
    entries = {"files": [{"file_path": "skills/auth.md", "slug": "skills-auth", "token_estimate": 3}]}
    path, other = (session.create(str(tmp_path), entries, now=now) for _ in range(2))
    assert other == f"{path}_2"
    s = structure.parse(corpus)
    chosen = scope.select_files(s.files, "skills-auth")
    files = scope.scope_files(s.files, chosen)
    links = scope.scope_links(graph.resolve(s.links, s.files), chosen)
    session.write_structure(path, {"root": "."}, files, files.select("slug", "title", "file_path"), scope.scope_edges(graph.edges_of(s), chosen), scope.slices(files, s.headings, links))
    written = json.load(open(os.path.join(path, "structure.json")))
    assert written["meta"]["file_count"] == 1 and written["graph"]["edges"] == []
    part = json.load(open(os.path.join(path, "slices", "skills-auth.json")))
    assert [h["anchor"] for h in part["headings"]][:2] == ["auth-skill", "overview"] and "resolved_slug" not in part["links"][0]
    assert session.validate(spark, path) == {"ok": False, "missing_fragments": ["skills-auth"], "unparsable_analysis": ["skills-auth"], "bad_findings": False}
    open(os.path.join(path, "fragments", "skills-auth.html"), "w").write("<p>x</p>")
    open(os.path.join(path, "analysis", "skills-auth.json"), "w").write('{"tldr": "t", "sections": [], "contracts": [{"text": "a"}]}')
    open(os.path.join(path, "findings.json"), "w").write('{"cross_file_findings": [{"type": "coverage", "files": ["skills-auth"]}]}')
    assert session.validate(spark, path)["ok"]
    assert session.read_analyses(spark, path).first().slug == "skills-auth"
    assert session.read_findings(spark, path).first().type == "coverage"
    session.mark(path, "render", "done", ["n=1=2"])
    assert session.manifest(path)["steps"]["render"] == {"status": "done", "n": "1=2"}
    for bad in (("nope", "done", []), ("render", "maybe", []), ("render", "done", ["x"])):
        with pytest.raises(ValueError):
            session.mark(path, *bad)
    with pytest.raises(ValueError):
        session.selection([{"slug": "x"}])


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    os.makedirs(folder)
    for k, text in enumerate(("# One\n[a](b.md)", "# Two")):
        open(os.path.join(folder, f"f{k}.md"), "w").write(text)
        incremental.write_stream(incremental.parsed_stream(incremental.read_stream(spark, folder)), out, mark).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["One", "Two"]


def test_layout_is_over_all_edges(spark):
    from corpusloom.plans import queries, registry

    sf = "/root/testdata/sf0.001"
    edges = graph.edges_of(registry.kept(spark, sf)).collect()
    out_of = {e[k]: set() for e in edges for k in ("from", "to")}
    for e in edges:
        out_of[e["from"]].add(e["to"])
    assert {e["from"] for e in edges if e["strength"] == "weak"}
    state, forward, layers = {}, {s: [] for s in out_of}, {}

    def walk(s):
        state[s] = 1
        for t in sorted(out_of[s]):
            if state.get(t) != 1:
                forward[s].append(t)
                if t not in state:
                    walk(t)
        state[s] = 2

    for s in sorted(out_of):
        if s not in state:
            walk(s)

    def layer(s):
        if s not in layers:
            layers[s] = max((layer(r) + 1 for r in out_of if s in forward[r]), default=0)
        return layers[s]

    want = {s: layer(s) for s in out_of}
    assert {r["slug"]: r["layer"] for r in queries.barycenter_order(spark, sf).collect()} == want
    assert {r["slug"]: r["layer"] for r in queries.all_layers(spark, sf).collect()} == want
    strong = graph.edges_of(registry.kept(spark, sf)).where("strength = 'strong'")
    assert {r["slug"]: r["layer"] for r in graph.diagram(strong).collect()} != want


def test_places_in_layers_against_plain_sweeps():
    import random

    for seed in range(30):
        rnd = random.Random(seed)
        nodes = [f"n{i:02d}" for i in range(rnd.randint(1, 14))]
        pairs = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randint(0, 30))]
        got = graph._arrange(nodes, pairs)
        layer = {s: k for s, k, _ in got}
        order = {k: sorted(s for s in nodes if layer[s] == k) for k in range(max(layer.values()) + 1)}
        links = {frozenset(p) for p in pairs if p[0] != p[1]}
        for _ in range(3):
            for k, other in [(k, k - 1) for k in range(1, len(order))] + [(k, k + 1) for k in range(len(order) - 2, -1, -1)]:
                def centre(s, k=k, other=other):
                    found = [i for i, t in enumerate(order[other]) if frozenset((s, t)) in links]
                    return sum(found) / len(found) if found else order[k].index(s)

                order[k] = sorted(order[k], key=lambda s: (centre(s), s))
        assert got == [(s, k, i) for k in sorted(order) for i, s in enumerate(order[k])]


def test_edges_with_absent_ends_are_not_drawn(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "gone"), ("gone", "a"), ("c", "c")], "from string, to string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    assert rows(graph.diagram(edges, nodes=nodes), "slug", "layer", "index") == [("a", 0, 0), ("b", 1, 0), ("c", 0, 1)]
    with pytest.raises(ValueError):
        graph.longest_layers(spark.createDataFrame([("a", "b"), ("b", "a"), ("z", "a")], "from string, to string"))


@pytest.mark.parametrize(
    ("body", "section", "want"),
    [
        ("<p id='s'>x</p>", "s", "<p id='s'>#x</p>"),
        ("<p id='s'>x</p><b id=\"s\" class=c>y", "s", "<p id='s'>x</p><b id=\"s\" class=c>#y"),
        ('<p id="s.">a<p id="s+">b', "s+", '<p id="s.">a<p id="s+">#b'),
        ('<p id="s"', "s", '<p id="s"#'),
        ("$1 \\\\ x", "s", "$1 \\\\ x#"),
        ("", "s", "#"),
    ],
)
def test_spans_of_closed_headings(spark, body, section, want):
    df = spark.createDataFrame([(body, [("a&b", section)])], "body string, ids array<struct<id:string,section_id:string>>")
    span = '<span id="a&amp;b" data-src-heading="a&amp;b" aria-hidden="true"></span>'
    assert df.select(gates.closed(F.col("body"), F.col("ids"))).first()[0] == want.replace("#", span)


def test_publishing_only_when_all_gates_pass(spark, parsed, tmp_path):
    parts_of = lambda fragments: overview.page_parts(parsed.files, parsed.headings, edges, findings(spark), fragments)
    edges = graph.edges_of(parsed)
    whole = parsed.headings.groupBy("slug").agg(F.array_join(F.transform(F.collect_list("id"), lambda i: F.concat(F.lit('<p data-src-heading="'), i, F.lit('"></p>'))), "").alias("html"))
    none = spark.createDataFrame([], "slug string, ord int, text string")
    sources = spark.createDataFrame([], "slug string, text string")
    out = tmp_path / "page.html"

    def publish(fragments, shell):
        failures = gates.gate_report(parsed.files, parsed.headings, fragments, none, sources)
        return overview.publish(parts_of(fragments), shell, parsed.files, edges, findings(spark), failures, str(out))

    bad = publish(whole.where("slug <> 'refs-tokens'"), overview.default_shell())
    assert not out.exists() and bad["coverage_gaps"] == [f"refs-tokens: source heading id '{i}' not covered by any data-src-heading in the fragment" for i in ("refs-tokens--after", "refs-tokens--tokens")]
    remote = publish(whole, overview.default_shell() + "<img src=http://x>")
    assert not out.exists() and remote["external_fetches"] == ["<script>/<img> with http(s) src: '<img src=http:'"]
    good = publish(whole, overview.default_shell())
    assert out.read_text() == overview.write_page(parts_of(whole), overview.default_shell())
    assert good == {"files": 7, "sections": 10, "findings": 3, "graph_mode": "diagram", **dict.fromkeys(gates.GATES, [])}


def test_structure_is_read_again_and_a_session_repaired(spark, parsed, tmp_path):
    path = session.create(str(tmp_path), [{"slug": "refs-tokens", "path": "refs/tokens.md"}, {"slug": "skills-auth", "path": "skills/auth.md"}])
    assert session.repair(spark, path)[0] == 2
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    links, edges = graph.resolve(parsed.links, parsed.files), graph.edges_of(parsed)
    records = structure.records(parsed, links)
    nodes = parsed.files.select("slug", "file_path", "title")
    session.write_structure(path, {"root": "."}, records, nodes, edges, scope.slices(parsed.files, parsed.headings, links), structure.groups(parsed.files))
    written = json.load(open(os.path.join(path, "structure.json")))
    assert [g["group"] for g in written["groups"]] == [".", "a", "other", "refs", "skills"] and written["groups"][1]["files"][0]["file_path"] == "a/foo!bar.md"
    again, edges_again = session.read_structure(spark, path)
    files, headings, links_again = session.unfold(again)
    assert rows(files, *parsed.files.columns) == rows(parsed.files, *parsed.files.columns)
    assert rows(headings, *parsed.headings.columns) == rows(parsed.headings, *parsed.headings.columns)
    assert sorted(map(repr, links_again.select(*links.columns).collect())) == sorted(map(repr, links.collect()))
    assert rows(edges_again, "from", "to", "reason") == rows(edges, "from", "to", "reason")

    part = lambda kind, name: os.path.join(path, kind, name)
    open(part("fragments", "refs-tokens.html"), "w").write('<section id="s1"><a href="#refs-tokens--after">x</a></section>')
    open(part("analysis", "refs-tokens.json"), "w").write(json.dumps({"tldr": "t", "sections": [{"id": "s1", "title": "T", "kind": "k", "source_headings": ["tokens", "after"]}], "contracts": [{"text": "After"}, {"text": "after!"}]}))
    open(part("fragments", "skills-auth.html"), "w").write("<p>left alone</p>")
    open(part("analysis", "skills-auth.json"), "w").write("{broken")
    status, report = session.repair(spark, path, str(tmp_path))
    assert status == 0 and [x["item"] for x in report["auto_closed"]["coverage"]] == ["refs-tokens--after", "refs-tokens--tokens"]
    assert report["auto_closed"]["duplicate"] == [{"slug": "refs-tokens", "item": "after"}] and not any(report["genuine_gaps"].values())
    done = open(part("fragments", "refs-tokens.html")).read()
    assert 'data-src-heading="refs-tokens--tokens"' in done and '<div class="mdhv-contract">After</div>' in done
    assert json.load(open(part("analysis", "refs-tokens.json")))["contracts"] == [{"text": "After"}]
    assert open(part("fragments", "skills-auth.html")).read() == "<p>left alone</p>"
    assert session.repair(spark, path, str(tmp_path)) == (0, {b: {k: [] for k in gates.KINDS} for b in gates.BUCKETS})
    open(part("fragments", "refs-tokens.html"), "a").write('<a href="#nowhere">x</a>')
    status, report = session.repair(spark, path, str(tmp_path))
    assert status == 1 and report["genuine_gaps"]["anchors"] == [{"slug": "refs-tokens", "item": "#nowhere"}]


def test_repair_and_checks_agree_on_words(spark):
    texts = ["", "a b", "A  b&amp;c <i>d</i>", "one two three four", "one x two y three", "é É ü_z 9"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = H.with_normalized(H.with_normalized(df, "a", "na"), "b", "nb").withColumn("p", T.contract_present(F.col("na"), F.col("nb")))
    for r in got.collect():
        assert r["na"] == gates._words(r["a"]) and r["p"] == (r["na"] == "" or gates._present(r["na"], r["nb"]))
