"""Tokens, nesting and character references against the standard library's reader."""

import html
import random
import re
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import entities, markup
from corpusloom.functions import html as H
from corpusloom.operators import gates

PIECES = [
    '<div class="mdhv-contract">', "<p class='x mdhv-contract'>", "</div>", "</p>", "<p>", "<br>", "<br/>", "text ", "a &amp; b", "&copy", '<a href="#x">', "<a href=#y/>", "<A HREF='#z' >", "</a>", "<!-- c -->", '<!-- <a href="#no"> -->',
    "<!--", "-->", "<script>", "</script>", '<style type="t">', "</style >", 'var x="</p>"', "<", ">", '"', "'", "=", "/", "<!DOCTYPE html>", "<?pi x?>", "<![CDATA[ x ]]>", "<![if x]>", "<![endif]", "<![foo ", "</", "</ p>", "</1>", "<pre>", "</pre>",
    '<img src="a>b">', '<span class="mdhv-contract"/>', '<em class="a mdhv&#45;contract b">', "</em>", "<a b='c>", '<a href="#q"x>', "<a\x00b>", "\n", "\x0b", "\xa0", "é", '<b c= "d', '<x y==">', "<input class=mdhv-contract>",
    '<script class="mdhv-contract">', '<a href = "#sp" class>', "<p/ >", '<a/href="#sl">', "<![", "<!", '</p x="y">', "<SCRIPT >", "</SCRIPT>",
]


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.seen.append(("whole", tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag, []))

    def handle_data(self, data):
        self.seen.append(("text", data, []))


def plain(document):
    """(in-page links, texts of the outermost contract elements, whether one stays open), from the whole list of events."""
    reader = Events()
    try:
        reader.feed(document)
        reader.close()
    except AssertionError:
        pass  # a malformed marked section ends the document
    links = [v for kind, name, attrs in reader.seen if kind in ("open", "whole") and name == "a" for k, v in attrs if k == "href" and v and v[0] == "#"]
    waiting, spans = [], []
    for i, (kind, name, _) in enumerate(reader.seen):
        if name in markup.VOID:
            continue
        if kind == "open":
            waiting.append(i)
        elif kind == "close" and waiting:
            spans.append((waiting.pop(), i))
    spans = sorted(spans + [(i, None) for i in waiting])
    named = [(a, b) for a, b in spans if any(k == "class" and "mdhv-contract" in (v or "").split() for k, v in reader.seen[a][2])]
    outer = [(a, b) for a, b in named if not any(c < a and (d is None or d > a) for c, d in named)]
    shown = lambda kind, name: name if kind == "text" else " " if name in markup.BREAKING and not (kind == "close" and name in markup.VOID) else ""
    return links, ["".join(shown(*e[:2]) for e in reader.seen[a + 1 : b + 1]) for a, b in outer if b is not None], any(b is None for _, b in outer)


def test_markup_as_the_standard_library_reads_it(spark):
    draw = random.Random(11)
    documents = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    documents += ["<a " + " ".join(f'k{i}="v"' for i in range(5000)) + ' href="#far">x</a>', "<p class=mdhv-contract>" + "<i>" * 3000 + "deep" + "</i>" * 3000 + "</p>", "<!--" * 200]
    df = spark.createDataFrame(list(enumerate(documents)), "id int, html string").repartition(4).cache()
    rows = df.select("id", F.transform(markup.tokens(F.col("html")), lambda t: t["text"]).alias("t"), markup.page_hrefs(F.col("html")).alias("h")).collect()
    blocks = {r.id: (list(r.blocks), r.open) for r in H.contract_blocks(df, "id").collect()}
    for r in rows:
        links, texts, ajar = plain(documents[r.id])
        assert "".join(r.t) == documents[r.id] and list(r.h) == links and blocks.get(r.id, ([], False)) == (texts, ajar), documents[r.id]


def test_facets_run_in_the_jvm(spark):
    df = spark.range(9).select(F.col("id").cast("string").alias("slug"), F.lit('<p class="mdhv-contract">x</p><a href="#y">').alias("html"))
    plan = H.html_facets(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|InPandas|InArrow", plan)


def test_unfinished(spark):
    cases = {"": False, "x": False, "<p>": False, "</p>": False, "<p": True, "<!-- a": True, "<!-- a -->": False, "<script>x": True, "<script>x</script>": False, "<script/>": False, "a < b": False, "</p": True, "<!doctype x": True, "<?x": True}
    rows = spark.createDataFrame(list(cases.items()), "html string, want boolean").select("*", markup.unfinished(F.col("html")).alias("got")).collect()
    assert not [r for r in rows if r.got != r.want]


def test_references_as_the_standard_library_decodes_them(spark):
    draw = random.Random(1)
    texts = [f"&{n}" for n in html5] + [f"&{n}{draw.choice(['x', '1', ' ', '&', ';', 'é', '<'])}" for n in html5]
    texts += [f"&#{n};" for n in [*range(0x400), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFE, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**30]]
    texts += ["&#xFFFFFFFFFF;", "&#X41g", "&#", "&#;", "&#x;", "&#xg", "&", "&&", "&;", "& amp;", "&" + "q" * 40 + ";", "&notit; &notin; &no;", "&#0065;&#x00041;", "&amp;lt;", "&é;", ""]
    alphabet = ["&", "#", "x", "X", ";", "amp", "lt", "not", "in", "copy", "1", "6", "5", "f", " ", "<", "é", "\n", "q", "&am", "&#x", "&#3"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = df.select("t", entities.unescape(F.col("t")).alias("u")).collect()
    assert not [r for r in got if r.u != html.unescape(r.t)]
    assert df.select(entities.unescape(F.lit(None).cast("string")).alias("u")).first().u is None


@pytest.mark.parametrize(("body", "kept"), [("<p>x</p>", True), ('<p class="mdhv-contract">open', False), ("<!-- open", False)])
def test_a_callout_satisfies_later_contracts_only_as_an_element_of_its_own(spark, body, kept):
    files = spark.createDataFrame([("a", "a.md")], "slug string, file_path string")
    headings = spark.createDataFrame([], "slug string, id string, anchor string")
    sections = spark.createDataFrame([], "slug string, ord int, id string, source_headings array<string>")
    contracts = spark.createDataFrame([("a", 0, "never log the token"), ("a", 1, "log the token")], "slug string, ord int, text string")
    sources = spark.createDataFrame([("a", "we never log the token.")], "slug string, text string")
    done = gates.reconcile(files, headings, spark.createDataFrame([("a", body)], "slug string, html string"), sections, contracts, sources)
    assert done.fragments.first().html.count('<div class="mdhv-contract">') == (1 if kept else 2)
