"""Queries of markup: what is read from fragments and pages, and character references; the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import html as H
from .queries import RENDERED_SQL, rendered
from .registry import parsed, query, table

# What stands around each rendered fragment: tags within a comment, an element without end tag, a break, nested contracts, end tags too many.
BEFORE = '</i><!-- <a href="#no">x</a> <p class="mdhv-contract"> --><p class="mdhv-contract">one<br>two <b class=\'mdhv-contract\'>three</b> &amp; &copy;</p>'
AFTER = '<p>open<div class="x mdhv-contract"><a href="#in&amp;div">four</a><hr/>five<em class="mdhv-contract">six</em><img alt="mdhv-contract"> end</div></p><code>&lt;a href="#no"&gt;</code><pre class="mdhv-contract"><a class="y" href=\'#pre\'>seven</a></pre></i></i></b><div class="mdhv-contract">never closed'


def marked_up(spark, sf_dir) -> DataFrame:
    """(key, html): rendered fragments with more around them, and pages whose paragraphs are contracts and whose links lead into the page."""
    fragments, _ = rendered(parsed(spark, sf_dir))
    page = F.replace(F.replace("html", F.lit("<p>"), F.lit(f'<p class="{H.PREFIX}-contract">')), F.lit('<a href="/'), F.lit('<a href="#'))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("key"), page.alias("html"))
    return fragments.select(F.col("slug").alias("key"), F.concat(F.lit(BEFORE), "html", F.lit(AFTER)).alias("html")).unionByName(pages)


_VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr'"
_BREAKING = "'br', 'p', 'div', 'li', 'ul', 'ol', 'tr', 'td', 'th', 'table', 'section', 'article', 'header', 'footer', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'blockquote', 'pre', 'hr'"
_FACETS = "WITH " + RENDERED_SQL + rf""",
docs AS (
  SELECT slug AS key, '{BEFORE.replace("'", "''")}' || html || '{AFTER.replace("'", "''")}' AS html FROM bodies
  UNION ALL SELECT 'page ' || page_id, replace(replace(html, '<p>', '<p class="mdhv-contract">'), '<a href="/', '<a href="#') FROM pages),
cut AS (SELECT key, regexp_extract_all(html, '(?s)<!--.*?-->|<(?:script|style)[^>]*>.*?</(?:script|style)>|<[a-zA-Z/!][^>]*>|<|[^<]+') AS t FROM docs),
toks AS (SELECT key, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM cut),
read AS (
  SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, regexp_matches(t, '^</[a-zA-Z]') AS closes, regexp_matches(t, '^<[a-zA-Z].*>') AS opens,
    replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain FROM toks),
steps AS (
  SELECT *, name IN ('script', 'style') AND opens AS raw,
    CASE WHEN name = '' OR name IN ({_VOID}, 'script', 'style') OR t LIKE '%/>' THEN 0 WHEN closes THEN -1 WHEN opens THEN 1 ELSE 0 END AS step,
    opens AND regexp_matches(t, '\sclass=["''][^"'']*mdhv-contract') AS named, name IN ({_BREAKING}) AND (opens OR closes) AS breaks FROM read),
sums AS (SELECT *, sum(step) OVER (PARTITION BY key ORDER BY pos) AS s FROM steps),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY pos)) AS depth FROM sums),
spots AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY key ORDER BY pos), 0) AS before FROM deep),
stops AS (
  SELECT a.key, a.pos AS start, min(b.pos) AS stop
  FROM spots a LEFT JOIN spots b ON a.key = b.key AND b.pos > a.pos AND b.step = -1 AND b.depth = a.before AND b.before > 0 WHERE a.named AND a.step = 1 GROUP BY a.key, a.pos),
outermost AS (
  SELECT * FROM (SELECT *, max(coalesce(stop, 1000000000)) OVER (PARTITION BY key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stops)
  WHERE stop IS NOT NULL AND coalesce(reach, 0) < start),
blocks AS (
  SELECT o.key, o.start, string_agg(CASE WHEN r.pos > o.start AND r.breaks THEN ' ' ELSE '' END || CASE WHEN r.raw THEN regexp_extract(r.t, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1) WHEN r.name <> '' OR starts_with(r.t, '<!') THEN '' ELSE r.plain END, '' ORDER BY r.pos) AS value
  FROM outermost o JOIN spots r ON o.key = r.key AND r.pos BETWEEN o.start AND o.stop GROUP BY o.key, o.start)
SELECT key, 'contract' AS kind, row_number() OVER (PARTITION BY key ORDER BY start)::INTEGER - 1 AS ord, value FROM blocks
UNION ALL
SELECT key, 'href', row_number() OVER (PARTITION BY key ORDER BY pos)::INTEGER - 1, regexp_extract(plain, '\shref=["''](#[^"'']*)', 1)
FROM spots WHERE name = 'a' AND opens AND regexp_matches(plain, '\shref=["'']#')"""


@query(_FACETS)
def fragment_facets(spark, sf_dir):
    """In-page links and contract texts of fragments and of pages."""
    return H.html_facets(marked_up(spark, sf_dir), key="key")


# References of every form, and what they stand for.
FORMS = (
    ("&amp;", "&"), ("&#65;", "A"), ("&#x1F600;", "😀"), ("&eacute;", "é"), ("&copy~", "©~"), ("&notit;", "¬it;"), ("&#150;", "–"), ("&#0;", "�"), ("&NotEqualTilde;", "≂̸"),
    ("&bogus;", "&bogus;"), ("&#xD800;", "�"), ("&#1;", ""), ("& &; ", "& &; "), ("&lt;b&gt;", "<b>"), ("&#99999999999;", "�"), ("&#00066~", "B~"), ("&ampx", "&x"),
)


@query("WITH forms(k, c) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, (_, c) in enumerate(FORMS)) + f") SELECT doc_id, replace(replace(text, '&', '+'), ' ', c) AS decoded FROM documents JOIN forms ON doc_id % {len(FORMS)} = k")
def entities(spark, sf_dir):
    """Documents whose blanks are character references, decoded."""
    form = F.get(F.array(*[F.lit(f) for f, _ in FORMS]), (F.col("doc_id") % len(FORMS)).cast("int"))
    coded = F.replace(F.replace("text", F.lit("&"), F.lit("+")), F.lit(" "), form)
    return table(spark, sf_dir, "documents").select("doc_id", E.unescape(coded).alias("decoded"))
