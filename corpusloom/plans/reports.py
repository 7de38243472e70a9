"""Queries of slices, repairs, gates and the page's pieces, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, graph, overview, scope, structure
from ..sources.derived import derived_corpus
from .queries import FINDINGS_SQL, HUBS_SQL, PARSED_SQL, RENDERED_SQL, contracts_of, findings_of, rendered
from .registry import ORACLES, kept, query, table


@query("WITH " + PARSED_SQL + r""", parts AS (
  SELECT slug, 0 AS kind, unnest(regexp_extract_all(body, '\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)')) AS raw, generate_subscripts(regexp_extract_all(body, '\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), 1) AS i FROM slugged
  UNION ALL
  SELECT slug, 1, unnest(regexp_extract_all(body, '`([^`\n]+)`')), generate_subscripts(regexp_extract_all(body, '`([^`\n]+)`'), 1) FROM slugged),
known AS (SELECT DISTINCT slug, raw, target, type, resolved_slug FROM resolved),
refs AS (
  SELECT p.slug, string_agg(CASE WHEN resolved_slug IS NULL THEN to_json({'raw': k.raw, 'target': target, 'type': type}) ELSE to_json({'raw': k.raw, 'target': target, 'type': type, 'resolved_slug': resolved_slug}) END::VARCHAR, ',' ORDER BY kind, i) AS l
  FROM parts p JOIN known k ON p.slug = k.slug AND p.raw = k.raw GROUP BY p.slug),
tops AS (SELECT slug, string_agg(to_json({'level': level, 'text': text, 'anchor': anchor})::VARCHAR, ',' ORDER BY pos) AS h FROM headings GROUP BY slug)
SELECT f.slug, '{"slug":' || to_json(f.slug)::VARCHAR || ',"file_path":' || to_json(f.file_path)::VARCHAR || ',"title":' || to_json(f.title)::VARCHAR || ',"language":"en","headings":[' || coalesce(h, '') || '],"links":[' || coalesce(l, '') || ']}' AS slice
FROM files f LEFT JOIN tops t ON f.slug = t.slug LEFT JOIN refs r ON f.slug = r.slug""")
def slices(spark, sf_dir):
    s = kept(spark, sf_dir)
    return scope.slices(s.files, s.headings, graph.resolve(s.links, s.files))


@query("WITH " + RENDERED_SQL + r""", got AS (SELECT slug, unnest(regexp_extract_all(html, 'data-src-heading="([^"]*)"', 1)) AS id FROM bodies),
gaps AS (SELECT DISTINCT h.slug, h.id, h.anchor FROM headings h WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.slug = h.slug AND g.id = h.id)),
needles AS (SELECT slug, pos, lower(trim(regexp_replace(text || CASE WHEN pos % 5 = 4 THEN ' zzinvented' ELSE '' END, '[^\p{L}\p{N}]+', ' ', 'g'))) AS needle FROM headings),
times AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.slug, needle ORDER BY pos) AS time, contains(lower(trim(regexp_replace(s.text, '[^\p{L}\p{N}]+', ' ', 'g'))), needle) AS inside
  FROM needles n JOIN slugged s ON n.slug = s.slug WHERE needle <> ''),
firsts AS (SELECT *, string_agg(CASE WHEN inside THEN needle ELSE '' END, ' ') OVER (PARTITION BY slug ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM times WHERE time = 1),
hrefs AS (SELECT slug, unnest(regexp_extract_all(html, '<a href="(#[^"]*)"', 1)) AS href FROM bodies)
SELECT CASE WHEN EXISTS (SELECT 1 FROM sections s WHERE s.slug = g.slug AND s.anchor = g.anchor) THEN 'auto_closed' ELSE 'genuine_gaps' END AS bucket, 'coverage' AS kind, slug, id AS item FROM gaps g
UNION ALL SELECT 'auto_closed', 'duplicate', slug, needle FROM times WHERE time > 1
UNION ALL SELECT CASE WHEN inside THEN 'auto_closed' ELSE 'genuine_gaps' END, 'contracts', slug, needle FROM firsts WHERE NOT inside OR NOT contains(coalesce(shown, ''), needle)
UNION ALL SELECT 'genuine_gaps', 'anchors', slug, href FROM hrefs WHERE href[2:] NOT IN (SELECT id FROM headings)""")
def reconcile_report(spark, sf_dir):
    corpus = structure.with_slugs(derived_corpus(spark, sf_dir)).select("slug", "text")
    s = kept(spark, sf_dir)
    contracts, _ = contracts_of(s)
    fragments, sections = rendered(s)
    return gates.reconcile(s.files, s.headings, fragments, sections, contracts, corpus).report


@query("WITH " + RENDERED_SQL + rf""", needles AS (SELECT slug, pos, lower(trim(regexp_replace(text || CASE WHEN pos % 5 = 4 THEN ' zzinvented' ELSE '' END, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS needle FROM headings),
times AS (SELECT needle, row_number() OVER (PARTITION BY slug, needle ORDER BY pos) AS time FROM needles)
SELECT 'fragments' AS part, count(*) AS n_rows, 0::BIGINT AS n_changed, true AS equal FROM bodies
UNION ALL SELECT 'contracts', count(*), 0, true FROM times WHERE time = 1 OR needle = ''
UNION ALL SELECT 'genuine_gaps', count(*), 0, true FROM ({ORACLES["reconcile_report"]}) WHERE bucket = 'genuine_gaps'""")
def reconcile_again(spark, sf_dir):
    """A repair of what a repair has left: it changes nothing, by digests of both."""
    corpus = structure.with_slugs(derived_corpus(spark, sf_dir)).select("slug", "text")
    s = kept(spark, sf_dir)
    contracts, _ = contracts_of(s)
    fragments, sections = rendered(s)
    first = gates.reconcile(s.files, s.headings, fragments, sections, contracts, corpus)
    again = gates.reconcile(s.files, s.headings, first.fragments.select("slug", "html"), sections, first.contracts, corpus)
    return gates.compare(first, again)


def _checked(spark, sf_dir, s: structure.Structure) -> DataFrame:
    """All four gates: fragments by rule, with the contracts they show behind their sections, and the pages' own markup."""
    corpus = structure.with_slugs(derived_corpus(spark, sf_dir)).select("slug", "text")
    contracts, shown = contracts_of(s)
    fragments, _ = rendered(s)
    fragments = fragments.join(shown.select("slug", F.col("html").alias("more")), "slug", "left").select("slug", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))
    pages = table(spark, sf_dir, "pages").select(F.concat("html", F.lit("<img src="), "url", F.lit('><a href="//'), "url", F.lit('">')).alias("html"))
    return gates.gate_report(s.files, s.headings, fragments, contracts, corpus, pages)


FAILED_SQL = RENDERED_SQL + r""",
needles AS (SELECT slug, pos AS ord, lower(trim(regexp_replace(text || CASE WHEN pos % 5 = 4 THEN ' zzinvented' ELSE '' END, '[^\p{L}\p{N}]+', ' ', 'g'))) AS needle FROM headings),
shown AS (SELECT slug, string_agg(needle, ' ' ORDER BY ord) AS shown FROM needles WHERE ord % 2 = 0 GROUP BY slug),
src AS (SELECT slug, lower(trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))) AS src FROM slugged),
hrefs AS (SELECT slug, unnest(regexp_extract_all(html, '<a href="(#[^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="(#[^"]*)"', 1), 1) - 1 AS ord FROM bodies),
got AS (SELECT slug, unnest(regexp_extract_all(html, 'data-src-heading="([^"]*)"', 1)) AS id FROM bodies),
labels AS (SELECT * FROM (VALUES (1, 'external <link href> tag'), (2, '<script>/<img> with http(s) src'), (3, '@import of a remote url'), (4, 'url(http...) in styles'), (5, 'remote SVG <image> href'), (6, 'protocol-relative resource url')) p(k, label)),
docs AS (SELECT row_number() OVER () AS r, html || '<img src=' || url || '><a href="//' || url || '">' AS doc FROM pages),
hits AS (
  SELECT r, k, label, CASE k
    WHEN 1 THEN regexp_extract(doc, '(?i)<link\b[^>]*\bhref\s*=') WHEN 2 THEN regexp_extract(doc, '(?i)<(?:script|img)\b[^>]*\bsrc\s*=\s*[''"]?\s*https?:')
    WHEN 3 THEN regexp_extract(doc, '(?i)@import\s+(?:url\(\s*)?[''"]?\s*https?:') WHEN 4 THEN regexp_extract(doc, '(?i)url\(\s*[''"]?\s*https?:')
    WHEN 5 THEN regexp_extract(doc, '(?i)<image\b[^>]*\b(?:xlink:)?href\s*=\s*[''"]?\s*https?:') ELSE regexp_extract(doc, '(?i)(?:src|href)\s*=\s*[''"]\s*//') END AS m FROM docs, labels),
failed AS (
  SELECT 'dangling_anchors' AS gate, s.file_path AS path, h.ord, h.slug, href AS item, h.slug || ': href ''' || href || ''' resolves to no heading id or chrome anchor' AS message
  FROM hrefs h JOIN slugged s ON h.slug = s.slug WHERE href[2:] NOT IN (SELECT id FROM headings)
  UNION ALL
  (SELECT DISTINCT 'coverage_gaps', h.file_path, 0, h.slug, h.id, h.slug || ': source heading id ''' || h.id || ''' not covered by any data-src-heading in the fragment'
  FROM headings h WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.slug = h.slug AND g.id = h.id))
  UNION ALL
  SELECT 'contract_violations', n.slug, n.ord, n.slug, needle, n.slug || CASE WHEN NOT contains(src, needle) THEN ': contract not found in source bytes: ''' ELSE ': contract not found in fragment .mdhv-contract text: ''' END || needle || ''''
  FROM needles n JOIN src ON n.slug = src.slug LEFT JOIN shown f ON n.slug = f.slug WHERE NOT contains(src, needle) OR NOT contains(coalesce(shown, ''), needle)
  UNION ALL
  SELECT 'external_fetches', '', row_number() OVER (PARTITION BY r ORDER BY k) - 1, '', m, label || ': ''' || m || '''' FROM (SELECT r, k, label, CASE WHEN length(m) > 80 THEN m[:80] || '...' ELSE m END AS m FROM hits WHERE m <> ''))"""


@query("WITH " + FAILED_SQL + " SELECT gate, path, ord::INTEGER AS ord, slug, item, message FROM failed")
def gate_report(spark, sf_dir):
    return _checked(spark, sf_dir, kept(spark, sf_dir))


@query("WITH " + FAILED_SQL + r""" SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM headings) AS sections, (SELECT count(*) FROM edges) AS findings,
  CASE WHEN (SELECT count(*) FROM files) <= 3 OR (SELECT count(*) FROM edges) = 0 THEN 'chips' ELSE 'diagram' END AS graph_mode,
  """ + ", ".join(f"coalesce((SELECT string_agg(message, chr(10) ORDER BY path, ord, item, message) FROM failed WHERE gate = '{g}'), '') AS {g}" for g in gates.GATES))
def page_report(spark, sf_dir):
    s = kept(spark, sf_dir)
    row = overview.page_report(s.files, graph.edges_of(s), findings_of(s), _checked(spark, sf_dir, s))
    return row.select("files", "sections", "findings", "graph_mode", *[F.array_join(g, "\n").alias(g) for g in gates.GATES])


@query("WITH " + PARSED_SQL + HUBS_SQL + FINDINGS_SQL + r""",
n AS (SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(token_estimate) FROM files)::BIGINT AS tokens, (SELECT count(*) FROM hubs) AS hubs,
  (SELECT count(*) FROM edges WHERE strength = 'strong') AS strong, (SELECT count(*) FROM edges WHERE strength = 'weak') AS weak,
  (SELECT count(*) FROM findings WHERE severity = 'high') AS high, (SELECT count(*) FROM findings WHERE severity = 'medium') AS medium, (SELECT count(*) FROM findings) AS total),
top AS (SELECT string_agg('<a class="mdhv-node" href="#' || h.slug || '--file">' || f.title || '</a>', '' ORDER BY incoming DESC, h.slug) AS chips FROM (SELECT * FROM hubs ORDER BY incoming DESC, slug LIMIT 5) h JOIN files f ON h.slug = f.slug)
SELECT '0' AS ord, '<div class="mdhv-strap"><span class="mdhv-strap-root">.</span><span class="mdhv-strap-files">' || files || ' files</span><span class="mdhv-strap-tokens">~' || tokens || ' tokens (estimate)</span><span class="mdhv-strap-language">language: source</span></div>' AS html FROM n
UNION ALL
SELECT '1', '<section class="mdhv-overview" aria-label="At a glance"><dl class="mdhv-overview-stat"><div><dt>files</dt><dd>' || files || '</dd></div><div><dt>strong refs</dt><dd>' || strong || '</dd></div><div><dt>weak refs</dt><dd>' || weak || '</dd></div><div><dt>hubs</dt><dd>' || hubs || '</dd></div></dl><div class="mdhv-overview-jump">'
  || CASE WHEN high + medium = 0 THEN '<a class="mdhv-overview-jump-all" href="#mdhv-findings">' || CASE WHEN total > 0 THEN total || ' cross-file findings' ELSE 'no cross-file findings' END || '</a>' ELSE
    CASE WHEN high > 0 THEN '<a class="mdhv-severity-high-badge" href="#mdhv-findings"><span aria-hidden="true">⚠</span> <span class="mdhv-severity-label">' || high || ' high</span></a>' ELSE '' END
    || CASE WHEN medium > 0 THEN '<a class="mdhv-severity-medium-badge" href="#mdhv-findings"><span aria-hidden="true">◆</span> <span class="mdhv-severity-label">' || medium || ' medium</span></a>' ELSE '' END END
  || '</div>' || CASE WHEN chips IS NOT NULL THEN '<div class="mdhv-overview-hubs"><span class="mdhv-overview-hubs-label">Hub files</span>' || chips || '</div>' ELSE '' END || '</section>' FROM n, top""")
def page_top(spark, sf_dir):
    """The strap and the panel of the page."""
    s = kept(spark, sf_dir)
    return overview.strap(s.files, ".", "source").unionByName(overview.panel(s.files, graph.edges_of(s), findings_of(s))).select("ord", "html")


@query("WITH " + PARSED_SQL + r""", subs AS (
  SELECT slug, arg_min(id, pos) AS first, coalesce(string_agg('<li class="mdhv-toc-sub-item" data-level="' || level || '"><a href="#' || id || '">' || text || '</a></li>', '' ORDER BY pos) FILTER (pos > 0), '') AS sub FROM headings GROUP BY slug),
toc AS (SELECT f.*, coalesce(s.sub, '') AS sub, '<a href="#' || coalesce(s.first, f.slug) || '">' || title || '</a>' AS link FROM files f LEFT JOIN subs s ON f.slug = s.slug)
SELECT file_path AS ord, CASE WHEN sub = '' THEN '<li class="mdhv-toc-item">' || link || '</li>'
  ELSE '<li class="mdhv-toc-item mdhv-toc-item--group"><details class="mdhv-toc-disclosure" open><summary class="mdhv-toc-summary">' || link || '</summary><ul class="mdhv-toc-sub">' || sub || '</ul></details></li>' END AS html FROM toc""")
def page_toc(spark, sf_dir):
    s = kept(spark, sf_dir)
    return overview.toc(s.files, s.headings).select("ord", "html")


@query("WITH " + RENDERED_SQL + r""", n AS (SELECT slug, count(*) AS n FROM (SELECT "from" AS slug FROM edges UNION ALL SELECT "to" FROM edges) GROUP BY slug)
SELECT f.file_path AS ord, '<section class="mdhv-file" id="' || f.slug || '--file" data-slug="' || f.slug || '"><header class="mdhv-file-header"><h2>' || title || '</h2><a class="mdhv-src-link" href="' || file_path || '">' || file_path || '</a>'
  || CASE WHEN n.n IS NULL THEN '' ELSE '<a class="mdhv-file-findings-link" href="#mdhv-findings">in ' || n.n || ' finding' || CASE WHEN n.n = 1 THEN '' ELSE 's' END || '</a>' END || '</header>' || coalesce(b.html, '') || '</section>' AS html
FROM files f LEFT JOIN n ON f.slug = n.slug LEFT JOIN bodies b ON f.slug = b.slug""")
def page_files(spark, sf_dir):
    s = kept(spark, sf_dir)
    return overview.files_zone(s.files, rendered(s)[0], findings_of(s)).select("ord", "html")
