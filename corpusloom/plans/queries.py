"""Queries of the corpus operators over the driver's tables, and the same queries in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.ranks import numbered
from ..operators import gates, graph, overview, scope, structure
from ..sources.derived import CORPUS_SQL, derived_corpus
from .registry import kept as _kept
from .registry import parsed as _parsed
from .registry import query
from .registry import table as _table


# Common table expressions of the SQL side, each on top of the ones before it.
FILES_SQL = CORPUS_SQL + r""",
based AS (
  SELECT *, CASE WHEN b = '' THEN 'file' ELSE b END AS base FROM (
    SELECT file_path, text, lower(trim(regexp_replace(regexp_replace(file_path, '\.(md|markdown)$', '', 'i'), '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS b FROM corpus)),
slugged AS (
  SELECT file_path, text, regexp_replace(text, '(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(\r?\n|$)', '') AS body,
    CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || row_number() OVER (PARTITION BY base ORDER BY file_path) ELSE base END AS slug
  FROM based)"""
HEADINGS_SQL = FILES_SQL + r""",
lines AS (SELECT slug, file_path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM slugged),
fenced AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY i) % 2 AS inside FROM lines),
heads AS (
  SELECT slug, file_path, i, len(regexp_extract(line, '^(#{1,6})\s', 1)) AS level,
    trim(regexp_replace(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 2), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_]', '', 'g')) AS text
  FROM fenced WHERE inside = 0 AND regexp_matches(line, '^#{1,6}\s+')),
anchored AS (
  SELECT *, replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), ' ', '-') AS base, row_number() OVER (PARTITION BY slug ORDER BY i) - 1 AS pos
  FROM heads WHERE text <> ''),
headings AS (
  SELECT slug, file_path, pos, level, text, CASE WHEN again = 0 THEN base ELSE base || '-' || again END AS anchor, slug || '--' || CASE WHEN again = 0 THEN base ELSE base || '-' || again END AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY slug, base ORDER BY pos) - 1 AS again FROM anchored))"""
PARSED_SQL = HEADINGS_SQL + r""",
scripted AS (
  SELECT slug, body, length(body) - length(regexp_replace(body, '[\x{0400}-\x{04FF}]', '', 'g')) AS ru, length(body) - length(regexp_replace(body, '[A-Za-zªµºÀ-ÖØ-öø-ɏ]', '', 'g')) AS en FROM slugged),
files AS (
  SELECT s.slug, s.file_path, greatest(1, CAST(round_even(length(s.text) / 4.0, 0) AS INTEGER)) AS token_estimate,
    coalesce((SELECT arg_min(h.text, h.pos) FROM headings h WHERE h.slug = s.slug AND h.level = 1), '') AS title
  FROM slugged s),
raws AS (
  SELECT slug, file_path, unnest(regexp_extract_all(body, '\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)')) AS raw, 0 AS kind FROM slugged
  UNION ALL
  SELECT slug, file_path, unnest(regexp_extract_all(body, '`([^`\n]+)`')), 1 FROM slugged),
tokens AS (SELECT slug, file_path, raw, kind, CASE kind WHEN 0 THEN regexp_extract(raw, '\]\(([^)\s]+)', 1) ELSE trim(trim(raw, '`')) END AS token FROM raws),
typed AS (
  SELECT *, regexp_extract(file_path, '^(.*)/', 1) AS folder, CASE
    WHEN kind = 0 AND regexp_matches(token, '^https?://') THEN 'external_url'
    WHEN kind = 0 AND token LIKE '%.md' THEN 'relative_md'
    WHEN kind = 1 AND regexp_matches(token, '^[\w./-]+\.md$') THEN 'md_ref'
    WHEN regexp_matches(token, '^[\w./-]+\.[A-Za-z0-9]+$') THEN 'code_ref'
    WHEN kind = 0 THEN 'other' END AS type
  FROM tokens),
links AS (SELECT slug, file_path, raw, type, CASE WHEN type IN ('relative_md', 'md_ref') THEN folder || '/' || token ELSE token END AS target, token FROM typed WHERE type IS NOT NULL),
resolved AS (
  SELECT l.*, coalesce(a.slug, b.slug) AS resolved_slug
  FROM links l LEFT JOIN slugged a ON l.type IN ('relative_md', 'md_ref') AND l.target = a.file_path
    LEFT JOIN slugged b ON l.type IN ('relative_md', 'md_ref') AND contains(l.token, '/') AND l.token = b.file_path),
names AS (SELECT slug, lower(regexp_extract(file_path, '([^/]*)\.md$', 1)) AS name FROM slugged),
stems AS (SELECT DISTINCT slug, lower(token) AS name FROM tokens WHERE kind = 1 AND length(token) >= 3 AND contains(token, '-') AND regexp_matches(token, '^[A-Za-z0-9][\w-]*$')),
candidates AS (
  SELECT slug AS f, resolved_slug AS t, 0 AS prio, 'strong' AS strength, 'direct relative link' AS reason FROM resolved WHERE type = 'relative_md' AND resolved_slug IS NOT NULL
  UNION ALL SELECT slug, resolved_slug, 1, 'strong', 'inline reference' FROM resolved WHERE type = 'md_ref' AND resolved_slug IS NOT NULL
  UNION ALL SELECT r.slug, n.slug, 2, 'weak', 'name match: ''' || n.name || ''' (tentative)' FROM resolved r JOIN names n ON lower(regexp_extract(r.target, '([^/]*)\.md$', 1)) = n.name WHERE r.type = 'relative_md' AND resolved_slug IS NULL
  UNION ALL SELECT r.slug, n.slug, 3, 'weak', 'inline name match: ''' || n.name || ''' (tentative)' FROM resolved r JOIN names n ON lower(regexp_extract(r.target, '([^/]*)\.md$', 1)) = n.name WHERE r.type = 'md_ref' AND resolved_slug IS NULL
  UNION ALL SELECT s.slug, n.slug, 4, 'weak', 'bare-name match: ''' || n.name || ''' (tentative)' FROM stems s JOIN names n ON s.name = n.name),
edges AS (
  SELECT f AS "from", t AS "to", strength, reason FROM candidates WHERE f <> t
  QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY prio, reason) = 1)"""
# Stand-ins for what language models render, made from the headings by rule, on both sides.
RENDERED_SQL = PARSED_SQL + r""",
marked AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS nth, count(*) OVER (PARTITION BY slug) AS n FROM headings),
bodies AS (
  SELECT slug, string_agg('<section class="mdhv-section" id="' || slug || '-s' || pos || '"' || CASE WHEN nth % 3 = 0 THEN '' ELSE ' data-src-heading="' || id || '"' END || '><h3>' || text || '</h3><a href="#' || CASE WHEN nth % 4 = 0 THEN 'lost-' ELSE '' END || id || '">x</a></section>', '' ORDER BY pos) AS html
  FROM marked GROUP BY slug),
sections AS (SELECT slug, pos AS ord, slug || '-s' || pos AS id, anchor FROM marked WHERE nth % 2 = 0)"""


@query(r"SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INTEGER)) AS token_estimate FROM documents")
def token_estimates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))


@query(r"""
WITH counts AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[A-Za-zªµºÀ-ÖØ-öø-ɏ]', '', 'g')) AS en,
  length(text) - length(regexp_replace(text, '[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{0600}-\x{06FF}\x{0590}-\x{05FF}\x{0370}-\x{03FF}]', '', 'g')) AS others FROM documents)
SELECT doc_id, CASE WHEN others = 0 THEN 'en' END AS language FROM counts""")
def doc_language(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(r"""
SELECT doc_id, w AS normalized, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END AS n_words FROM (
  SELECT doc_id, lower(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^<>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS w FROM documents)""")
def normalized_words(spark, sf_dir):
    out = H.with_normalized(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "normalized")
    return out.select("doc_id", "normalized", F.when(F.col("normalized") == "", 0).otherwise(F.size(F.split("normalized", " "))).alias("n_words"))


@query("WITH " + FILES_SQL + " SELECT file_path, slug FROM slugged")
def slug_paths(spark, sf_dir):
    return structure.with_slugs(derived_corpus(spark, sf_dir)).select("file_path", "slug")


@query("WITH " + CORPUS_SQL + " SELECT file_path, md5(text) AS text_md5, length(text) AS n_chars FROM corpus")
def corpus_texts(spark, sf_dir):
    return derived_corpus(spark, sf_dir).select("file_path", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


@query("WITH " + HEADINGS_SQL + " SELECT slug, pos, level, text FROM headings")
def headings(spark, sf_dir):
    return _parsed(spark, sf_dir).headings.select("slug", "pos", "level", "text")


@query("WITH " + HEADINGS_SQL + " SELECT id, slug, anchor FROM headings")
def heading_ids(spark, sf_dir):
    return _parsed(spark, sf_dir).headings.select("id", "slug", "anchor")


@query("WITH " + HEADINGS_SQL + " SELECT slug, count(*) AS sections, count(*) FILTER (anchor <> base) AS renamed FROM (SELECT h.*, a.base FROM headings h JOIN anchored a ON h.slug = a.slug AND h.pos = a.pos) GROUP BY slug")
def anchor_dedup(spark, sf_dir):
    rows = _parsed(spark, sf_dir).headings.withColumn("base", T.anchorize(F.col("text")))
    return rows.groupBy("slug").agg(F.count("*").alias("sections"), F.count_if(F.col("anchor") != F.col("base")).alias("renamed"))


@query("WITH " + PARSED_SQL + " SELECT slug, title, token_estimate FROM files")
def titles(spark, sf_dir):
    return _parsed(spark, sf_dir).files.select("slug", "title", "token_estimate")


@query("WITH " + FILES_SQL + r""", block AS (SELECT slug, regexp_extract(text, '(?s)^---\n(.*?)\n---', 1) AS b FROM slugged),
lines AS (SELECT slug, unnest(string_split(b, chr(10))) AS line FROM block WHERE b <> '')
SELECT slug, regexp_extract(line, '^([^:]+): (.*)$', 1) AS key, CASE WHEN regexp_matches(regexp_extract(line, '^([^:]+): (.*)$', 2), '^-?\d+$') THEN 'int' ELSE 'string' END AS kind, regexp_extract(line, '^([^:]+): (.*)$', 2) AS value FROM lines""")
def frontmatter_kv(spark, sf_dir):
    return structure.front_rows(_parsed(spark, sf_dir).files)


@query("WITH " + PARSED_SQL + " SELECT slug, raw, target, type FROM links")
def links_classified(spark, sf_dir):
    return _parsed(spark, sf_dir).links.select("slug", "raw", "target", "type")


@query("WITH " + PARSED_SQL + " SELECT type, count(*) AS links, count(DISTINCT target) AS targets FROM links GROUP BY type")
def link_type_counts(spark, sf_dir):
    return _parsed(spark, sf_dir).links.groupBy("type").agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


@query("WITH " + PARSED_SQL + " SELECT slug, raw, type, resolved_slug FROM resolved")
def resolved_links(spark, sf_dir):
    s = _kept(spark, sf_dir)
    return graph.resolve(s.links, s.files).select("slug", "raw", "type", "resolved_slug")


@query("WITH " + PARSED_SQL + " SELECT slug, name AS token FROM stems")
def name_tokens(spark, sf_dir):
    return _parsed(spark, sf_dir).tokens


@query("WITH " + PARSED_SQL + ' SELECT "from", "to", strength, reason FROM edges')
def edges(spark, sf_dir):
    return graph.edges_of(_kept(spark, sf_dir))


@query("WITH " + PARSED_SQL + r""" SELECT trim(regexp_replace(reason, ':\s*''[^'']*''', '')) AS label, strength, count(*) AS edges FROM edges GROUP BY ALL""")
def edge_reason_counts(spark, sf_dir):
    return graph.edges_of(_kept(spark, sf_dir)).groupBy(T.legend_label(F.col("reason")).alias("label"), "strength").agg(F.count("*").alias("edges"))


HUBS_SQL = """, hubs AS (SELECT "to" AS slug, count(*) AS incoming FROM edges WHERE strength = 'strong' GROUP BY "to" HAVING count(*) >= 2)"""


@query("WITH " + PARSED_SQL + HUBS_SQL + " SELECT * FROM hubs")
def hubs(spark, sf_dir):
    return graph.hubs(graph.edges_of(_kept(spark, sf_dir)))


@query("WITH " + PARSED_SQL + HUBS_SQL + " SELECT * FROM hubs ORDER BY incoming DESC, slug LIMIT 5")
def top_hubs(spark, sf_dir):
    return graph.top_hubs(graph.edges_of(_kept(spark, sf_dir)))


@query("WITH " + PARSED_SQL + ' SELECT slug, file_path FROM files WHERE slug NOT IN (SELECT "from" FROM edges UNION SELECT "to" FROM edges)')
def isolated(spark, sf_dir):
    s = _kept(spark, sf_dir)
    return graph.isolated(s.files, graph.edges_of(s)).select("slug", "file_path")


@query("WITH " + PARSED_SQL + """ SELECT regexp_extract(file_path, '^(.*)/', 1) AS "group", count(*) AS file_count, sum(token_estimate)::BIGINT AS token_estimate, string_agg(slug, ',' ORDER BY file_path) AS members FROM files GROUP BY 1""")
def dir_groups(spark, sf_dir):
    return structure.groups(_parsed(spark, sf_dir).files).drop("files").withColumn("members", F.array_join("members", ","))


@query("WITH " + PARSED_SQL + """, g AS (SELECT *, regexp_extract(file_path, '^(.*)/', 1) AS grp FROM files)
SELECT grp AS "group", '' AS path, '## ' || grp || ' — ' || count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' — ~' || sum(token_estimate) || ' tokens (estimate)' AS line FROM g GROUP BY grp
UNION ALL SELECT grp, file_path, '- ' || slug || ' — ' || title || ' — ~' || token_estimate || ' tokens' FROM g""")
def menu_lines(spark, sf_dir):
    return scope.menu(_parsed(spark, sf_dir).files)


SPEC = "conv/g1, bench-item-1-1, conv/g2/*-1?.md, bench/item_2.md"
SELECTED_SQL = r""", ways AS (
  SELECT t.token, f.slug, CASE WHEN f.slug = t.token THEN 1 WHEN f.file_path = t.token THEN 2
    WHEN regexp_extract(f.file_path, '^(.*)/', 1) = t.token OR starts_with(regexp_extract(f.file_path, '^(.*)/', 1), t.token || '/') THEN 3
    WHEN f.file_path GLOB t.token OR (t.token LIKE '%*%' AND regexp_full_match(f.file_path, 'conv/g2/.*-1.\.md')) THEN 4 END AS category
  FROM files f, (VALUES ('conv/g1'), ('bench-item-1-1'), ('conv/g2/*-1?.md'), ('bench/item_2.md')) t(token)),
selected AS (SELECT token, slug, category FROM ways WHERE category IS NOT NULL QUALIFY category = min(category) OVER (PARTITION BY token))"""


@query("WITH " + PARSED_SQL + SELECTED_SQL + " SELECT token, slug, category FROM selected")
def select_spec(spark, sf_dir):
    return scope.select_files(_kept(spark, sf_dir).files, SPEC)


@query("WITH " + PARSED_SQL + SELECTED_SQL + ' SELECT e."from", e."to", e.strength, e.reason FROM edges e WHERE "from" IN (SELECT slug FROM selected) AND "to" IN (SELECT slug FROM selected)')
def scoped_edges(spark, sf_dir):
    s = _kept(spark, sf_dir)
    return scope.scope_edges(graph.edges_of(s), scope.select_files(s.files, SPEC))


@query("WITH " + PARSED_SQL + SELECTED_SQL + " SELECT r.slug, r.raw, CASE WHEN r.resolved_slug IN (SELECT slug FROM selected) THEN r.resolved_slug END AS resolved_slug FROM resolved r WHERE r.slug IN (SELECT slug FROM selected)")
def scoped_links(spark, sf_dir):
    s = _kept(spark, sf_dir)
    return scope.scope_links(graph.resolve(s.links, s.files), scope.select_files(s.files, SPEC)).select("slug", "raw", "resolved_slug")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href"))


@query(r"""
WITH pats AS (SELECT * FROM (VALUES
  ('external <link href> tag', '(?i)<link\b[^>]*\bhref\s*='), ('<script>/<img> with http(s) src', '(?i)<(?:script|img)\b[^>]*\bsrc\s*=\s*[''"]?\s*https?:'),
  ('@import of a remote url', '(?i)@import\s+(?:url\(\s*)?[''"]?\s*https?:'), ('url(http...) in styles', '(?i)url\(\s*[''"]?\s*https?:'),
  ('remote SVG <image> href', '(?i)<image\b[^>]*\b(?:xlink:)?href\s*=\s*[''"]?\s*https?:'), ('protocol-relative resource url', '(?i)(?:src|href)\s*=\s*[''"]\s*//')) p(label, pat)),
docs AS (SELECT page_id, html || '<img src=' || url || '><a href="//' || url || '">' AS doc FROM pages)
SELECT page_id, label, CASE WHEN length(m) > 80 THEN m[:80] || '...' ELSE m END AS snippet FROM (
  SELECT page_id, label, CASE label
    WHEN 'external <link href> tag' THEN regexp_extract(doc, '(?i)<link\b[^>]*\bhref\s*=')
    WHEN '<script>/<img> with http(s) src' THEN regexp_extract(doc, '(?i)<(?:script|img)\b[^>]*\bsrc\s*=\s*[''"]?\s*https?:')
    WHEN '@import of a remote url' THEN regexp_extract(doc, '(?i)@import\s+(?:url\(\s*)?[''"]?\s*https?:')
    WHEN 'url(http...) in styles' THEN regexp_extract(doc, '(?i)url\(\s*[''"]?\s*https?:')
    WHEN 'remote SVG <image> href' THEN regexp_extract(doc, '(?i)<image\b[^>]*\b(?:xlink:)?href\s*=\s*[''"]?\s*https?:')
    ELSE regexp_extract(doc, '(?i)(?:src|href)\s*=\s*[''"]\s*//') END AS m FROM docs, pats) WHERE m <> ''""")
def fetch_scan(spark, sf_dir):
    doc = F.concat("html", F.lit("<img src="), "url", F.lit('><a href="//'), "url", F.lit('">'))
    return gates.external_fetches(_table(spark, sf_dir, "pages").select("page_id", doc.alias("doc")), "page_id", "doc")


_NEEDLES = r"""
WITH hay AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM documents),
needles AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM benchmark)"""


@query(_NEEDLES + " SELECT doc_id, item_id FROM hay JOIN needles ON contains(h, n)")
def contract_contiguous(spark, sf_dir):
    """Items that stand in a document as they are. A window of the item's length has its hash, so the join is on equal hashes of words, not of all pairs."""
    return _word_windows(spark, sf_dir)


def _word_windows(spark, sf_dir):
    hay = H.with_normalized(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "h").select("doc_id", "h", F.split("h", " ").alias("w"))
    needles = H.with_normalized(_table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", "n").where("n <> ''").select("item_id", "n", F.split("n", " ").alias("v"))
    # a contract is a substring by characters: its inner words stand whole in the text; the two outer ones may be parts of words
    needles = needles.withColumn("inner", F.least(F.greatest(F.size("v") - 2, F.lit(0)), F.lit(3)))
    found = None
    for m in [r["inner"] for r in needles.select("inner").distinct().orderBy("inner").collect()]:  # 0 to 3
        mine = needles.where(F.col("inner") == m)
        if m:
            keyed = mine.select("item_id", F.xxhash64(*[F.get("v", F.lit(1 + j)) for j in range(m)]).alias("k"))
            runs = hay.where(F.size("w") >= m).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - m)).alias("i"))
            runs = runs.select("doc_id", F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(m)]).alias("k"))
            pairs = runs.join(keyed, "k").select("doc_id", "item_id").distinct()
            some = pairs.join(mine.select("item_id", "n"), "item_id").join(hay.select("doc_id", "h"), "doc_id").where(F.contains("h", F.col("n"))).select("doc_id", "item_id")
        else:
            # one or two words, both of which may be parts of words: each such needle is looked for in all texts
            some = hay.select("doc_id", "h").join(mine.select("item_id", "n"), F.contains("h", F.col("n"))).select("doc_id", "item_id")
        found = some if found is None else found.unionByName(some)
    return found if found is not None else hay.join(needles, F.lit(False)).select("doc_id", "item_id")


_GAPPED = r"""
WITH n AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM conversations),
rows AS (SELECT conv_id, turn, role, h, string_split(h, ' ') AS hw FROM n WHERE h <> ''),
needles AS (SELECT *, list_filter(hw, lambda w, i: i % 2 = 1) AS nw FROM rows),
spans AS (SELECT *, greatest(3 * len(nw), len(nw) + 20) AS span FROM needles)
SELECT conv_id, turn, role, array_to_string(nw, ' ') AS needle,
  contains(h, array_to_string(nw, ' ')) OR len(list_filter(range(1, len(hw) + 1), lambda i: hw[i] = nw[1] AND
    list_reduce(hw[i:i + span - 1], lambda k, w: CASE WHEN k < len(nw) AND w = nw[k + 1] THEN k + 1 ELSE k END, 0) = len(nw))) > 0 AS present
FROM spans"""


@query(_GAPPED)
def contract_present(spark, sf_dir):
    """Every other word of each turn, looked for in the turn."""
    rows = H.with_normalized(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "text", "h").where("h <> ''")
    needle = F.array_join(F.filter(F.split("h", " "), lambda w, i: i % 2 == 0), " ")
    return rows.withColumn("needle", needle).select("conv_id", "turn", "role", "needle", T.contract_present(F.col("needle"), F.col("h")).alias("present"))


def rendered(s: structure.Structure) -> tuple[DataFrame, DataFrame]:
    """Fragments and sections by rule: every third heading's id is left out, every fourth link is broken, every second heading is claimed."""
    nth = F.col("pos") + 1
    covered = F.when(nth % 3 == 0, "").otherwise(F.concat(F.lit(' data-src-heading="'), "id", F.lit('"')))
    piece = F.concat(F.lit(f'<section class="{H.PREFIX}-section" id="'), "slug", F.lit("-s"), F.col("pos").cast("string"), F.lit('"'), covered, F.lit("><h3>"), "text", F.lit('</h3><a href="#'), F.when(nth % 4 == 0, "lost-").otherwise(""), "id", F.lit('">x</a></section>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "")
    fragments = s.headings.groupBy("slug").agg(body.alias("html"))
    sections = s.headings.where(nth % 2 == 0).select("slug", F.col("pos").alias("ord"), F.concat("slug", F.lit("-s"), F.col("pos").cast("string")).alias("id"), F.array("anchor").alias("source_headings"))
    return fragments, sections


@query("WITH " + RENDERED_SQL + """, hrefs AS (SELECT slug, unnest(regexp_extract_all(html, '<a href="(#[^"]*)"', 1)) AS href FROM bodies)
SELECT slug, href FROM hrefs WHERE href[2:] NOT IN (SELECT id FROM headings)""")
def dangling_anchors(spark, sf_dir):
    s = _parsed(spark, sf_dir)
    return gates.dangling_anchors(s.files, s.headings, rendered(s)[0]).select("slug", "href")


@query("WITH " + RENDERED_SQL + """, got AS (SELECT slug, unnest(regexp_extract_all(html, 'data-src-heading="([^"]*)"', 1)) AS id FROM bodies)
SELECT DISTINCT h.slug, h.id FROM headings h WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.slug = h.slug AND g.id = h.id)""")
def coverage_gaps(spark, sf_dir):
    s = _parsed(spark, sf_dir)
    return gates.coverage_gaps(s.files, s.headings, rendered(s)[0])


@query("WITH " + RENDERED_SQL + """, got AS (SELECT slug, unnest(regexp_extract_all(html, 'data-src-heading="([^"]*)"', 1)) AS id FROM bodies),
gaps AS (SELECT DISTINCT h.slug, h.id, h.anchor FROM headings h WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.slug = h.slug AND g.id = h.id))
SELECT g.slug, g.id, (SELECT arg_min(s.id, s.ord) FROM sections s WHERE s.slug = g.slug AND s.anchor = g.anchor) AS section_id FROM gaps g""")
def reconcile_coverage(spark, sf_dir):
    s = _parsed(spark, sf_dir)
    fragments, sections = rendered(s)
    return gates.reconcile_coverage(s.files, s.headings, fragments, sections)


def contracts_of(s: structure.Structure) -> tuple[DataFrame, DataFrame]:
    """Contracts by rule: each heading's text with the file's name, every fifth with a word that no source has; and fragments that show every second one."""
    contracts = s.headings.select("slug", F.col("pos").alias("ord"), F.concat("text", F.when(F.col("pos") % 5 == 4, " zzinvented").otherwise("")).alias("text"))
    shown = F.when(F.col("ord") % 2 == 0, F.concat(F.lit(f'<p class="{H.PREFIX}-contract">'), "text", F.lit("</p>"))).otherwise("")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("piece")))), lambda x: x["piece"]), "")
    return contracts, contracts.groupBy("slug").agg(body.alias("html"))


@query("WITH " + HEADINGS_SQL + r""",
contracts AS (SELECT slug, pos AS ord, text || CASE WHEN pos % 5 = 4 THEN ' zzinvented' ELSE '' END AS t FROM headings),
needles AS (SELECT slug, ord, lower(trim(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g'))) AS needle FROM contracts),
shown AS (SELECT slug, string_agg(needle, ' ' ORDER BY ord) AS shown FROM needles WHERE ord % 2 = 0 GROUP BY slug),
src AS (SELECT slug, lower(trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))) AS src FROM slugged)
SELECT n.slug, n.ord, n.needle, CASE WHEN NOT contains(s.src, n.needle) THEN 'source' ELSE 'fragment' END AS missing_in
FROM needles n JOIN src s ON n.slug = s.slug LEFT JOIN shown f ON n.slug = f.slug
WHERE NOT contains(s.src, n.needle) OR NOT contains(coalesce(f.shown, ''), n.needle)""")
def contract_violations(spark, sf_dir):
    corpus = structure.with_slugs(derived_corpus(spark, sf_dir)).select("slug", "text")
    contracts, fragments = contracts_of(_kept(spark, sf_dir))
    return gates.contract_violations(contracts, corpus, fragments)


FINDINGS_SQL = r""", findings AS (
  SELECT row_number() OVER (ORDER BY "from", "to") - 1 AS ord, "from" AS a, "to" AS b, reason, CASE WHEN strength = 'weak' THEN 'high' WHEN reason LIKE 'direct%' THEN 'medium' ELSE 'info' END AS severity,
    CASE WHEN strength = 'weak' THEN 'signal_noise' WHEN reason LIKE 'direct%' THEN 'contradiction' ELSE 'naming' END AS kind FROM edges)"""


def findings_of(s: structure.Structure, in_order: bool = False) -> DataFrame:
    """Findings by rule, one an edge; a file's own name comes twice, and ids of sections, real and made up, in the texts. in_order: numbered by their files, else by a hash of them."""
    rows = graph.edges_of(s)
    rows = numbered(rows, [F.col("from"), F.col("to")], "ord") if in_order else rows.withColumn("ord", F.pmod(F.xxhash64("from", "to"), F.lit(2**62)))
    severity = F.when(F.col("strength") == "weak", "high").when(F.col("reason").startswith("direct"), "medium").otherwise("info")
    kind = F.when(F.col("strength") == "weak", "signal_noise").when(F.col("reason").startswith("direct"), "contradiction").otherwise("naming")
    claim = lambda c: F.struct(F.col(c).alias("file"), F.concat(F.lit("see "), F.col(c), F.lit("--file")).alias("claim"))
    claims = F.array(claim("from"), claim("to"))
    told = F.concat(F.lit("from "), "from", F.lit("--file <to> "), "to", F.lit("--user-12x, no--user & "), "to", F.lit("--lost"))
    return rows.select("ord", kind.alias("type"), severity.alias("severity"), F.array("from", "to", "from").alias("files"), F.col("reason").alias("title"), told.alias("description"), claims.alias("claims"))


@query("WITH " + PARSED_SQL + " SELECT slug, count(*) AS findings FROM (SELECT \"from\" AS slug FROM edges UNION ALL SELECT \"to\" FROM edges) GROUP BY slug")
def findings_per_file(spark, sf_dir):
    return overview.findings_per_file(findings_of(_kept(spark, sf_dir)))


@query("WITH " + PARSED_SQL + FINDINGS_SQL + " SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM findings")
def severity_tally(spark, sf_dir):
    return overview.severity_tally(findings_of(_kept(spark, sf_dir)))


PLACED_SQL = FINDINGS_SQL + r""", placed AS (
  SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'contradiction' THEN 0 WHEN 'signal_noise' THEN 2 ELSE 3 END, kind, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 99 END, ord) - 1 AS place FROM findings)"""


@query("WITH " + PARSED_SQL + PLACED_SQL + " SELECT place, ord, kind AS type, severity FROM placed")
def findings_order(spark, sf_dir):
    """All findings with their number on the page."""
    return overview.ordered_findings(findings_of(_kept(spark, sf_dir), in_order=True)).select("place", "ord", "type", "severity")


@query("WITH " + PARSED_SQL + PLACED_SQL + r""", titles AS (SELECT id, arg_max(text, pos) AS title FROM headings GROUP BY id),
cards AS (
  SELECT p.*, f.title AS a_title, t.title AS b_title, coalesce('<a href="#' || x.id || '">' || x.title || '</a>x', '<a href="#' || y.id || '">' || y.title || '</a>2x', '<a href="#' || z.id || '">' || z.title || '</a>-12x', b || '--user-12x') AS cited
  FROM placed p JOIN files f ON p.a = f.slug JOIN files t ON p.b = t.slug LEFT JOIN titles x ON x.id = b || '--user-12' LEFT JOIN titles y ON y.id = b || '--user-1' LEFT JOIN titles z ON z.id = b || '--user')
SELECT place, CASE WHEN place = min(place) OVER (PARTITION BY kind) THEN '<div class="mdhv-findings-group" data-type="' || kind || '"><h2>' || CASE kind WHEN 'contradiction' THEN 'Contradictions' WHEN 'signal_noise' THEN 'Signal / noise' ELSE kind END || '</h2>' ELSE '' END
  || '<article class="mdhv-finding mdhv-severity-' || severity || '"><span class="mdhv-severity-' || severity || '-badge"><span aria-hidden="true">' || CASE severity WHEN 'high' THEN '⚠' WHEN 'medium' THEN '◆' ELSE '○' END || '</span> <span class="mdhv-severity-label">' || upper(severity) || '</span></span><h3>' || replace(reason, '''', '&#x27;') || '</h3><p>'
  || 'from <a href="#' || a || '--file">' || a_title || '</a> &lt;to&gt; ' || cited || ', no--user &amp; ' || b || '--lost</p>'
  || '<div class="mdhv-finding-compare"><div class="mdhv-finding-claim"><span class="mdhv-finding-claim-file"><a class="mdhv-node" href="#' || a || '--file">' || a_title || '</a></span><p>see <a href="#' || a || '--file">' || a_title || '</a></p></div>'
  || '<div class="mdhv-finding-claim"><span class="mdhv-finding-claim-file"><a class="mdhv-node" href="#' || b || '--file">' || b_title || '</a></span><p>see <a href="#' || b || '--file">' || b_title || '</a></p></div></div>'
  || '<div class="mdhv-finding-files"><a class="mdhv-node" href="#' || a || '--file">' || a_title || '</a><a class="mdhv-node" href="#' || b || '--file">' || b_title || '</a><a class="mdhv-node" href="#' || a || '--file">' || a_title || '</a></div></article>'
  || CASE WHEN place = max(place) OVER (PARTITION BY kind) THEN '</div>' ELSE '' END AS html
FROM cards""")
def findings_zone(spark, sf_dir):
    """The cards of all findings, in their order, with links to the sections that their texts name."""
    s = _kept(spark, sf_dir)
    zone = overview.findings_zone(findings_of(s, in_order=True), s.files, s.headings)
    return zone.select(F.col("ord").cast("long").alias("place"), "html")


@query("WITH " + PARSED_SQL + " SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges) AS edges, CASE WHEN (SELECT count(*) FROM files) <= 3 OR (SELECT count(*) FROM edges) = 0 THEN 'chips' ELSE 'diagram' END AS mode")
def graph_mode(spark, sf_dir):
    s = _kept(spark, sf_dir)
    return graph.graph_mode(s.files, graph.edges_of(s))


@query("WITH " + PARSED_SQL + r""" SELECT label, arg_min(strength, k) AS strength FROM (SELECT trim(regexp_replace(reason, ':\s*''[^'']*''', '')) AS label, strength, ("from", "to") AS k FROM edges) GROUP BY label""")
def graph_legend(spark, sf_dir):
    return graph.legend(graph.edges_of(_kept(spark, sf_dir)))


@query("WITH RECURSIVE " + PARSED_SQL + r""",
ahead AS (SELECT DISTINCT "from" AS f, "to" AS t FROM edges WHERE reason = 'direct relative link' AND "from" < "to"),
ends AS (SELECT f AS slug FROM ahead UNION SELECT t FROM ahead),
walk AS (SELECT slug, 0 AS layer FROM ends WHERE slug NOT IN (SELECT t FROM ahead) UNION SELECT a.t, w.layer + 1 FROM walk w JOIN ahead a ON a.f = w.slug)
SELECT slug, max(layer) AS layer FROM walk GROUP BY slug""")
def dag_layers(spark, sf_dir):
    """Layers of the links that lead on in the order of slugs, which is free of cycles."""
    ahead = graph.edges_of(_kept(spark, sf_dir)).where(F.col("reason") == graph.REASONS[0]).where("`from` < `to`")
    return graph.longest_layers(ahead)


@query()
def barycenter_order(spark, sf_dir):
    return overview.geometry(graph.diagram(graph.edges_of(_kept(spark, sf_dir))))


@query()
def all_layers(spark, sf_dir):
    """Layers over all edges but the back edges of a depth-first walk, as the diagram has them."""
    return graph.diagram(graph.edges_of(_kept(spark, sf_dir))).select("slug", "layer")


@query()
def overview_html(spark, sf_dir):
    s = _kept(spark, sf_dir)
    fragments, _ = rendered(s)
    files = s.files.select("slug", "file_path", "title", "token_estimate")
    return overview.page_parts(files, s.headings, graph.edges_of(s), findings_of(s), fragments)

