"""Queries that write to the shared folder and read it again: corpora, slices, pages; the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.cut import cut, folder
from ..operators import graph, overview, scope
from ..sources import corpus, session, sinks
from ..sources.derived import CORPUS_SQL, derived_corpus
from . import reports  # noqa: F401  whose SQL is used below
from .queries import findings_of, rendered
from .registry import ORACLES, kept, query


@query("WITH " + CORPUS_SQL + """ SELECT file_path, true AS valid, md5(text) AS text_md5, length(text) AS n_chars FROM corpus
UNION ALL SELECT 'bad/' || regexp_replace(file_path, '\\.md$', '.MARKDOWN'), false, '', 0 FROM corpus WHERE starts_with(file_path, 'bench/')""")
def disk_corpus(spark, sf_dir):
    """The derived corpus on disk, with line ends of three kinds, folders that are left out, other files, and files that are not UTF-8; found and read again."""
    files, top = derived_corpus(spark, sf_dir), folder(spark)
    ends = F.get(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), F.pmod(F.hash("file_path"), F.lit(3)))
    whole = files.select(F.col("file_path").alias("name"), F.replace("text", F.lit("\n"), ends).cast("binary").alias("body"))
    notes = files.where(F.startswith("file_path", F.lit("bench/")))
    bad = notes.select(F.concat(F.lit("bad/"), F.regexp_replace("file_path", r"\.md$", ".MARKDOWN")).alias("name"), F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary")).alias("body"))
    out = [notes.select(F.concat(F.lit(f"{d}/"), "file_path", F.lit(end)).alias("name"), F.col("text").cast("binary").alias("body")) for d, end in ((".git", ""), ("a/node_modules", ""), ("other", ".txt"))]
    for more in (bad, *out):
        whole = whole.unionByName(more)
    sinks.write_keyed(whole, f"{top}/corpus")
    read, skipped = corpus.read_corpus(spark, f"{top}/corpus")
    text = T.newlines(F.col("text"))
    read = read.select("file_path", F.lit(True).alias("valid"), F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))
    return read.unionByName(skipped.select("file_path", F.lit(False).alias("valid"), F.lit("").alias("text_md5"), F.lit(0).cast("long").alias("n_chars")))


@query(ORACLES["slices"])
def session_slices(spark, sf_dir):
    """The slices of all files, written as one file each and read again."""
    s, path = kept(spark, sf_dir), f"{folder(spark)}/slices"
    session.write_slices(scope.slices(s.files, s.headings, graph.resolve(s.links, s.files)), path)
    return session.read_slices(spark, path)


#: Bytes of a zone that one row of page_document has.
RANGE = 1 << 16


@query(f"""WITH zones AS (
  SELECT 'STRAP' AS zone, string_agg(html, '' ORDER BY ord) AS body FROM ({ORACLES["page_top"]})
  UNION ALL SELECT 'TOC', '<nav class="mdhv-toc" id="mdhv-toc"><ul>' || string_agg(html, '' ORDER BY ord) || '</ul></nav>' FROM ({ORACLES["page_toc"]})
  UNION ALL SELECT 'FINDINGS', '<section class="mdhv-findings" id="mdhv-findings">' || string_agg(html, '' ORDER BY place) || '</section>' FROM ({ORACLES["findings_zone"]})
  UNION ALL SELECT 'FILES', '<div id="mdhv-files">' || string_agg(html, '' ORDER BY ord) || '</div>' FROM ({ORACLES["page_files"]})
  UNION ALL SELECT 'GRAPH', '<div class="mdhv-graph" id="mdhv-graph"></div>'),
coded AS (SELECT zone, hex(encode(body)) AS h FROM zones),
ranges AS (SELECT zone, h, unnest(range(0, length(h), {2 * RANGE})) AS spot FROM coded)
SELECT zone, (spot // {2 * RANGE})::INTEGER AS number, length(substr(h, spot + 1, {2 * RANGE})) // 2 AS n_bytes, md5(substr(h, spot + 1, {2 * RANGE})) AS hex_md5 FROM ranges""")
def page_document(spark, sf_dir):
    """The page without its graph, written by tasks as one document, and read again in ranges of its zones' bytes."""
    s, path = kept(spark, sf_dir), f"{folder(spark)}/overview.html"
    # each zone is written by itself, so that no plan holds them all
    zone = lambda df, name: cut(df.select(F.lit(name).alias("zone"), F.col("ord").cast("string").alias("ord"), "html"))
    found = cut(findings_of(s, in_order=True))
    parts = zone(overview.strap(s.files, ".", "source").unionByName(overview.panel(s.files, cut(graph.edges_of(s)), found)), "STRAP")
    parts = parts.unionByName(zone(overview.toc(s.files, s.headings), "TOC")).unionByName(zone(overview.findings_zone(found, s.files, s.headings), "FINDINGS"))
    parts = parts.unionByName(zone(overview.files_zone(s.files, rendered(s)[0], found), "FILES"))
    loads = overview.write_document(parts, overview.default_shell(), path)
    if loads:
        raise ValueError(f"not written: {loads}")
    rows = sinks.read_page(spark, path, H.ZONES, RANGE)
    return rows.select("zone", "number", F.length("body").cast("long").alias("n_bytes"), F.md5(F.hex("body").cast("binary")).alias("hex_md5"))
