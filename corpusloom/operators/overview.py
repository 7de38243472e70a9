"""The overview page as rows: (zone, ord, html), each zone's pieces in the order of ord.

Pieces are made by column expressions, one row a file, edge or finding; only write_page, the
last step, brings them together into one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import html as H
from ..functions import text as T
from ..functions.cut import cut
from ..functions.ranks import numbered
from ..sources import sinks
from . import gates, graph as G

P = H.PREFIX
# Severities with their icons, and headings of the known types of findings, both in order.
SEVERITY = (("high", "⚠"), ("medium", "◆"), ("low", "○"))
TYPES = (("contradiction", "Contradictions"), ("coverage", "Coverage gaps"), ("signal_noise", "Signal / noise"))
# The diagram's boxes, gaps and margin.
BOX_W, BOX_H, GAP_X, GAP_Y, MARGIN = 184, 48, 30, 64, 24


def cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def file_link(slug: Column, label: Column) -> Column:
    return cat(f'<a class="{P}-node" href="#', T.esc(slug), '--file">', T.esc(label), "</a>")


def strap(files: DataFrame, root: str, language: str) -> DataFrame:
    n = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("t"))
    body = cat(f'<div class="{P}-strap"><span class="{P}-strap-root">', T.esc(F.lit(root)), f'</span><span class="{P}-strap-files">', F.col("n"), f' files</span><span class="{P}-strap-tokens">~', F.col("t"), f' tokens (estimate)</span><span class="{P}-strap-language">language: ', T.esc(F.lit(language)), "</span></div>")
    return n.select(F.lit("STRAP").alias("zone"), F.lit("0").alias("ord"), body.alias("html"))


def severity_tally(findings: DataFrame) -> DataFrame:
    """(high, medium, low, total); other severities count in the total alone."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s, _ in SEVERITY], F.count("*").alias("total"))


def panel(files: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    hub = G.hubs(edges)
    top = G.top_hubs(edges).join(files.select("slug", "title"), "slug", "left").agg(F.array_sort(F.collect_list(F.struct((-F.col("incoming")).alias("k"), "slug", "title"))).alias("top"))
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [
        files.agg(F.count("*").alias("n")),
        edges.agg(F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak")),
        hub.agg(F.count("*").alias("hubs")),
        severity_tally(findings),
        top,
    ])
    stats = [cat(f"<div><dt>{name}</dt><dd>", F.col(c), "</dd></div>") for name, c in (("files", "n"), ("strong refs", "strong"), ("weak refs", "weak"), ("hubs", "hubs"))]
    badge = lambda s, icon: F.when(F.col(s) > 0, cat(f'<a class="{P}-severity-{s}-badge" href="#{P}-findings"><span aria-hidden="true">{icon}</span> <span class="{P}-severity-label">', F.col(s), f" {s}</span></a>")).otherwise(F.lit(""))
    badges = F.concat(*[badge(s, icon) for s, icon in SEVERITY])
    rest = cat(f'<a class="{P}-overview-jump-all" href="#{P}-findings">', F.when(F.col("total") > 0, cat(F.col("total"), " cross-file findings")).otherwise(F.lit("no cross-file findings")), "</a>")
    jump = cat(f'<div class="{P}-overview-jump">', F.when(badges != "", badges).otherwise(rest), "</div>")
    chips = F.array_join(F.transform("top", lambda h: file_link(h["slug"], F.coalesce(h["title"], h["slug"]))), "")
    hubs_html = F.when(F.size("top") > 0, cat(f'<div class="{P}-overview-hubs"><span class="{P}-overview-hubs-label">Hub files</span>', chips, "</div>")).otherwise(F.lit(""))
    body = cat(f'<section class="{P}-overview" aria-label="At a glance"><dl class="{P}-overview-stat">', *stats, "</dl>", jump, hubs_html, "</section>")
    return row.select(F.lit("STRAP").alias("zone"), F.lit("1").alias("ord"), body.alias("html"))


def toc(files: DataFrame, headings: DataFrame) -> DataFrame:
    heads = headings.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text", "id"))).alias("h"))
    rows = files.select("slug", "file_path", "title").join(heads, "slug", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<pos:int,level:int,text:string,id:string>>")))
    sub = F.array_join(F.transform(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), lambda x: cat(f'<li class="{P}-toc-sub-item" data-level="', x["level"], '"><a href="#', T.esc(x["id"]), '">', T.esc(x["text"]), "</a></li>")), "")
    first = F.get("h", F.lit(0))
    link = cat('<a href="#', T.esc(F.coalesce(first["id"], F.col("slug"))), '">', T.esc(F.coalesce(F.nullif("title", F.lit("")), "slug")), "</a>")
    deep = cat(f'<li class="{P}-toc-item {P}-toc-item--group"><details class="{P}-toc-disclosure" open><summary class="{P}-toc-summary">', link, f'</summary><ul class="{P}-toc-sub">', sub, "</ul></details></li>")
    item = F.when(sub != "", deep).otherwise(cat(f'<li class="{P}-toc-item">', link, "</li>"))
    return rows.select(F.lit("TOC").alias("zone"), F.col("file_path").alias("ord"), item.alias("html"))


def geometry(placed: DataFrame) -> DataFrame:
    """Adds x, y, width and height of the canvas to rows of a diagram.

    Boxes of a layer are counted, with partial counts before the shuffle; a canvas takes its size from its
    layers' counts, one row each. So no task holds a graph's boxes.
    """
    width = lambda n: n * BOX_W + F.greatest(n - 1, F.lit(0)) * GAP_X
    layers = placed.groupBy("graph_id", "layer").agg(F.count("*").alias("__n"))
    deepest = F.max("layer")
    canvas = layers.groupBy(F.col("graph_id").alias("__g")).agg((F.max(width(F.col("__n"))) + 2 * MARGIN).alias("width"), ((deepest + 1) * BOX_H + deepest * GAP_Y + 2 * MARGIN).alias("height"))
    sizes = layers.join(canvas, F.col("graph_id").eqNullSafe(F.col("__g"))).select("__g", F.col("layer").alias("__l"), "__n", "width", "height")
    rows = placed.join(sizes, F.col("graph_id").eqNullSafe(F.col("__g")) & F.col("layer").eqNullSafe(F.col("__l")))
    x = F.round((F.col("width") - width(F.col("__n"))) / 2.0 + F.col("index") * (BOX_W + GAP_X), 2)
    return rows.withColumn("x", x).withColumn("y", F.round(F.lit(float(MARGIN)) + F.col("layer") * (BOX_H + GAP_Y), 2)).drop("__n", "__g", "__l")


def graph_zone(files: DataFrame, edges: DataFrame) -> DataFrame:
    """The pieces of the graph: chips, or edges, boxes, legend and isolated files of the diagram; the caption last."""
    mode = F.broadcast(G.graph_mode(files, edges).select("mode"))
    hub = G.hubs(edges)
    title = F.coalesce(F.nullif("title", F.lit("")), "slug")
    order = F.concat(T.dirname(F.col("file_path")), F.lit("\1"), "slug")
    piece = lambda df, step, order, body: df.select(F.lit("GRAPH").alias("zone"), F.concat(F.lit(f"{step}\1"), order).alias("ord"), body.alias("html"))
    chips = piece(files.crossJoin(mode).where("mode = 'chips'"), 0, order, file_link(F.col("slug"), title))
    placed = geometry(G.diagram(edges, nodes=files))
    drawn = edges.join(placed.select(F.col("slug").alias("from"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("layer").alias("la")), "from")
    drawn = drawn.join(placed.select(F.col("slug").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("layer").alias("lb")), "to").crossJoin(mode).where("mode = 'diagram'")
    down = F.col("lb") > F.col("la")
    sx, tx = F.col("ax") + BOX_W / 2, F.col("bx") + BOX_W / 2
    sy, ty = F.when(down, F.col("ay") + BOX_H).otherwise(F.col("ay")), F.when(down, F.col("by")).otherwise(F.col("by") + BOX_H)
    middle = sy + (ty - sy) * 0.5
    at = lambda x, y: cat(F.round(x, 2), ",", F.round(y, 2))
    kind = F.when(F.col("strength") == "strong", "").otherwise(' stroke-dasharray="6 4" opacity="0.45"')
    path = cat(f'<path class="{P}-edge {P}-edge-', F.col("strength"), '" d="M', at(sx, sy), " C", at(sx, middle), " ", at(tx, middle), " ", at(tx, ty), '"', kind, f' marker-end="url(#{P}-arrow)" />')
    lines = piece(drawn, 1, F.concat("from", F.lit("\1"), "to"), path)
    boxes = placed.join(files.select("slug", "title", "file_path"), "slug").join(hub, "slug", "left").crossJoin(mode).where("mode = 'diagram'")
    cx, filled = F.round(F.col("x") + BOX_W / 2, 2), F.col("incoming").isNotNull()
    label = F.when(filled, f"{P}-node-label-hub").otherwise(f"{P}-node-label")
    box = cat(
        f'<a class="{P}-node" href="#', T.esc(F.col("slug")), '--file" data-hub="', F.when(filled, "true").otherwise("false"), '"><title>', T.esc(title), " — ", T.esc(F.col("file_path")), "</title>",
        '<rect x="', F.col("x"), '" y="', F.col("y"), f'" width="{BOX_W}" height="{BOX_H}" rx="8" /><text class="', label, '" x="', cx, '" y="', F.round(F.col("y") + BOX_H / 2 - 2, 2), '">', T.esc(T.truncate(title, 24)),
        f'</text><text class="{P}-node-sub" x="', cx, '" y="', F.round(F.col("y") + BOX_H / 2 + 14, 2), '">', T.esc(T.truncate(F.col("file_path"), 28)), "</text></a>",
    )
    nodes = piece(boxes, 2, order, box)
    names = piece(G.legend(edges).crossJoin(mode).where("mode = 'diagram'"), 3, F.col("label"), cat(f'<li class="{P}-edge {P}-edge-', F.col("strength"), '">', T.esc(F.col("label")), "</li>"))
    alone = piece(G.isolated(files, edges).crossJoin(mode).where("mode = 'diagram'"), 4, order, file_link(F.col("slug"), title))
    counts = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [
        G.graph_mode(files, edges),
        edges.agg(F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak")),
        hub.agg(F.count("*").alias("hubs")),
        G.isolated(files, edges).agg(F.count("*").alias("alone")),
    ])
    flat = cat(F.col("files"), " files · ", F.col("strong"), " strong cross-references · ", F.col("weak"), " weak / name-match references", F.when(F.col("strong") == 0, " — relationships inferred from name matches only; see Findings for tensions").otherwise(""))
    deep = cat("Files are layered top-to-bottom from referrer to referenced; arrows point to the file being referenced, and filled nodes are hubs (referenced by &gt;=2 others). ", F.col("files"), " files · ", F.col("strong"), " strong cross-references · ", F.col("hubs"), " hub(s) · ", F.col("alone"), " isolated")
    caption = counts.select(F.lit("GRAPH").alias("zone"), F.lit("5").alias("ord"), cat(f'<p class="{P}-graph-caption" data-mode="', F.col("mode"), '">', F.when(F.col("mode") == "chips", flat).otherwise(deep), "</p>").alias("html"))
    return reduce(DataFrame.unionByName, [chips, lines, nodes, names, alone, caption])


def ordered_findings(findings: DataFrame) -> DataFrame:
    """findings with place, their number from 0: by type (known ones first, then by name), severity, and their own order."""
    kind = F.coalesce("type", F.lit("other"))
    known = F.coalesce(*[F.when(kind == t, i) for i, (t, _) in enumerate(TYPES)], F.lit(len(TYPES)))
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, (s, _) in enumerate(SEVERITY)], F.lit(99))
    return numbered(findings, [known, kind, rank, F.col("ord")], "place")


def findings_per_file(findings: DataFrame) -> DataFrame:
    """(slug, findings): in how many findings a file takes part."""
    return findings.select(F.explode(F.array_distinct("files")).alias("slug")).where("slug <> ''").groupBy("slug").agg(F.count("*").alias("findings"))


def section_ids(files: DataFrame, headings: DataFrame) -> DataFrame:
    """(id, title) of all files and headings; of a file's equal ids the last heading's."""
    names = files.select(F.concat("slug", F.lit("--file")).alias("id"), F.coalesce(F.nullif("title", F.lit("")), "slug").alias("title"), F.lit(-1).alias("pos"))
    heads = headings.select("id", F.coalesce(F.nullif("text", F.lit("")), F.nullif("anchor", F.lit("")), "id").alias("title"), F.col("pos").cast("int").alias("pos"))
    return names.unionByName(heads).groupBy("id").agg(F.max_by("title", "pos").alias("title"))


@F.pandas_udf(StringType())
def _woven(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Escaped texts with their links; of the links in a text the leftmost, and of those the longest, go first."""

    def one(text: str | None, links) -> str:
        text, out, at = text or "", [], 0
        for x in links if links is not None else ():  # by start, longest first
            if x["start"] >= at:
                end = x["start"] + len(x["id"])
                out += [escape(text[at : x["start"]]), f'<a href="#{escape(x["id"])}">{escape(x["title"])}</a>']
                at = end
        return "".join([*out, escape(text[at:])])

    return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)


def linkify(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(k, html) of texts(k, text): escaped, and section ids in them turned into links that show the section's title.

    An id is a slug, --, and an anchor, so that it can only stand around a hinge of the text: the
    begin of a run of two or more hyphens. What stands before a hinge, up to the one before, may end
    in a slug: its endings are joined to the slugs, which makes at most as many rows as the texts
    have characters. Behind a slug only beginnings as long as some anchor of its file are joined to
    the ids. No text meets an id that it does not hold, whatever their number. k has to be unique.
    """
    head = F.substring_index("id", "--", 1)
    ids = cut(ids.where(F.instr("id", "--") > 1).select(head.alias("head"), F.substring(F.col("id"), F.length(head) + 3, F.length("id")).alias("tail"), "id", "title"))
    longest = ids.agg(F.coalesce(F.max(F.length("head")), F.lit(0)).alias("head"), F.coalesce(F.max(F.length("tail")), F.lit(0)).alias("tail")).first()
    before, behind = longest["head"], longest["tail"]

    def hinges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, left, right = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                end = 0
                for m in re.finditer("--+", text):
                    row.append(i)
                    at.append(m.start())
                    left.append(text[max(end, m.start() - before) : m.start()])
                    right.append(text[m.start() + 2 : m.start() + 2 + behind])
                    end = m.start() + 2
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["k", "at", "left", "right"])

    kind = texts.schema["k"].dataType.simpleString()
    found = texts.where(F.contains("text", F.lit("--"))).select("k", "text").mapInArrow(hinges, f"k {kind}, at int, left string, right string")
    found = found.where("left <> ''").select("k", "at", "right", "left", F.explode(F.sequence(F.lit(1), F.length("left"))).alias("n"))
    found = found.select("k", "at", "right", F.expr("right(left, n)").alias("head"))
    lengths = ids.groupBy("head").agg(F.collect_set(F.length("tail")).alias("lengths"))
    found = found.join(lengths, "head").select("k", "at", "head", "right", F.explode("lengths").alias("m")).where(F.length("right") >= F.col("m"))
    found = found.select("k", (F.col("at") - F.length("head")).alias("start"), "head", F.expr("left(right, m)").alias("tail")).join(ids, ["head", "tail"])
    held = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", (-F.length("id")).alias("short"), "id", "title"))).alias("links"))
    return texts.join(held, "k", "left").select("k", _woven("text", "links").alias("html"))


def findings_zone(findings: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """The cards of the findings in their order, grouped by type; ord of the findings has to be unique."""
    findings = ordered_findings(findings)
    names = files.select(F.col("slug").alias("s"), F.coalesce(F.nullif("title", F.lit("")), "slug").alias("t"))
    # chips, texts and claims by finding, in their own order
    chips = findings.select("ord", F.posexplode("files").alias("i", "slug")).where("slug <> ''").join(names, F.col("slug") == F.col("s"), "left")
    chips = chips.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", file_link(F.col("slug"), F.coalesce("t", "slug")).alias("c")))), lambda x: x["c"]), "").alias("chips"))
    good = (F.size("claims") >= 2) & F.forall("claims", lambda c: F.coalesce(T.strip(c["claim"]) != "", F.lit(False)))
    text = lambda c: F.struct(F.lit(c).alias("field"), F.lit(0).alias("i"), F.col(c).alias("text"), F.lit(None).cast("string").alias("file"))
    told = F.transform(F.when(good, F.col("claims")).otherwise(F.array().cast(findings.schema["claims"].dataType)), lambda c, i: F.struct(F.lit("claim").alias("field"), i.alias("i"), c["claim"].alias("text"), c["file"].alias("file")))
    texts = findings.select("ord", F.explode(F.concat(F.array(text("title"), text("description")), told)).alias("x")).select(F.struct("ord", "x.field", "x.i", "x.file").alias("k"), F.coalesce("x.text", F.lit("")).alias("text"))
    said = linkify(texts, section_ids(files, headings)).select("k.*", "html").join(names, F.col("file") == F.col("s"), "left")
    who = F.when(F.col("s").isNotNull(), file_link(F.col("file"), F.col("t"))).otherwise(cat(f'<span class="{P}-node">', T.esc(F.col("file")), "</span>"))
    cell = cat(f'<div class="{P}-finding-claim"><span class="{P}-finding-claim-file">', who, "</span><p>", F.col("html"), "</p></div>")
    cells = F.array_sort(F.collect_list(F.when(F.col("field") == "claim", F.struct("i", cell.alias("c")))))
    said = said.groupBy("ord").agg(*[F.max(F.when(F.col("field") == c, F.col("html"))).alias(f"{c}_html") for c in ("title", "description")], F.nullif(F.array_join(F.transform(cells, lambda x: x["c"]), ""), F.lit("")).alias("grid"))
    # where the groups of types begin and end
    kind = F.coalesce("type", F.lit("other"))
    edges = findings.groupBy(kind.alias("kind")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    rows = findings.withColumn("kind", kind).join(edges, "kind").join(said, "ord").join(chips, "ord", "left")
    severity = F.coalesce("severity", F.lit("low"))
    icon = F.coalesce(*[F.when(severity == s, i) for s, i in SEVERITY], F.lit("○"))
    card = cat(
        f'<article class="{P}-finding {P}-severity-', severity, f'"><span class="{P}-severity-', severity, '-badge"><span aria-hidden="true">', icon, f'</span> <span class="{P}-severity-label">', T.esc(F.upper(severity)), "</span></span><h3>", F.col("title_html"), "</h3><p>", F.col("description_html"), "</p>",
        F.coalesce(cat(f'<div class="{P}-finding-compare">', F.col("grid"), "</div>"), F.lit("")), f'<div class="{P}-finding-files">', F.coalesce("chips", F.lit("")), "</div></article>",
    )
    label = F.coalesce(*[F.when(F.col("kind") == t, v) for t, v in TYPES], F.col("kind"))
    begin = F.when(F.col("place") == F.col("first"), cat(f'<div class="{P}-findings-group" data-type="', T.esc(F.col("kind")), '"><h2>', T.esc(label), "</h2>")).otherwise("")
    end = F.when(F.col("place") == F.col("last"), "</div>").otherwise("")
    return rows.select(F.lit("FINDINGS").alias("zone"), F.format_string("%019d", "place").alias("ord"), F.concat(begin, card, end).alias("html"))


def files_zone(files: DataFrame, fragments: DataFrame, findings: DataFrame) -> DataFrame:
    rows = files.join(fragments.select("slug", "html"), "slug", "left").join(findings_per_file(findings), "slug", "left")
    back = F.when(F.col("findings") > 0, cat(f'<a class="{P}-file-findings-link" href="#{P}-findings">in ', F.col("findings"), " finding", F.when(F.col("findings") == 1, "").otherwise("s"), "</a>")).otherwise(F.lit(""))
    slug, path = T.esc(F.col("slug")), T.esc(F.col("file_path"))
    body = cat(f'<section class="{P}-file" id="', slug, '--file" data-slug="', slug, f'"><header class="{P}-file-header"><h2>', T.esc(F.coalesce(F.nullif("title", F.lit("")), "slug")), f'</h2><a class="{P}-src-link" href="', path, '">', path, "</a>", back, "</header>", F.coalesce("html", F.lit("")), "</section>")
    return rows.select(F.lit("FILES").alias("zone"), F.col("file_path").alias("ord"), body.alias("html"))


def page_parts(files: DataFrame, headings: DataFrame, edges: DataFrame, findings: DataFrame, fragments: DataFrame, root: str = ".", language: str = "source") -> DataFrame:
    """All pieces of the page: (zone, ord, html). Inputs that several zones read are written once."""
    files, headings, edges, findings = cut(files), cut(headings), cut(edges), cut(findings)
    parts = [strap(files, root, language), panel(files, edges, findings), toc(files, headings), graph_zone(files, edges), findings_zone(findings, files, headings), files_zone(files, fragments, findings)]
    return reduce(DataFrame.unionByName, parts)


#: What stands before and after the pieces of each zone.
FRAMES = {
    "STRAP": ("", ""),
    "TOC": (f'<nav class="{P}-toc" id="{P}-toc"><ul>', "</ul></nav>"),
    "GRAPH": (f'<div class="{P}-graph" id="{P}-graph">', "</div>"),
    "FINDINGS": (f'<section class="{P}-findings" id="{P}-findings">', "</section>"),
    "FILES": (f'<div id="{P}-files">', "</div>"),
}
EMPTY_FINDINGS = f'<p class="{P}-findings-empty">No cross-file findings.</p>'


def inject(document: str, zone: str, body: str) -> str:
    """The document with body between the zone's markers, which stay."""
    (_, before), (_, behind) = sinks.split_shell(document, [zone])
    return f"{before}\n{body}\n{behind}"


def write_page(parts: DataFrame, shell: str) -> str:
    """The document: the shell with all zones filled. The pieces of one page come to the driver here."""
    zones: dict[str, list[str]] = {z: [] for z in H.ZONES}
    for row in parts.orderBy("zone", "ord", "html").toLocalIterator():
        zones[row["zone"]].append(row["html"])
    for zone, (before, after) in FRAMES.items():
        body = "".join(zones[zone]) or (EMPTY_FINDINGS if zone == "FINDINGS" else "")
        shell = inject(shell, zone, before + body + after)
    return shell


def default_shell() -> str:
    """A plain shell with all markers and styles for every hook."""
    styles = " ".join(f".{P}-{h}{{}}" for h in H.HOOKS)
    body = "\n".join("".join(sinks.zone_markers(z)) for z in H.ZONES)
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><style>{styles}</style></head>\n<body id="{P}-top">\n{body}\n</body></html>\n'


def page_report(files: DataFrame, edges: DataFrame, findings: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: counts of files, sections and findings, the graph's mode, and the messages of each gate; failures are rows of gate_report."""
    facts = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("n_headings"), F.lit(0)).alias("sections"))
    found = findings.agg(F.count("*").alias("findings"))
    one = lambda df: F.broadcast(df)  # noqa: E731  a single row
    row = facts.crossJoin(one(found)).crossJoin(one(G.graph_mode(files, edges).select(F.col("mode").alias("graph_mode"))))
    return row.crossJoin(one(gates.failure_arrays(failures))).select("files", "sections", "findings", "graph_mode", *gates.GATES)


def write_document(parts: DataFrame, shell: str, path: str, publish: bool = True) -> dict[str, str]:
    """Writes the page by tasks, see sources.sinks.write_page; returns the remote resources for which it was not written. publish=False: looks for them, and writes nothing."""
    return sinks.write_page(parts, [F.col("ord"), F.col("html")], path, shell, FRAMES, {"FINDINGS": EMPTY_FINDINGS}, publish)


def publish(parts: DataFrame, shell: str, files: DataFrame, edges: DataFrame, findings: DataFrame, failures: DataFrame, path: str) -> dict:
    """The page's report. The document is written to path only if no gate failed, the fourth one over the whole document included; else nothing is written."""
    failures = cut(failures)
    found = write_document(parts, shell, path, publish=failures.isEmpty())
    rows = [(i, label, found[label]) for i, (label, _) in enumerate(H.FETCHES) if label in found]
    fetched = parts.sparkSession.createDataFrame(rows, "i int, label string, what string")
    report = page_report(files, edges, findings, failures.unionByName(gates.fetch_failures(fetched)))
    return report.first().asDict(recursive=True)
