"""Checks of rendered fragments against their sources, and the repair of what can be repaired without loss.

Inputs are tables: files, headings (see structure), fragments(slug, html), sections(slug, ord,
id, source_headings), contracts(slug, ord, text), sources(slug, text).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.cut import cut
from ..functions import markup
from ..functions.html import PREFIX


def fragments_of(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """One fragment a file; empty where there is none."""
    return files.select("slug").join(fragments.select("slug", "html"), "slug", "left").select("slug", F.coalesce("html", F.lit("")).alias("html"))


def dangling_anchors(files: DataFrame, headings: DataFrame, fragments: DataFrame) -> DataFrame:
    """(slug, ord, href): in-page links that are neither a heading's id, nor the shell's, nor bare."""
    hrefs = H.html_facets(fragments_of(files, fragments)).where("kind = 'href'").select("slug", "ord", F.col("value").alias("href"))
    hrefs = hrefs.where((F.col("href") != "#") & ~F.col("href").isin(*H.CHROME))
    return hrefs.join(headings.select(F.concat(F.lit("#"), "id").alias("href")), "href", "left_anti").select("slug", "ord", "href")


def coverage_gaps(files: DataFrame, headings: DataFrame, fragments: DataFrame) -> DataFrame:
    """(slug, id): heading ids that no data-src-heading of the file's own fragment names."""
    got = fragments_of(files, fragments).select("slug", F.explode(H.covered_ids(F.col("html"))).alias("id"))
    return headings.select("slug", "id").distinct().join(got, ["slug", "id"], "left_anti")


def contract_text(fragments: DataFrame) -> DataFrame:
    """(slug, shown): the normalised texts of a fragment's contract elements, joined in order."""
    return H.contract_blocks(fragments).select("slug", _shown(F.col("blocks")).alias("shown"))


def _shown(blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(blocks, H.normalized), lambda w: w != ""), " ")


def contract_violations(contracts: DataFrame, sources: DataFrame, fragments: DataFrame) -> DataFrame:
    """(slug, ord, needle, missing_in): contracts that their source lacks, or else their fragment. Empty ones pass; a contract without source fails.

    Sources and fragments are normalised once a file, before contracts are joined to them.
    """
    needles = H.with_normalized(contracts.select("slug", "ord", "text").where("text is not null"), "text", "needle").where("needle <> ''").select("slug", "ord", "needle")
    source = H.with_normalized(sources.select("slug", "text"), "text", "src").select("slug", "src")
    rows = needles.join(source, "slug", "left").join(contract_text(fragments), "slug", "left")
    in_source = F.coalesce(T.contract_present(F.col("needle"), F.col("src")), F.lit(False))
    shown = T.contract_present(F.col("needle"), F.coalesce("shown", F.lit("")))
    out = rows.withColumn("missing_in", F.when(~in_source, "source").when(~shown, "fragment"))
    return out.where("missing_in is not null").select("slug", "ord", "needle", "missing_in")


def external_fetches(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, label, snippet): the first remote resource of each kind in a document."""
    return documents.select(key, F.explode(H.fetches(F.col(body))).alias("f")).select(key, "f.label", "f.snippet")


# The gates in their order, and the wording of their failures.
GATES = ("dangling_anchors", "coverage_gaps", "contract_violations", "external_fetches")
NO_TARGET = " resolves to no heading id or chrome anchor"
NOT_COVERED = " not covered by any data-src-heading in the fragment"
NO_CONTRACT = {"source": ": contract not found in source bytes: ", "fragment": f": contract not found in fragment .{PREFIX}-contract text: "}


def gate_report(files: DataFrame, headings: DataFrame, fragments: DataFrame, contracts: DataFrame, sources: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(gate, path, ord, slug, item, message) of every violation; empty means that a page may be written.

    pages(html) are written documents, for the fourth gate. Failures of a gate have the order
    (path, ord, item): of files by path, of contracts by slug, of pages by kind of resource.
    """
    at = files.select("slug", F.col("file_path").alias("path"))
    a = dangling_anchors(files, headings, fragments).join(at, "slug")
    a = a.select(F.lit(GATES[0]).alias("gate"), "path", "ord", "slug", F.col("href").alias("item"), F.concat("slug", F.lit(": href "), T.quoted(F.col("href")), F.lit(NO_TARGET)).alias("message"))
    b = coverage_gaps(files, headings, fragments).join(at, "slug")
    b = b.select(F.lit(GATES[1]).alias("gate"), "path", F.lit(0).alias("ord"), "slug", F.col("id").alias("item"), F.concat("slug", F.lit(": source heading id "), T.quoted(F.col("id")), F.lit(NOT_COVERED)).alias("message"))
    c = contract_violations(contracts, sources, fragments)
    where = F.when(F.col("missing_in") == "source", NO_CONTRACT["source"]).otherwise(NO_CONTRACT["fragment"])
    c = c.select(F.lit(GATES[2]).alias("gate"), F.col("slug").alias("path"), F.col("ord").cast("int").alias("ord"), "slug", F.col("needle").alias("item"), F.concat("slug", where, T.quoted(F.col("needle"))).alias("message"))
    out = a.unionByName(b).unionByName(c)
    return out if pages is None else out.unionByName(page_failures(pages))


def page_failures(pages: DataFrame) -> DataFrame:
    """The fourth gate's rows of a report: pages(html) that load anything from elsewhere."""
    rows = pages.select(F.posexplode(H.fetches(F.col("html"))).alias("ord", "f"))
    return _fetch_rows(rows.select("ord", "f.label", "f.snippet"))


def fetch_failures(found: DataFrame) -> DataFrame:
    """The same of found(i, label, what): what a page loads from elsewhere, whole, by the kind's place."""
    return _fetch_rows(found.select(F.col("i").alias("ord"), "label", F.when(F.length("what") > 80, F.concat(F.substring("what", 1, 80), F.lit("..."))).otherwise(F.col("what")).alias("snippet")))


def _fetch_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(GATES[3]).alias("gate"), F.lit("").alias("path"), "ord", F.lit("").alias("slug"), F.col("snippet").alias("item"), F.concat("label", F.lit(": "), T.quoted(F.col("snippet"))).alias("message"))


def failure_arrays(report: DataFrame) -> DataFrame:
    """One row with the ordered messages of each gate, for the report of a page."""
    mine = lambda g: F.collect_list(F.when(F.col("gate") == g, F.struct("path", "ord", "item", "message")))
    return report.agg(*[F.transform(F.array_sort(mine(g)), lambda x: x["message"]).alias(g) for g in GATES])


def reconcile_coverage(files: DataFrame, headings: DataFrame, fragments: DataFrame, sections: DataFrame) -> DataFrame:
    """(slug, id, section_id): ids a fragment lacks, with the first section that claims their heading; null: a genuine gap."""
    missing = coverage_gaps(files, headings, fragments).join(headings.select("slug", "id", "anchor").distinct(), ["slug", "id"])
    claims = sections.select("slug", "ord", F.col("id").alias("section_id"), F.explode("source_headings").alias("anchor"))
    first = claims.groupBy("slug", "anchor").agg(F.min_by("section_id", "ord").alias("section_id"))
    return missing.join(first, ["slug", "anchor"], "left").select("slug", "id", "section_id")


@dataclass
class Reconciled:
    """fragments(slug, html, changed); contracts(slug, ord, text); report(bucket, kind, slug, item) with bucket auto_closed or genuine_gaps."""

    fragments: DataFrame
    contracts: DataFrame
    report: DataFrame


def closed(body: Column, ids: Column) -> Column:
    """The fragment with a hidden span for each of ids(id, section_id), right behind the first tag with the section's id, or at the end.

    A pattern takes all up to that tag's end; double quotes are looked for before single ones.
    """

    def put(done: Column, x: Column) -> Column:
        name = T.esc(x["id"])
        # Fixed value: the span that stands for a heading.
        span = F.concat(F.lit('<span id="'), name, F.lit('" data-src-heading="'), name, F.lit('" aria-hidden="true"></span>'))
        upto = [F.regexp_substr(done, F.concat(F.lit(rf"(?s)\A.*?id={quote}\Q"), x["section_id"], F.lit(rf"\E{quote}[^>]*>"))) for quote in ('"', "'")]
        head = F.coalesce(*upto, done)
        return F.concat(head, span, F.substring(done, F.length(head) + 1, F.length(done)))

    return F.aggregate(F.coalesce(ids, F.array().cast("array<struct<id:string,section_id:string>>")), body, put)


def _words(text: str) -> str:
    plain = html.unescape(re.sub(r"<[^<>]*>", "", text))
    return re.sub(r"[\W_]+", " ", plain).strip().lower()


def _present(needle: str, hay: str) -> bool:
    if needle in hay:
        return True
    n, h = needle.split(), hay.split()
    reach = max(3 * len(n), len(n) + 20)
    for start in (i for i, w in enumerate(h) if w == n[0]):
        rest = iter(h[start : start + reach])
        if all(w in rest for w in n):
            return True
    return False


def reconcile(files: DataFrame, headings: DataFrame, fragments: DataFrame, sections: DataFrame, contracts: DataFrame, sources: DataFrame) -> Reconciled:
    """Closes what loses nothing: ids that a section claims, duplicate contracts, contracts of the source that the fragment does not show.

    Contracts are looked at one after the other, as each may change the fragment for the next,
    so a file's are folded in one call; files are independent of each other. Only files that
    have a fragment take part. A second run changes nothing.
    """
    have = fragments.select("slug", "html").join(files.select("slug"), "slug", "left_semi")
    claimed = reconcile_coverage(files, headings, have, sections).join(have.select("slug"), "slug", "left_semi")
    claims = claimed.where("section_id is not null").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("id", "section_id"))).alias("ids"))
    wanted = contracts.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("contracts"))
    bodies = cut(have.join(claims, "slug", "left").select("slug", "html", closed(F.col("html"), F.col("ids")).alias("body")))
    blocks = H.contract_blocks(bodies, body="body").select("slug", _shown(F.col("blocks")).alias("shown"), "open")
    rows = bodies.join(blocks, "slug", "left").join(wanted, "slug", "left").join(sources.select("slug", F.col("text").alias("source")), "slug", "left")
    # where an element or tag is left open at the end, what is appended is not an element of its own
    rows = rows.select("slug", "html", "body", "contracts", "source", F.coalesce("shown", F.lit("")).alias("shown"), (F.coalesce("open", F.lit(False)) | markup.unfinished(F.col("body"))).alias("open"))

    def fold(batches):
        for b in batches:
            out = []
            for slug, source, body, wants, text, shown, ajar in zip(b["slug"], b["html"], b["body"], b["contracts"], b["source"], b["shown"], b["open"], strict=True):
                kept, items, seen, src = [], [], set(), _words(text or "")
                for c in wants if wants is not None else ():
                    needle = _words(c["text"] or "")
                    if needle and needle in seen:
                        items.append(("auto_closed", "duplicate", needle))
                        continue
                    kept.append((int(c["ord"]), c["text"]))
                    seen.add(needle)
                    if not needle:
                        continue
                    if not _present(needle, src):
                        items.append(("genuine_gaps", "contracts", needle))
                    elif not _present(needle, shown):
                        body += f'<div class="{PREFIX}-contract">{html.escape(c["text"])}</div>'
                        shown = shown if ajar else f"{shown} {needle}".strip()
                        items.append(("auto_closed", "contracts", needle))
                out.append((slug, body, body != source, kept, items))
            yield pd.DataFrame(out, columns=["slug", "html", "changed", "kept", "items"])

    done = rows.mapInPandas(fold, "slug string, html string, changed boolean, kept array<struct<ord:int,text:string>>, items array<struct<bucket:string,kind:string,item:string>>")
    done = cut(done)
    report = done.select("slug", F.explode("items").alias("i")).select("i.bucket", "i.kind", "slug", "i.item")
    cover = claimed.select(F.when(F.col("section_id").isNull(), "genuine_gaps").otherwise("auto_closed").alias("bucket"), F.lit("coverage").alias("kind"), "slug", F.col("id").alias("item"))
    anchors = dangling_anchors(files, headings, done.select("slug", "html")).select(F.lit("genuine_gaps").alias("bucket"), F.lit("anchors").alias("kind"), "slug", F.col("href").alias("item"))
    kept = done.select("slug", F.explode("kept").alias("k")).select("slug", "k.ord", "k.text")
    return Reconciled(done.select("slug", "html", "changed"), kept, cover.unionByName(report).unionByName(anchors))


# Buckets and kinds of a repair's report, in their order.
BUCKETS, KINDS = ("auto_closed", "genuine_gaps"), ("coverage", "contracts", "anchors")


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row (n, total, parity): the rows, the sum of one hash and the exclusive or of another, which no order of rows changes. Nulls count; equal rows are told by the sum."""
    seeded = lambda seed: F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])
    return df.agg(F.count("*").alias("n"), F.sum(seeded(1).cast("decimal(38,0)")).alias("total"), F.bit_xor(seeded(2)).alias("parity"))


def compare(first: Reconciled, again: Reconciled) -> DataFrame:
    """(part, n_rows, n_changed, equal) for the fragments, contracts and genuine gaps of two runs: the rows of the first, what the second still changes or closes, and whether the digests of both agree.

    Of each table one row is left before any two meet, so that nothing is joined by key.
    """
    gaps = F.col("bucket") == "genuine_gaps"
    parts = (
        ("fragments", ("slug", "html"), lambda r: r.fragments, again.fragments.where("changed")),
        ("contracts", ("slug", "ord", "text"), lambda r: r.contracts, again.report.where((F.col("bucket") == "auto_closed") & (F.col("kind") == "duplicate"))),
        ("genuine_gaps", ("kind", "slug", "item"), lambda r: r.report.where(gaps), again.report.where(~gaps)),
    )
    out = None
    for name, columns, of, changes in parts:
        one = digest(of(first), *columns).crossJoin(F.broadcast(digest(of(again), *columns).select(F.struct("n", "total", "parity").alias("b"))))
        one = one.crossJoin(F.broadcast(changes.agg(F.count("*").alias("n_changed"))))
        row = one.select(F.lit(name).alias("part"), F.col("n").alias("n_rows"), "n_changed", F.struct("n", "total", "parity").eqNullSafe(F.col("b")).alias("equal"))
        out = row if out is None else out.unionByName(row)
    return out


def exit_status(report: DataFrame) -> int:
    """Of a repair's report: 1 if a genuine gap of some kind is left, else 0."""
    return int(not report.where((F.col("bucket") == "genuine_gaps") & F.col("kind").isin(*KINDS)).isEmpty())


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ord, from 0, within by."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
