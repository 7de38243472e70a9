"""The fragment format: its class hooks and targets, and what is read from fragments and other markup. All in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup
from .entities import unescape

#: Fixed values of the fragment format: the prefix of its class hooks, and their names.
PREFIX = "mdhv"
HOOKS = (
    "keypoints", "contract", "detail", "src-link", "section", "strap", "toc", "toc-item", "graph", "node", "edge",
    "graph-caption", "findings", "finding", "severity-high", "severity-medium", "severity-low", "file", "file-header",
)
#: Page zones, whose marker comments the shell holds, and in-page targets of the shell.
ZONES = ("STRAP", "TOC", "GRAPH", "FINDINGS", "FILES")
CHROME = tuple(f"#{PREFIX}-{name}" for name in ("top", "toc", "graph", "findings", "files"))
def normalized(text: Column) -> Column:
    """The content words of a text: tags removed, references decoded, other runs one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(unescape(F.regexp_replace(text, r"<[^<>]*>", "")), r"[^\p{L}\p{N}]+", " ")))


def with_normalized(df: DataFrame, text: str, into: str) -> DataFrame:
    return df.withColumn(into, normalized(F.col(text)))


def contract_blocks(fragments: DataFrame, key: str = "slug", body: str = "html") -> DataFrame:
    """(key, blocks, open) of fragments that have contract elements, see markup.class_blocks."""
    return markup.class_blocks(fragments, key, body, f"{PREFIX}-contract")


def html_facets(fragments: DataFrame, key: str = "slug", body: str = "html") -> DataFrame:
    """(key, kind, ord, value): kind href (in-page links) or contract (texts of outermost contract elements), in document order."""
    hrefs = fragments.select(key, F.lit("href").alias("kind"), F.posexplode(markup.page_hrefs(F.col(body))).alias("ord", "value"))
    blocks = contract_blocks(fragments, key, body).select(key, F.lit("contract").alias("kind"), F.posexplode("blocks").alias("ord", "value"))
    return hrefs.unionByName(blocks)


# Fixed value: the attribute that names the source headings of an element.
COVERED = r"""(?i)data-src-heading\s*=\s*['"]([^'"]*)['"]"""


def covered_ids(body: Column) -> Column:
    """Distinct ids of all data-src-heading attributes, by pattern alone."""
    found = F.regexp_extract_all(body, F.lit(COVERED), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda v: F.split(v, r"\s+"))), lambda v: v != ""))


# Patterns of remote resources, and what to call them.
FETCHES = (
    ("external <link href> tag", r"(?i)<link\b[^>]*\bhref\s*="),
    ("<script>/<img> with http(s) src", r"""(?i)<(?:script|img)\b[^>]*\bsrc\s*=\s*['"]?\s*https?:"""),
    ("@import of a remote url", r"""(?i)@import\s+(?:url\(\s*)?['"]?\s*https?:"""),
    ("url(http...) in styles", r"""(?i)url\(\s*['"]?\s*https?:"""),
    ("remote SVG <image> href", r"""(?i)<image\b[^>]*\b(?:xlink:)?href\s*=\s*['"]?\s*https?:"""),
    ("protocol-relative resource url", r"""(?i)(?:src|href)\s*=\s*['"]\s*//"""),
)


def fetches(body: Column) -> Column:
    """array<struct<label, snippet>>: the first match of each pattern of a remote resource, in their order."""
    each = [F.struct(F.lit(label).alias("label"), F.regexp_extract(body, pattern, 0).alias("found")) for label, pattern in FETCHES]
    hits = F.filter(F.array(*each), lambda x: x["found"] != "")
    return F.transform(hits, lambda x: F.struct(x["label"].alias("label"), F.when(F.length(x["found"]) > 80, F.concat(F.substring(x["found"], 1, 80), F.lit("..."))).otherwise(x["found"]).alias("snippet")))
