"""HTML as a sequence of tokens, by patterns inside the JVM: tags with their attributes, texts, and the nesting of elements.

One pattern cuts a document into tokens without a gap. What a lenient reader makes of broken markup
is part of the pattern: an unfinished tag or comment is text up to the next `>`, scripts and styles
are raw up to their end tag, and a malformed marked section ends the document.

Nesting is arithmetic over token positions. Each start tag is a step up, each end tag a step down
whatever its name, and none below zero, so that the depth is a running sum less its running
minimum. Among the steps that leave from or come back to one depth, the next one in order closes
an element. Only documents that have an element in question are exploded into tokens; they are
shuffled once, by their key, which has to be one document's, and a document's tokens are sorted in
one task, which can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import unescape

# White space of tags, Unicode's included: what a class holds, and the class.
IN_SPACE = r"\s\x1C-\x1F\x85\p{Z}"
SPACE = f"[{IN_SPACE}]"
NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*+"
#: What may stand between a name and its attributes, and behind each.
GAP = f"(?:{SPACE}|/(?!>))*+"


def _attribute(group: str) -> str:
    """An attribute's pattern; group opens the groups of its name and value. An unclosed quote leaves a value out."""
    value = rf"""{group}'[^']*'|"[^"]*"|(?!['"])[^>{IN_SPACE}]*+)"""
    return rf"{group}[^{IN_SPACE}/>][^{IN_SPACE}/=>]*+)(?:{SPACE}*+=+{SPACE}*{value})?+"


#: Attributes stand behind a blank, slash or quote.
ATTRIBUTE = rf"""(?<=['"{IN_SPACE}/]){_attribute("(?:")}{GAP}"""
ATTRIBUTES = f"{GAP}(?:{ATTRIBUTE})*+"
HEAD = f"<{NAME}{ATTRIBUTES}"
TAG = rf"\A{HEAD}/?>"
# Marked sections that are known, by what closes them.
SECTION = r"<!\[(?i:temp|cdata|ignore|include|rcdata)(?![-_.a-zA-Z0-9])"
CONDITION = r"<!\[(?i:if|else|endif)(?![-_.a-zA-Z0-9])"
TOKEN = "|".join([
    rf"<(?i:(script|style))(?=[\t\n\r\f />\x00]){ATTRIBUTES}>(?:[\s\S]*?(?=</{SPACE}*(?i:\1){SPACE}*>)|[\s\S]*)",
    f"{HEAD}/?>",
    f"{HEAD}(?=[^a-zA-Z=/>])",
    rf"</{SPACE}*[a-zA-Z][-.a-zA-Z0-9:_]*{SPACE}*>|</[^>]*>",
    rf"<!--[\s\S]*?--{SPACE}*>",
    r"<\?[^>]*>",
    rf"{SECTION}(?!{SPACE}*\z)[\s\S]*?\]{SPACE}*\]{SPACE}*>",
    rf"{CONDITION}(?!{SPACE}*\z)[\s\S]*?\]{SPACE}*>",
    rf"(?!{SECTION}|{CONDITION})<!\[(?![a-zA-Z][-_.a-zA-Z0-9]*{SPACE}*\z)[\s\S]+",
    r"<!(?!--|\[)[^>]*>",
    r"(<(?=[a-zA-Z/!?])[^>]*>)",
    r"<[^<]*",
    r"[^<]+",
])
#: Tokens that are neither tags nor text: comments, declarations, instructions, sections, nameless end tags.
SILENT = rf"\A(?:</[\s\S]*>|<!--[\s\S]*--{SPACE}*>|<\?[\s\S]*>|{SECTION}[\s\S]*\]{SPACE}*\]{SPACE}*>|{CONDITION}[\s\S]*\]{SPACE}*>|(?!{SECTION}|{CONDITION})<!\[(?![a-zA-Z][-_.a-zA-Z0-9]*{SPACE}*\z)[\s\S]+|<!(?!--|\[)[\s\S]*>)\z"
# Elements without an end tag, and those that break a line.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BREAKING = ("br", "p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr")


def tokens(body: Column) -> Column:
    """array<struct<text, tag>>: the document's tokens in order; joined, they are the document. tag: a start tag.

    What is text because it does not end as a tag may well look like one when it stands alone, so
    the pattern's group of such text is taken as well.
    """
    each = F.arrays_zip(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)).alias("t"), F.regexp_extract_all(body, F.lit(TOKEN), F.lit(2)).alias("odd"))
    return F.transform(each, lambda x: F.struct(x["t"].alias("text"), ((x["odd"] == "") & x["t"].rlike(TAG)).alias("tag")))


def start_name(token: Column) -> Column:
    """The element that a start tag opens, in lower case; empty for other tokens."""
    return F.when(token["tag"], F.lower(F.regexp_extract(token["text"], f"^<({NAME})", 1))).otherwise(F.lit(""))


def end_name(token: Column) -> Column:
    """The element that an end tag names, in lower case; empty for other tokens."""
    tight = F.regexp_extract(token, rf"\A</{SPACE}*([a-zA-Z][-.a-zA-Z0-9:_]*){SPACE}*>\z", 1)
    loose = F.regexp_extract(token, rf"\A</({NAME})[\s\S]*>\z", 1)
    return F.lower(F.when(tight != "", tight).otherwise(loose))


def attributes(tag: Column) -> Column:
    """array<struct<name, value>> of a start tag in order; names in lower case, values decoded, null where there is no `=`."""
    inside = F.regexp_extract(tag, rf"\A<{NAME}({ATTRIBUTES})", 1)
    whole = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))

    def parsed(a: Column) -> Column:
        name, value = (F.regexp_extract(a, rf"\A{_attribute('(')}", i) for i in (1, 2))
        quoted = (F.length(value) > 1) & F.substring(value, 1, 1).isin("'", '"')
        value = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        bare = F.regexp_extract(a, rf"\A[^{IN_SPACE}/>][^{IN_SPACE}/=>]*+{SPACE}*+=", 0) == ""
        return F.struct(F.lower(name).alias("name"), F.when(~bare, unescape(value)).alias("value"))

    return F.transform(whole, parsed)


def has_class(tag: Column, name: str) -> Column:
    """Whether a start tag is of the class."""
    return F.exists(attributes(tag), lambda a: (a["name"] == "class") & F.array_contains(F.split(F.coalesce(a["value"], F.lit("")), f"{SPACE}+"), name))


def page_hrefs(body: Column) -> Column:
    """The in-page targets (`#...`) of all <a> tags in order."""
    links = F.filter(tokens(body), lambda t: t["tag"] & t["text"].rlike(r"\A<[aA][\t\n\r\f />\x00]"))
    values = F.flatten(F.transform(links, lambda t: F.transform(F.filter(attributes(t["text"]), lambda a: (a["name"] == "href") & a["value"].startswith("#")), lambda a: a["value"])))
    return F.when(F.contains(body, F.lit("<")), values).otherwise(F.array().cast("array<string>"))


def unfinished(body: Column) -> Column:
    """Whether the document ends within a tag, comment or raw element, so that what is appended is not read as markup."""
    last = F.transform(F.slice(tokens(body), -1, 1), lambda t: F.when(t["tag"], t["text"].rlike(r"\A<(?i:script|style)[\t\n\r\f />\x00]") & ~t["text"].rlike(rf"\A{HEAD}/>")).otherwise(t["text"].rlike(r"\A<[a-zA-Z/!?]") & ~t["text"].rlike(SILENT)))
    return F.coalesce(F.get(last, F.lit(0)), F.lit(False))


def class_blocks(documents: DataFrame, key: str, body: str, name: str) -> DataFrame:
    """(key, blocks, open): the texts of the outermost elements of a class in order, of documents that have any; open: the last such element is never closed, and is no block.

    Elements that break a line leave a blank. key has to be unique.
    """
    rows = documents.where(F.contains(F.col(body), F.lit("<"))).select(F.col(key).alias("k"), tokens(F.col(body)).alias("t"))
    rows = rows.where(F.exists("t", lambda t: t["tag"] & t["text"].rlike(r"(?i)class") & has_class(t["text"], name)))
    rows = rows.select("k", F.size("t").alias("size"), F.posexplode("t").alias("pos", "token"))
    t = F.col("token.text")
    rows = rows.withColumns({"opens": start_name(F.col("token")), "closes": F.when(t.startswith("</"), end_name(t)).otherwise("")})
    opens, closes = F.col("opens"), F.col("closes")
    # raw text without its end tag is none
    script = F.when(F.col("pos") < F.col("size") - 1, F.substring(t, F.length(F.regexp_extract(t, TAG, 0)) + 1, F.length(t))).otherwise("")
    odd = t.rlike(rf"\A{HEAD}\z") & (F.col("pos") < F.col("size") - 1)  # a tag that some other sign cuts off is text as it stands
    rows = rows.select(
        "k", "pos",
        F.when((opens != "") & ~opens.isin(*VOID) & ~t.rlike(rf"\A{HEAD}/>"), 1).when((closes != "") & ~closes.isin(*VOID), -1).otherwise(0).alias("step"),
        ((opens != "") & has_class(t, name)).alias("named"),
        (opens.isin(*BREAKING) | (closes.isin(*BREAKING) & ~closes.isin(*VOID))).alias("breaks"),
        F.when(opens.isin("script", "style") & ~t.rlike(rf"\A{HEAD}/>"), script).when((opens != "") | (closes != "") | t.rlike(SILENT), "").when(odd, t).otherwise(unescape(t)).alias("text"),
    )
    along, upto = Window.partitionBy("k").orderBy("pos"), (Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("step").over(along.rowsBetween(*upto)))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(along.rowsBetween(*upto)), F.lit(0)))
    rows = rows.withColumn("before", F.lag("depth", 1, 0).over(along))
    rows = rows.withColumn("level", F.when(F.col("step") == 1, F.col("before")).when((F.col("step") == -1) & (F.col("before") > 0), F.col("depth")))
    never = 2**31 - 1
    rows = rows.withColumn("stop", F.when((F.col("step") == 1) & F.col("named"), F.coalesce(F.lead("pos").over(Window.partitionBy("k", "level").orderBy("pos")), F.lit(never))))
    rows = rows.withColumn("outer", F.col("stop").isNotNull() & (F.coalesce(F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("pos")))
    rows = rows.withColumns({c: F.last(F.when(F.col("outer"), F.col(v)), ignorenulls=True).over(along.rowsBetween(*upto)) for c, v in (("start", "pos"), ("last", "stop"))})
    rows = rows.where(F.col("pos") <= F.col("last"))
    piece = F.concat(F.when(F.col("breaks") & (F.col("pos") > F.col("start")), " ").otherwise(""), "text")
    pieces = rows.groupBy("k", "start").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    blocks = pieces.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("last") < never, F.struct("start", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))))).alias("b"), F.bool_or(F.col("last") == never).alias("open"))
    return blocks.select(F.col("k").alias(key), F.transform("b", lambda x: x["text"]).alias("blocks"), "open")
