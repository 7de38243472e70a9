"""A corpus of Markdown texts -> files, headings, links and name tokens.

corpus(file_path, text) has one row a file. Parsing is a narrow projection per file; only the
numbering of equal slugs and anchors shuffles, by the slug.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cut import cut

# Patterns of a front-matter block, a Markdown link and an inline code span.
FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
LINK = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
CODE = r"`([^`\n]+)`"


def with_slugs(corpus: DataFrame) -> DataFrame:
    """Adds slug; of files whose base slugs agree each gets a number, in the order of paths."""
    df = corpus.withColumn("base", T.slugify_path(F.col("file_path")))
    same = Window.partitionBy("base")
    number = F.row_number().over(same.orderBy("file_path"))
    return df.withColumn("slug", F.when(F.count("*").over(same) > 1, F.concat("base", F.lit("-"), number)).otherwise(F.col("base"))).drop("base")


def body_of(text: Column) -> Column:
    """The text without its front matter."""
    return F.regexp_replace(text, FRONT, "")


def front_matter(text: Column) -> Column:
    """array<struct<key, value, items>> of the front matter, the last of equal keys; items are null unless a list follows the key."""
    lines = F.split(F.regexp_extract(text, FRONT, 1), T.LINES)
    bare = F.transform(lines, lambda x: F.regexp_replace(x, rf"{T.SPACE}+\z", ""))
    none = F.lit(None).cast("array<string>")
    empty = F.array().cast("array<struct<key:string,value:string,items:array<string>>>")

    def step(done: Column, line: Column) -> Column:
        n, item = F.size(done), T.strip(F.regexp_extract(line, r"^\s*-\s+(.*)\z", 1))
        key = F.regexp_extract(line, r"^([A-Za-z0-9_.\-]+)\s*:\s*(.*)\z", 1)
        value = T.strip(F.regexp_extract(line, r"^([A-Za-z0-9_.\-]+)\s*:\s*(.*)\z", 2))
        last = F.get(done, n - 1)
        longer = F.struct(last["key"].alias("key"), last["value"].alias("value"), F.concat(F.coalesce(last["items"], F.array().cast("array<string>")), F.array(item)).alias("items"))
        return (
            F.when(line.rlike(r"^\s*-\s+") & (n > 0), F.concat(F.slice(done, F.lit(1), n - 1), F.array(longer)))
            .when(key != "", F.concat(done, F.array(F.struct(key.alias("key"), value.alias("value"), none.alias("items")))))
            .otherwise(done)
        )

    found = F.aggregate(F.filter(bare, lambda x: T.strip(x) != ""), empty, step)
    keys = F.transform(found, lambda e: e["key"])
    last_of_key = F.filter(found, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.startswith(text, F.lit("---")) & text.rlike(FRONT), last_of_key).otherwise(empty)


def headings_of(body: Column) -> Column:
    """array<struct<level, text>> of ATX headings outside of fenced code, in order.

    A fence ends at a line that begins with the same mark; its length and what follows are not
    compared. Only lines that may open, close or be a heading go through the fold.
    """
    mark = lambda line: F.regexp_extract(line, rf"^{T.SPACE}*(```|~~~)", 1)
    lines = F.filter(F.split(body, T.LINES), lambda x: (mark(x) != "") | x.rlike(r"^#{1,6}\s"))
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<level:int,text:string>>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        m = mark(line)
        text = T.strip_inline(F.regexp_extract(line, r"^(#{1,6})\s+(.*?)\s*#*\s*\z", 2))
        head = F.struct(F.length(F.regexp_extract(line, r"^#+", 0)).alias("level"), text.alias("text"))
        fence = F.when(m == "", s["fence"]).when(s["fence"] == "", m).when(s["fence"] == m, F.lit("")).otherwise(s["fence"])
        heading = (m == "") & (s["fence"] == "") & (text != "")
        return F.struct(fence.alias("fence"), F.when(heading, F.concat(s["out"], F.array(head))).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def links_of(body: Column, source: Column) -> Column:
    """array<struct<raw, target, type>>: Markdown links first, then inline code that names files."""
    is_code = lambda p: p.rlike(T.CODE_PATH) & ~p.rlike(T.MARKDOWN) & ~p.rlike(T.MEDIA)

    def link(raw: Column) -> Column:
        url = F.regexp_extract(raw, LINK, 2)
        low, path = F.lower(url), F.substring_index(F.substring_index(url, "#", 1), "?", 1)
        target = T.relative_target(url, source)
        kind = (
            F.when(low.rlike("^https?://"), F.lit("external_url"))
            .when(F.startswith(low, F.lit("mailto:")) | F.startswith(url, F.lit("#")), F.lit("other"))
            .when(path.rlike(T.MARKDOWN), F.when(target.isNull(), F.lit("other")).otherwise(F.lit("relative_md")))
            .when(is_code(path), F.lit("code_ref"))
            .otherwise(F.lit("other"))
        )
        return F.struct(raw.alias("raw"), F.when(kind == "relative_md", target).when(kind == "code_ref", path).otherwise(url).alias("target"), kind.alias("type"))

    def code(raw: Column) -> Column:
        token = T.strip(F.regexp_extract(raw, CODE, 1))
        md = token.rlike(T.CODE_PATH) & token.rlike(T.MARKDOWN)
        target = F.when(md, F.coalesce(T.relative_target(token, source), token)).otherwise(token)
        return F.struct(raw.alias("raw"), target.alias("target"), F.when(md, F.lit("md_ref")).when(is_code(token), F.lit("code_ref")).alias("type"))

    plain = F.transform(F.regexp_extract_all(body, F.lit(LINK), F.lit(0)), link)
    inline = F.filter(F.transform(F.regexp_extract_all(body, F.lit(CODE), F.lit(0)), code), lambda x: x["type"].isNotNull())
    return F.concat(plain, inline)


def name_tokens_of(body: Column) -> Column:
    """Distinct lower-case inline-code tokens of three characters or more that hold a hyphen and may be a file's stem."""
    tokens = F.transform(F.regexp_extract_all(body, F.lit(CODE), F.lit(1)), lambda t: F.lower(T.strip(t)))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(t, F.lit("-")) & t.rlike(r"^[A-Za-z0-9][\p{L}\p{N}_-]*\z")))


@dataclass
class Structure:
    """files(slug, file_path, language, title, token_estimate, front, n_headings); headings(slug, file_path, pos, level, text, anchor, id); links(slug, file_path, pos, raw, target, type); tokens(slug, token)."""

    files: DataFrame
    headings: DataFrame
    links: DataFrame
    tokens: DataFrame


def parse(corpus: DataFrame, keep: bool = False) -> Structure:
    """corpus(file_path, text); rows of null path are left out, null texts count as empty.

    keep writes what is parsed of each file, without its text, to the shared folder, for plans
    that read the structure more than once: texts are then parsed once, whatever the plan.
    """
    rows = corpus.where("file_path is not null").select("file_path", T.newlines(F.coalesce("text", F.lit(""))).alias("text"))
    rows = with_slugs(rows).withColumn("body", body_of(F.col("text")))
    rows = rows.select(
        "slug",
        "file_path",
        T.detect_language(F.col("body")).alias("language"),
        T.token_estimate(F.col("text")).alias("token_estimate"),
        front_matter(F.col("text")).alias("front"),
        headings_of(F.col("body")).alias("heads"),
        links_of(F.col("body"), F.col("file_path")).alias("links"),
        name_tokens_of(F.col("body")).alias("tokens"),
    )
    rows = cut(rows) if keep else rows
    heads = rows.select("slug", "file_path", F.posexplode("heads").alias("pos", "h")).select("slug", "file_path", "pos", "h.level", "h.text")
    base = heads.withColumn("base", T.anchorize(F.col("text")))
    again = F.row_number().over(Window.partitionBy("slug", "base").orderBy("pos")) - 1
    base = base.withColumn("anchor", F.when(again == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), again)))
    headings = base.select("slug", "file_path", "pos", "level", "text", "anchor", T.section_id(F.col("slug"), F.col("anchor")).alias("id"))
    title = F.coalesce(F.get(F.filter("heads", lambda h: h["level"] == 1), F.lit(0))["text"], T.humanize(F.col("file_path")))
    files = rows.select("slug", "file_path", "language", title.alias("title"), "token_estimate", F.lit("chars/4").alias("token_estimate_method"), "front", F.size("heads").alias("n_headings"))
    links = rows.select("slug", "file_path", F.posexplode("links").alias("pos", "l")).select("slug", "file_path", "pos", "l.raw", "l.target", "l.type")
    tokens = rows.select("slug", F.explode("tokens").alias("token"))
    return Structure(files, headings, links, tokens)


def front_rows(files: DataFrame) -> DataFrame:
    """(slug, key, kind, value): one row a key; lists joined by commas."""
    rows = files.select("slug", F.explode("front").alias("f")).select("slug", "f.key", "f.value", "f.items")
    items = F.array_join(F.transform("items", lambda v: F.coalesce(T.scalar_value(v), F.lit("null"))), ",")
    # a key without value is the empty string until a list follows
    kind = F.when(F.col("items").isNotNull(), "list").when(F.col("value") == "", "string").otherwise(T.scalar_kind(F.col("value")))
    value = F.when(F.col("items").isNotNull(), items).when(F.col("value") == "", F.lit("")).otherwise(T.scalar_value(F.col("value")))
    return rows.select("slug", "key", kind.alias("kind"), value.alias("value"))


def _value_json(f: Column) -> Column:
    """The value of one entry of the front matter as JSON: a list, the empty string of a key without value, or a scalar."""
    items = F.concat(F.lit("["), F.array_join(F.transform(f["items"], T.scalar_json), ","), F.lit("]"))
    return F.when(f["items"].isNotNull(), items).when(f["value"] == "", F.lit('""')).otherwise(T.scalar_json(f["value"]))


def front_typed(files: DataFrame) -> DataFrame:
    """Adds typed, a VARIANT object of the front matter's typed values by key; null where there is none. Read it with variant_get.

    Integers of more than 38 digits become doubles.
    """
    pair = lambda f: F.concat(F.regexp_extract(F.to_json(F.array(f["key"])), r"(?s)^\[(.*)\]\z", 1), F.lit(":"), _value_json(f))
    whole = F.concat(F.lit("{"), F.array_join(F.transform("front", pair), ","), F.lit("}"))
    return files.withColumn("typed", F.parse_json(F.when(F.size("front") > 0, whole)))


def front_schema(files: DataFrame) -> DataFrame:
    """(key, type, files): the one type that holds a key's values in all files, merged before the shuffle, and how many files have the key. Types that have none in common are VARIANT."""
    rows = files.select(F.explode("front").alias("f")).select("f.key", F.parse_json(_value_json(F.col("f"))).alias("v"))
    return rows.groupBy("key").agg(F.schema_of_variant_agg("v").alias("type"), F.count("*").alias("files"))


def groups(files: DataFrame) -> DataFrame:
    """(group, file_count, token_estimate, members, files): one row a folder; members are slugs, files short records, both in the order of paths."""
    rows = files.withColumn("group", T.group_of(F.col("file_path")))
    inside = F.array_sort(F.collect_list(F.struct("file_path", "slug", "title", "token_estimate")))
    out = rows.groupBy("group").agg(F.count("*").alias("file_count"), F.sum("token_estimate").alias("token_estimate"), inside.alias("m"))
    short = F.transform("m", lambda x: F.struct(x["slug"].alias("slug"), x["file_path"].alias("file_path"), x["title"].alias("title"), x["token_estimate"].alias("token_estimate")))
    return out.select("group", "file_count", "token_estimate", F.transform("m", lambda x: x["slug"]).alias("members"), short.alias("files"))


def records(structure: Structure, links: DataFrame) -> DataFrame:
    """One record a file, with its front matter, headings and links nested in their order; links are those with resolved_slug."""
    heads = structure.headings.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text", "anchor"))).alias("h"))
    refs = links.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "target", "type", "resolved_slug"))).alias("l"))
    rows = structure.files.join(heads, "slug", "left").join(refs, "slug", "left")
    headings = F.transform(F.coalesce("h", F.array().cast("array<struct<pos:int,level:int,text:string,anchor:string>>")), lambda x: x.dropFields("pos"))
    links = F.transform(F.coalesce("l", F.array().cast("array<struct<pos:int,raw:string,target:string,type:string,resolved_slug:string>>")), lambda x: x.dropFields("pos"))
    return rows.select("slug", "file_path", "language", "title", "token_estimate", "token_estimate_method", F.when(F.size("front") > 0, F.col("front")).alias("front"), headings.alias("headings"), links.alias("links"))
