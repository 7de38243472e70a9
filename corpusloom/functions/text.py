"""Column builders for slugs, paths, anchors and text measures. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the corpus, and of links that are media, not code.
MARKDOWN = r"(?i)\.(md|markdown)\z"
MEDIA = r"(?i)\.(png|jpg|jpeg|gif|svg|webp|bmp|ico|pdf|mp4|mov|webm|mp3|wav|zip|tar|gz)\z"
CODE_PATH = r"^[\p{L}\p{N}_./-]+\.[A-Za-z0-9]+\z"
#: Python's str.splitlines() separators; white space that str.strip() takes.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def newlines(c: Column) -> Column:
    """What reading a file as text makes of its line ends."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def group_of(path: Column) -> Column:
    return F.coalesce(F.nullif(dirname(path), F.lit("")), F.lit("."))


def no_extension(path: Column) -> Column:
    return F.regexp_replace(path, MARKDOWN, "")


def slugify_path(path: Column) -> Column:
    slug = F.lower(F.trim(F.regexp_replace(no_extension(path), r"[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.when(slug == "", F.lit("file")).otherwise(slug)


def anchorize(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{M}\p{N}_\s\p{Z}-]", ""), F.lit(" "), F.lit("-"))


def humanize(path: Column) -> Column:
    words = F.filter(F.split(no_extension(basename(path)), r"[^a-zA-Z0-9]+"), lambda w: w != "")
    first = F.get(words, F.lit(0))
    first = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    rest = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.lower(w))
    bare = F.coalesce(F.nullif(no_extension(basename(path)), F.lit("")), path)
    return F.when(F.size(words) == 0, bare).otherwise(F.array_join(F.concat(F.array(first), rest), " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, halves to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(4.0), 0).cast("int"))


def name_key(path: Column) -> Column:
    return F.lower(strip(no_extension(basename(path))))


def normalize_path(path: Column) -> Column:
    """The path with empty, '.' and '..' parts resolved; '..' parts that climb out stay in front."""

    def step(done: Column, part: Column) -> Column:
        n = F.size(done)
        last = F.get(done, n - 1)
        back = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, F.lit(1), n - 1)).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    rooted = F.startswith(path, F.lit("/"))
    return F.when(rooted, F.concat(F.lit("/"), F.regexp_replace(joined, r"^(\.\./)*(\.\.\z)?", ""))).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def _no_fragment(target: Column) -> Column:
    return F.substring_index(F.substring_index(target, "#", 1), "?", 1)


def relative_target(target: Column, source: Column) -> Column:
    """A link's target from the corpus root; null if empty, the root itself, or outside of it."""
    path, folder = _no_fragment(target), dirname(source)
    joined = F.when(F.startswith(path, F.lit("/")) | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path))
    out = normalize_path(joined)
    return F.when((path != "") & ~out.isin(".", "..") & ~F.startswith(out, F.lit("../")), out)


def root_target(raw: Column) -> Column:
    """The token of a link read from the corpus root; null without a folder, or outside of the root."""
    bare = strip(raw)
    ticked = F.startswith(bare, F.lit("`")) & F.endswith(bare, F.lit("`"))
    inside = F.when(ticked, strip(F.trim(bare, F.lit("`")))).otherwise(F.regexp_extract(bare, r"\]\(\s*([^)]+?)\s*\)", 1))
    token = strip(_no_fragment(F.get(F.split(strip(inside), rf"{SPACE}+"), F.lit(0))))
    out = normalize_path(token)
    return F.when((token != "") & ~out.isin(".", "..") & ~F.startswith(out, F.lit("../")) & F.contains(out, F.lit("/")), out)


def strip_inline(text: Column) -> Column:
    """Heading text without link wrappers, backticks and emphasis marks."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return strip(F.regexp_replace(out, r"[`*_]", ""))


def scalar_kind(value: Column) -> Column:
    """Kind of a front-matter scalar: string, bool, null, int or float."""
    low = F.lower(value)
    return (
        F.when(_quoted(value), F.lit("string"))
        .when(low.isin("true", "yes", "false", "no"), F.lit("bool"))
        .when(low.isin("null", "~", ""), F.lit("null"))
        .when(value.rlike(r"^-?\d+\z"), F.lit("int"))
        .when(value.rlike(r"^-?\d+\.\d+\z"), F.lit("float"))
        .otherwise(F.lit("string"))
    )


def _quoted(value: Column) -> Column:
    return value.rlike(r"""(?s)^('.*'|".*")\z""") & (F.length(value) >= 2)


def scalar_value(value: Column) -> Column:
    """Canonical text of a front-matter scalar; null for null."""
    kind = scalar_kind(value)
    number = F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1")
    return (
        F.when(_quoted(value), F.substring(value, F.lit(2), F.length(value) - 2))
        .when(kind == "bool", F.when(F.lower(value).isin("true", "yes"), F.lit("true")).otherwise(F.lit("false")))
        .when(kind == "null", F.lit(None))
        .when(kind == "int", F.when(number == "-0", F.lit("0")).otherwise(number))
        .when(kind == "float", value.cast("double").cast("string"))
        .otherwise(value)
    )


def scalar_json(value: Column) -> Column:
    """A front-matter scalar as JSON, so that parse_json gives a value of its kind; 'null' for null.

    Decimals get an exponent, which makes them doubles and not decimals of as many digits as
    they are written with. What no double can hold stays a string.
    """
    kind, canonical = scalar_kind(value), scalar_value(value)
    string = F.to_json(F.array(F.coalesce(canonical, F.lit(""))))
    string = F.substring(string, F.lit(2), F.length(string) - 2)
    double = F.when(F.contains(canonical, F.lit("Infinity")), F.concat(F.lit('"'), value, F.lit('"'))).when(F.contains(canonical, F.lit("E")), canonical).otherwise(F.concat(canonical, F.lit("E0")))
    return F.when(kind == "null", F.lit("null")).when(kind.isin("bool", "int"), canonical).when(kind == "float", double).otherwise(string)


# Language codes and the code points of their scripts; Latin last.
SCRIPTS = (
    ("ru", r"Ѐ-ӿ"),
    ("zh", r"一-鿿"),
    ("ja", r"぀-ヿ"),
    ("ko", r"가-힣"),
    ("ar", r"؀-ۿ"),
    ("he", r"֐-׿"),
    ("el", r"Ͱ-Ͽ"),
    ("en", r"A-Za-zªµºÀ-ÖØ-öø-ɏ"),
)


def detect_language(body: Column) -> Column:
    """The script of most letters; Latin (en) yields to another one of a fifth or more; ties go to the script met first."""
    seen = lambda r: F.length(body) - F.length(F.regexp_replace(body, f"[{r}]", ""))
    first = lambda r: -F.length(F.regexp_extract(body, f"(?s)^[^{r}]*", 0))
    counts = F.array(*[F.struct(seen(r).alias("n"), first(r).alias("at"), F.lit(code).alias("code")) for code, r in SCRIPTS])
    # letters of the Arabic and Hebrew ranges never overlap, so a character counts once
    found = F.filter(counts, lambda s: s["n"] > 0)
    best = F.array_max(found)
    other = F.array_max(F.filter(found, lambda s: s["code"] != "en"))
    total = F.aggregate(found, F.lit(0), lambda a, s: a + s["n"])
    return F.when(F.size(found) == 0, F.lit("en")).when((best["code"] == "en") & (other["n"] >= total * 0.2), other["code"]).otherwise(best["code"])


def esc(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def quoted(c: Column) -> Column:
    """The text between quotes: single ones, or double ones if it holds only single ones; backslashes and line ends escaped."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def truncate(c: Column, n: int) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, max(1, n - 1)), rf"{SPACE}+\z", "")
    return F.when(F.length(c) > n, F.concat(cut, F.lit("…"))).otherwise(F.coalesce(c, F.lit("")))


def legend_label(reason: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(reason, F.lit("")), r":\s*'[^']*'", ""))


def section_id(slug: Column, anchor: Column) -> Column:
    return F.concat(slug, F.lit("--"), anchor)


def contract_present(needle: Column, hay: Column) -> Column:
    """Whether normalised words are in a normalised text: as a substring, or in order within max(3 n, n + 20) words.

    From each place of the first word a fold over that many words takes matches greedily, which
    finds the earliest end, so that no longer stretch has to be looked at. A word that the text
    does not have at all settles the question before that.
    """
    nw, hw = F.split(needle, " "), F.split(hay, " ")
    n = F.size(nw)
    span = F.greatest(n * 3, n + 20)
    starts = F.filter(F.sequence(F.lit(1), F.size(hw)), lambda i: F.get(hw, i - 1) == F.get(nw, F.lit(0)))
    got = lambda i: F.aggregate(F.slice(hw, i, span), F.lit(0), lambda k, w: k + F.when((k < n) & (w == F.get(nw, k)), 1).otherwise(0)) == n
    loose = (n <= F.size(hw)) & (F.size(F.array_except(nw, hw)) == 0) & F.exists(starts, got)
    return (needle == "") | F.contains(hay, needle) | F.coalesce(loose, F.lit(False))
