"""Selection of files by a comma-separated spec, and what remains of a structure in its scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern in which * and ? also match a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "!" else 2)) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += f"[{'^' + inside[1:] if inside.startswith('!') else inside}]"
            i = end
        else:
            out += "\\" + c if c in "\\.[]{}()+-^$|&~#" else c
        i += 1
    return f"(?s)^{out}\\z"


def _category(token: str) -> Column:
    """1 to 4 for the way in which the token names the file, else null."""
    folder = token.rstrip("/")
    path, within = F.col("file_path"), T.dirname(F.col("file_path"))
    return (
        F.when(F.lit(token == "all"), 0)
        .when(F.col("slug") == token, 1)
        .when(path == token, 2)
        .when((within == folder) | F.startswith(within, F.lit(folder + "/")), 3)
        .when(path.rlike(glob_pattern(token)), 4)
    )


def select_files(files: DataFrame, spec: str) -> DataFrame:
    """(token, slug, category) of what each token of the spec names; of its categories (slug, path, folder, glob) the first with a hit counts.

    Raises ValueError for an empty spec or a token without a hit.
    """
    tokens = list(dict.fromkeys(t for t in (p.strip() for p in spec.split(",")) if t))
    if not tokens:
        raise ValueError("the selection spec is empty")
    ways = F.array(*[F.struct(F.lit(t).alias("token"), _category(t).alias("category")) for t in tokens])
    hits = files.select("slug", F.explode(F.filter(ways, lambda w: w["category"].isNotNull())).alias("w")).select("slug", "w.token", "w.category")
    best = hits.groupBy("token").agg(F.min("category").alias("category"))
    missing = set(tokens) - {r["token"] for r in best.collect()}  # a row for each token of the spec
    if missing:
        raise ValueError(f"selection matched nothing: {sorted(missing)}")
    return hits.join(F.broadcast(best), ["token", "category"]).select("token", "slug", "category")


def scope_files(files: DataFrame, selected: DataFrame) -> DataFrame:
    return files.join(selected.select("slug").distinct(), "slug", "left_semi")


def scope_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends selected."""
    ends = selected.select("slug").distinct()
    return edges.join(ends.withColumnRenamed("slug", "from"), "from", "left_semi").join(ends.withColumnRenamed("slug", "to"), "to", "left_semi").select(*edges.columns)


def scope_links(links: DataFrame, selected: DataFrame) -> DataFrame:
    """Links of selected files; resolved_slug is null where its file is not selected."""
    ends = selected.select(F.col("slug").alias("s")).distinct()
    mine = links.join(ends, F.col("slug") == F.col("s"), "left_semi")
    return mine.join(ends, F.col("resolved_slug") == F.col("s"), "left").withColumn("resolved_slug", F.col("s")).drop("s")


def unknown(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Selected slugs that no file has."""
    return selected.select("slug").distinct().join(files.select("slug"), "slug", "left_anti")


def slices(files: DataFrame, headings: DataFrame, links: DataFrame) -> DataFrame:
    """(slug, slice): one JSON text a file, with its headings and scoped links in order."""
    heads = headings.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text", "anchor"))).alias("h"))
    refs = links.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "target", "type", "resolved_slug"))).alias("l"))
    rows = files.join(heads, "slug", "left").join(refs, "slug", "left")
    head = F.transform(F.coalesce("h", F.array().cast("array<struct<pos:int,level:int,text:string,anchor:string>>")), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"), x["anchor"].alias("anchor")))
    link = F.transform(F.coalesce("l", F.array().cast("array<struct<pos:int,raw:string,target:string,type:string,resolved_slug:string>>")), lambda x: F.struct(x["raw"].alias("raw"), x["target"].alias("target"), x["type"].alias("type"), x["resolved_slug"].alias("resolved_slug")))
    return rows.select("slug", F.to_json(F.struct("slug", "file_path", "title", "language", head.alias("headings"), link.alias("links"))).alias("slice"))


def menu(files: DataFrame) -> DataFrame:
    """(group, path, line): the lines of a selection menu in their order, a folder's own before its files'."""
    rows = files.withColumn("group", T.group_of(F.col("file_path")))
    files_of = rows.select("group", F.col("file_path").alias("path"), F.concat(F.lit("- "), "slug", F.lit(" — "), F.coalesce("title", F.lit("")), F.lit(" — ~"), F.col("token_estimate").cast("string"), F.lit(" tokens")).alias("line"))
    n, total = F.count("*"), F.sum("token_estimate").cast("string")
    heads = rows.groupBy("group").agg(F.concat(F.lit("## "), F.first("group"), F.lit(" — "), n.cast("string"), F.when(n == 1, " file").otherwise(" files"), F.lit(" — ~"), total, F.lit(" tokens (estimate)")).alias("line"))
    return heads.select("group", F.lit("").alias("path"), "line").unionByName(files_of).orderBy("group", "path")
