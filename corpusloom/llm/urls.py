"""URL filters (operator 8): rules on hosts and paths, and trust propagated over the graph of hosts.

Rules decide the urls they fit; the longest one wins. For all other urls the host's rank
decides: personalised PageRank from trusted hosts flows along host edges, the same walk from
blocked hosts flows against them (who links to a bad host is suspect), and a host whose share
of distrust, distrust / (trust + distrust), is over THRESHOLD is blocked.

Host edges: absolute hyperlinks of the pages (href and src), and each host and the domain above
it, in both directions, as a domain vouches for its subdomains. A host is a seed with the
weight of its pages that a rule allows (blocks).

Edge cases: a url that is null or has no :// has empty host and path, fits no rule, and is
allowed by the method, as is any host that no seed reaches; null html has no links; repeated
rows count in the weights and are judged alike; without pages there are no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, running, table

#: (verdict, host, path) of each rule; the list is a parameter of bounded size.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds after which less than TOLERANCE of any walk is left (0.85^128 = 9e-10); more follow while a host's rank still grows by more than that share of itself.
TOLERANCE, ROUNDS = 1e-9, 128
#: Rounds between two written tables; digits of a share that count.
STEPS, DIGITS = 4, 7
#: Out-edges of a host that one task takes; those of a host of more are dealt to slices.
MOST_OUT = 10_000
#: Rows of a walk's graph, seeds and edges, that one task walks alone; larger graphs are dealt by their hosts.
ONE_TASK = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.translate(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Of equally long ones, the later in order of code points."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def node_of(host: Column) -> Column:
    """A host's node: a 128-bit hash of its last label, hashed on with each label before it, so that a domain has the same node in all hosts below it."""
    return F.aggregate(F.reverse(F.split(host, r"\.")), F.lit(""), lambda above, label: F.md5(F.concat(above, F.lit("."), label).cast("binary")))


def host_edges(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst, weight) by nodes, from pages(host, html): links with their counts, and each host with the domains above it.

    A host's domains are hashes, not texts, so that a host of very many labels takes no more than
    its length.
    """
    absolute = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    links = pages.where(F.col("html").contains("//")).select("host", F.explode(F.regexp_extract_all("html", F.lit(absolute), F.lit(1))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    links = scratch.cut(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    hosts = pages.select("host").where("host <> ''").distinct().union(links.select("dst")).distinct()
    chain = running(r"reverse(split(host, r'\.'))", "''", "md5(cast(concat(t.at, '.', x) AS binary))", "string")
    steps = F.expr(f"get(transform(array({chain}), c -> zip_with(slice(c, 2, size(c) - 1), slice(c, 1, size(c) - 1), (a, b) -> named_struct('host', a, 'up', b))), 0)")
    pairs = hosts.select(F.explode(steps).alias("p")).select("p.*").distinct()
    tree = pairs.select(F.col("host").alias("src"), F.col("up").alias("dst")).unionByName(pairs.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    links = links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"), "weight")
    return scratch.cut(links.unionByName(tree.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def sliced_flow(edges: DataFrame, damping: float = DAMPING, most_out: int = MOST_OUT) -> DataFrame:
    """(walk, host, dst, share) of edges(walk, src, dst, weight), a written table: what a host's rank sends on.

    A host of more than most_out out-edges sends its whole rank to slices of its own, named host/n,
    and each of them a part of its shares. Shares along a way multiply to the same, so that ranks of hosts are
    the same sums, and no host's edges meet in one task.
    """
    out = edges.groupBy("walk", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    rows = join_counted(edges, out, ["walk", "src"], "n")
    slice_of = F.concat("src", F.lit("/"), F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / most_out)).cast("string"))
    rows = rows.select("walk", "src", F.when(F.col("n") > most_out, slice_of).alias("slice"), "dst", (F.col("weight") / F.col("out") * damping).alias("share"))
    whole = rows.where("slice is not null").select("walk", F.col("src").alias("host"), F.col("slice").alias("dst"), F.lit(1.0).alias("share")).distinct()
    return rows.select("walk", F.coalesce("slice", "src").alias("host"), "dst", "share").unionByName(whole)


def personalised_ranks(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, most_out: int = MOST_OUT, one_task: int = ONE_TASK) -> DataFrame:
    """(walk, host, rank) of walks along edges(walk, src, dst, weight) that restart at seeds(walk, host, seed) with 1 - damping; ranks of hosts without out-edges restart too.

    Such ranks are the sum over k of (damping * flow)^k from the seeds, scaled to 1 in each walk. The
    sum only grows: it ends when, after the given rounds, no host's rank grows by more than
    tolerance of itself, which a host that is just reached always does. No host's name has a slash.

    Ranks stay dealt by their host from a round's sums to the next one's join, and flow is shuffled once
    for STEPS rounds; nothing is broadcast, as each such table would stay on the driver. A graph of
    at most one_task rows is read by one task, which needs no shuffles: dealt out, each round would cost as many
    tasks as there are shuffle partitions, whatever the graph's size.
    """
    total = seeds.groupBy("walk").agg(F.sum("seed").alias("total")).where("total > 0")
    start = scratch.cut(seeds.join(F.broadcast(total), "walk").select("walk", "host", (F.col("seed") / F.col("total")).alias("rank")))
    flow = scratch.cut(sliced_flow(edges, damping, most_out))
    few = start.count() + flow.count() <= one_task
    met = lambda df: df.coalesce(1) if few else df
    flow, rank, done = met(flow), start, 0
    while True:
        after = rank
        for _ in range(STEPS):
            before = after
            sent = met(before).join(flow.hint("merge"), ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            # what is too small for a double does not go on
            after = met(start.unionByName(sent.where("rank > 0"))).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        after, done = scratch.cut(after), done + STEPS
        grown = met(rank).select("walk", "host", F.col("rank").alias("was"))
        ended = done >= rounds and met(after).join(grown.hint("merge"), ["walk", "host"], "left").where(F.col("was").isNull() | (F.col("rank") - F.col("was") > tolerance * F.col("rank"))).isEmpty()
        if rank is not start:
            scratch.drop(rank)
        rank = after
        if ended:
            break
    rank = rank.where(~F.contains("host", F.lit("/")))
    whole = rank.groupBy("walk").agg(F.sum("rank").alias("whole"))
    return rank.join(F.broadcast(whole), "walk").select("walk", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages."""
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", "host", "path", fit.alias("fit"), node_of(F.col("host")).alias("node"))
    seeds = judged.where("host <> ''").groupBy(F.col("node").alias("host")).agg(F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("fit.verdict") == "block").cast("double").alias("bad"))
    seeds = scratch.cut(seeds)
    edges = host_edges(rows.select("host", "html"), scratch)
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    starts = seeds.where("good > 0").select(F.lit("trust").alias("walk"), "host", F.col("good").alias("seed")).unionByName(seeds.where("bad > 0").select(F.lit("distrust").alias("walk"), "host", F.col("bad").alias("seed")))
    ranks = personalised_ranks(both, starts, scratch)
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("rank")).otherwise(0.0)).alias(walk)
    marks = scratch.cut(ranks.groupBy(F.col("host").alias("h")).agg(of("trust"), of("distrust")))
    out = judged.join(marks, F.col("node") == F.col("h"), "left").drop("h").fillna(0.0, ["trust", "distrust"])
    # of the share alone, what the order of sums leaves open is rounded away; ranks have no floor
    share = F.when(F.col("distrust") > 0, F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), DIGITS))
    bad = F.coalesce(share > threshold, F.lit(False))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
