"""A Markdown corpus made from the conversations and benchmark tables, for queries over tables that hold no Markdown.

One file a conversation, with front matter, a heading a turn, a fenced block and links of every
kind; two files a benchmark item, whose paths have one slug. Plain string functions only, so
that another engine can build the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = "```"


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def conversation_path(n):
    return _cat("conv/g", n % 10, "/conv-", n, ".md")


def derived_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text)."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = _cat("## ", F.coalesce("role", F.lit("")), "\n", F.coalesce("text", F.lit("")))
    talk = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", turn.alias("piece")))).alias("turns"))
    n = F.col("conv_id")
    after = n - n % 100 + (n + 10) % 100
    text = _cat(
        "---\nname: conv-", n, "\nturns: ", F.col("n"), "\n---\n# Conversation ", n, "\n",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "\n"),
        f"\n{FENCE}\n# not a heading\n{FENCE}\n[next](conv-", after, ".md) [see](conv-1.md) `conv/g0/conv-0.md` `conv-7.md` `conv-3` [site](http://example.com/x) `src/x.py`\n",
    )
    files = talk.select(conversation_path(n).alias("file_path"), text.alias("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.array(F.lit("-"), F.lit("_"))).alias("sep"), "item_id", "text")
    notes = items.select(_cat("bench/item", F.col("sep"), F.col("item_id"), ".md").alias("file_path"), _cat("# Item ", F.col("item_id"), "\n", F.coalesce("text", F.lit("")), "\n").alias("text"))
    return files.unionByName(notes)


#: The same corpus in DuckDB's SQL, as the common table expression corpus(file_path, text).
CORPUS_SQL = """
talk AS (
  SELECT conv_id AS n, count(*) AS turns,
    string_agg('## ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, '## ' || coalesce(role, '') || chr(10) || coalesce(text, '')) AS pieces
  FROM conversations GROUP BY conv_id),
corpus AS (
  SELECT 'conv/g' || (n % 10) || '/conv-' || n || '.md' AS file_path,
    '---' || chr(10) || 'name: conv-' || n || chr(10) || 'turns: ' || turns || chr(10) || '---' || chr(10) || '# Conversation ' || n || chr(10) || pieces || chr(10)
    || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10)
    || '[next](conv-' || (n - n % 100 + (n + 10) % 100) || '.md) [see](conv-1.md) `conv/g0/conv-0.md` `conv-7.md` `conv-3` [site](http://example.com/x) `src/x.py`' || chr(10) AS text
  FROM talk
  UNION ALL
  SELECT 'bench/item' || sep || item_id || '.md', '# Item ' || item_id || chr(10) || coalesce(text, '') || chr(10)
  FROM benchmark, (VALUES ('-'), ('_')) s(sep))
"""
