"""Sinks: all or nothing, in order, by tasks; and the discovery of what they wrote."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators import overview
from corpusloom.sources import corpus as disk
from corpusloom.sources import sinks

SHELL = overview.default_shell()


def test_keyed_files(spark, tmp_path):
    rows = [("a/b.md", b"x"), ("../up", b"\xff\x00"), ("a//c d%.md", b""), ("é/😀.md", "é".encode()), ("plain", b"y" * 100_000)]
    path = f"file://{tmp_path}/out"
    sinks.write_keyed(spark.createDataFrame(rows, "name string, body binary").repartition(3), path)
    assert sorted((r.name, bytes(r.body)) for r in sinks.read_keyed(spark, path).collect()) == sorted(rows)
    assert sorted(os.listdir(tmp_path)) == ["out"] and (tmp_path / "out/a/b.md").read_bytes() == b"x"
    sinks.write_keyed(spark.createDataFrame(rows[:1], "name string, body binary"), path)
    assert [r.name for r in sinks.read_keyed(spark, path).collect()] == ["a/b.md"] and not (tmp_path / "out/plain").exists()
    with pytest.raises(Exception, match="bad row"):
        sinks.write_keyed(spark.range(8).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("bad row"))).otherwise(F.lit("z")).alias("body")), path)
    assert sorted(os.listdir(tmp_path)) == ["out"] and [r.name for r in sinks.read_keyed(spark, path).collect()] == ["a/b.md"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/file").write_text("kept")
    with pytest.raises(Exception, match="something else"):
        sinks.write_keyed(spark.createDataFrame(rows, "name string, body binary"), str(tmp_path / "mine"))
    sinks.write_keyed(spark.createDataFrame([], "name string, body binary"), str(tmp_path / "none"))
    assert sinks.read_keyed(spark, str(tmp_path / "none")).count() == 0


def pieces(spark, rows):
    return spark.createDataFrame(rows, "zone string, ord string, html string").repartition(4)


def test_page_is_one_document_in_order(spark, tmp_path):
    rows = [(z, f"{i:04d}", f"<p>{z} {i} é</p>\n") for z in ("TOC", "FILES", "STRAP") for i in range(200)]
    path = str(tmp_path / "page.html")
    assert overview.write_document(pieces(spark, rows), SHELL, path) == {}
    text = (tmp_path / "page.html").read_text()
    assert text == overview.write_page(pieces(spark, rows), SHELL) and os.listdir(tmp_path) == ["page.html"]
    back = sorted(sinks.read_page(spark, path, range_bytes=1000).collect(), key=lambda r: (r.zone, r.number))
    for zone in H.ZONES:
        begin, end = sinks.zone_markers(zone)
        assert b"".join(r.body for r in back if r.zone == zone).decode() == text.split(begin)[1].split(end)[0][1:-1]


@pytest.mark.parametrize("remote", ['<img src="http://x">', '<link rel=x href="y">', "<style>@import url(https://x)</style>"])
def test_page_that_loads_anything_is_not_written(spark, tmp_path, remote):
    (tmp_path / "page.html").write_text("before")
    rows = [("FILES", f"{i:03d}", f"<p>{i}</p>") for i in range(50)] + [("FILES", "0255", remote)]
    found = overview.write_document(pieces(spark, rows), SHELL, str(tmp_path / "page.html"))
    assert found and os.listdir(tmp_path) == ["page.html"] and (tmp_path / "page.html").read_text() == "before"
    assert overview.write_document(pieces(spark, rows[:-1]), SHELL, str(tmp_path / "page.html"), publish=False) == {}
    assert (tmp_path / "page.html").read_text() == "before"
    with pytest.raises(ValueError, match="markers of STRAP"):
        overview.write_document(pieces(spark, rows), "<html></html>", str(tmp_path / "page.html"))


def test_failed_pieces_leave_nothing(spark, tmp_path):
    rows = pieces(spark, [("FILES", str(i), "x") for i in range(50)]).withColumn("html", F.when(F.col("ord") == "31", F.raise_error(F.lit("bad piece"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="bad piece"):
        overview.write_document(rows, SHELL, str(tmp_path / "page.html"))
    assert os.listdir(tmp_path) == []


def test_scan_of_pieces_finds_what_a_scan_of_the_whole_does():
    """Resources that begin in one piece, or one task's part, and end in another."""
    draw = random.Random(9)
    bits = ["<img ", "src=", "src = '", "http://x", " ", ">", "</p>", "text", "<link ", "href=", "url(", '"https:', "@import ", "//cdn", "<image xlink:", '"', "'", "\n", "<script src="]
    for _ in range(4000):
        texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 6))]
        whole = sinks.Scan()
        whole.look("".join(texts))
        cuts = sorted(draw.randint(0, len(texts)) for _ in range(2))
        out = sinks.Scan()
        out.head = ""
        for part in (texts[: cuts[0]], texts[cuts[0] : cuts[1]], texts[cuts[1] :]):
            mine = sinks.Scan()
            for t in part:
                mine.feed(t)
            out.join(mine.found, mine.head, mine.rest)
        out.look(out.rest)
        assert out.found == whole.found, texts


def test_discovery_by_levels(spark, tmp_path):
    names = ["a.md", "b.MARKDOWN", "c.txt", "d/e/f.Md", "d/.hidden/g.md", ".git/h.md", "d/node_modules/i.md", "_x/j.md", "d/e/k.mdx", "é/l m.md"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "d/link").symlink_to(tmp_path / "_x")
    (tmp_path / "linked.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "gone.md").symlink_to(tmp_path / "nowhere.md")
    (tmp_path / "folder.md").mkdir()
    got = sorted(r.file_path for r in disk.discover(spark, str(tmp_path), tasks=3).collect())
    assert got == sorted(disk.list_files(str(tmp_path))) == sorted(["a.md", "b.MARKDOWN", "d/e/f.Md", "d/.hidden/g.md", "_x/j.md", "é/l m.md", "linked.md", "gone.md"])
    read, skipped = disk.read_corpus(spark, str(tmp_path), excludes=("d",))
    assert sorted(r.file_path for r in read.collect()) == [".git/h.md", "_x/j.md", "a.md", "b.MARKDOWN", "linked.md", "é/l m.md"] and skipped.count() == 0
    with pytest.raises(ValueError, match="not a readable folder"):
        disk.discover(spark, str(tmp_path / "a.md"))
