"""Sinks as Python data sources: tasks write, and a commit publishes all or nothing.

`keyedfiles` writes one file a row, named by the row. `overviewpage` writes the pieces of a page into
one document. Both need a folder that the driver and all executors see. What tasks write stays in a
staging folder beside the target, with temporary names until it is whole, so that a task that is
tried again writes the same files once more; an aborted write removes the folder.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import html as H


def local(path: str) -> str:
    """The path as Python opens it."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not in a folder that executors have mounted")
    return path.removeprefix("file://")


def _put(path: str, body: bytes) -> None:
    """The whole file or none, also where two attempts of a task write it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    rows: int


def _task() -> int:
    return TaskContext.get().partitionId()


#: Where a folder of keyed files has the list of its names.
NAMES = "_names"


class KeyedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = local(path).rstrip("/")
        if os.path.isdir(self.path) and os.listdir(self.path) and not os.path.isdir(f"{self.path}/{NAMES}"):
            raise ValueError(f"{self.path} holds something else than keyed files")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        names, task = [], _task()
        for name, body in rows:
            # names stay below the folder, whatever they hold
            safe = "/".join(quote(p, safe=" !'()+,;=@~") if p not in ("", ".", "..") else "%2E" * len(p) for p in name.split("/"))
            _put(f"{self.staging}/{safe}", bytes(body))
            names.append(json.dumps([name, safe], ensure_ascii=False))
        _put(f"{self.staging}/{NAMES}/part-{task:06d}.json", "".join(n + "\n" for n in names).encode())
        return Written(task, len(names))

    def commit(self, messages) -> None:
        os.makedirs(f"{self.staging}/{NAMES}", exist_ok=True)
        if os.path.isdir(self.path):
            shutil.rmtree(self.path)
        os.replace(self.staging, self.path)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class KeyedFiles(DataSource):
    """df(name string, body binary).write.format("keyedfiles"): one file a row, and the committed names with those of their files. A folder of keyed files that is there is replaced as a whole."""

    @classmethod
    def name(cls) -> str:
        return "keyedfiles"

    def writer(self, schema, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options["path"])


def write_keyed(rows: DataFrame, path: str) -> None:
    """One file for each row of rows(name, body), by tasks. name has to be unique and may have folders in it."""
    rows.sparkSession.dataSource.register(KeyedFiles)
    rows.select(F.col("name").cast("string"), F.col("body").cast("binary")).write.format("keyedfiles").mode("overwrite").save(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the committed files, read in tasks."""
    top = local(path).rstrip("/")

    def load(batches):
        for b in batches:
            for at in range(0, len(b), FILES_AT_ONCE):
                some = b[at : at + FILES_AT_ONCE].copy()
                some["body"] = [_bytes(f"{top}/{f}") for f in some["file"]]
                yield some[["name", "body"]]

    names = spark.read.schema("value string").text(f"{path.rstrip('/')}/{NAMES}/*.json").select(F.from_json("value", "array<string>").alias("n"))
    return names.select(F.col("n")[0].alias("name"), F.col("n")[1].alias("file")).mapInPandas(load, "name string, body binary")


#: Files whose contents a task holds at a time.
FILES_AT_ONCE = 20


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Scan:
    """The first remote resource of each kind in a text that comes in pieces. No pattern takes a `>`, so that what stands between two of them is looked at by itself."""

    def __init__(self):
        self.kinds = [(label, re.compile(pattern)) for label, pattern in H.FETCHES]
        self.found: dict[str, str] = {}
        self.head: str | None = None  # up to the first >, which belongs to what stands before
        self.rest = ""

    def look(self, text: str) -> None:
        for label, pattern in self.kinds:
            if label not in self.found and (m := pattern.search(text)):
                self.found[label] = m[0]

    def feed(self, text: str) -> None:
        if ">" not in text:
            self.rest += text
            return
        first, last = text.index(">"), text.rindex(">")
        begin = self.rest + text[: first + 1]
        if self.head is None:
            self.head = begin
        else:
            self.look(begin)
        self.look(text[first + 1 : last + 1])
        self.rest = text[last + 1 :]

    def join(self, found: dict[str, str], head: str | None, rest: str) -> None:
        """Goes on with what another scan has of the text that comes next."""
        if head is None:
            self.feed(rest)
            return
        self.feed(head)
        for label, what in found.items():
            self.found.setdefault(label, what)
        self.rest = rest


@dataclass
class Pieces(WriterCommitMessage):
    partition: int
    zones: list[str] = field(default_factory=list)
    found: list = field(default_factory=list)  # of each zone: (remote resources, head, rest)


class PageWriter(DataSourceWriter):
    """Pieces come in the order of the page within a zone, by partition and row."""

    def __init__(self, options):
        self.path, self.frames, self.empty = local(options["path"]), json.loads(options["frames"]), json.loads(options["empty"])
        self.segments, self.publish = split_shell(options["shell"], list(self.frames)), options.get("publish", "true") == "true"
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Pieces:
        task, out = _task(), {}
        os.makedirs(self.staging, exist_ok=True)
        attempt = uuid.uuid4().hex
        for zone, html in rows:
            if zone not in out:
                out[zone] = (open(f"{self.staging}/{zone}-{task:06d}.{attempt}.tmp", "wb"), Scan())
            out[zone][0].write(html.encode())
            out[zone][1].feed(html)
        for zone, (f, _) in out.items():
            f.close()
            os.replace(f.name, f"{self.staging}/{zone}-{task:06d}")
        return Pieces(task, list(out), [(s.found, s.head, s.rest) for _, s in out.values()])

    def commit(self, messages) -> None:
        parts = {(zone, m.partition): found for m in messages if m for zone, found in zip(m.zones, m.found, strict=True)}
        scan, done = Scan(), f"{self.staging}/page"
        scan.head = ""
        os.makedirs(self.staging, exist_ok=True)
        with open(done, "wb") as page:

            def put(text: str) -> None:
                page.write(text.encode())
                scan.feed(text)

            for zone, text in self.segments:
                put(text)
                if zone is None:
                    continue
                before, behind = self.frames[zone]
                mine = sorted(p for z, p in parts if z == zone)
                put("\n" + before)
                for p in mine:
                    with open(f"{self.staging}/{zone}-{p:06d}", "rb") as f:
                        shutil.copyfileobj(f, page, 1 << 20)
                    scan.join(*parts[zone, p])
                put((self.empty.get(zone, "") if not mine else "") + behind + "\n")
        scan.look(scan.rest)
        if scan.found or not self.publish:
            shutil.rmtree(self.staging, ignore_errors=True)
            if scan.found:
                raise ValueError(f"the page loads remote resources: {MARK}{json.dumps(scan.found)}{MARK}")
            return
        os.replace(done, self.path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


#: Stands around what a commit that refuses a page has found.
MARK = "\x1e"


def zone_markers(zone: str) -> tuple[str, str]:
    """Fixed values of the page format: the comments between which a zone stands."""
    return f"<!-- {H.PREFIX.upper()}:{zone}:START -->", f"<!-- {H.PREFIX.upper()}:{zone}:END -->"


def split_shell(shell: str, zones: list[str]) -> list[tuple[str | None, str]]:
    """The shell in pieces: each ends with a zone's first marker, but the last. Raises ValueError where markers lack or are out of order."""
    spots = []
    for zone in zones:
        begin, end = zone_markers(zone)
        a, b = shell.find(begin), shell.find(end)
        if a < 0 or b < a:
            raise ValueError(f"the shell lacks the markers of {zone}, or has them out of order")
        spots.append((a + len(begin), b, zone))
    out, at = [], 0
    for a, b, zone in sorted(spots):
        out.append((zone, shell[at:a]))
        at = b
    return [*out, (None, shell[at:])]


@dataclass
class Range(InputPartition):
    zone: str
    number: int
    start: int
    size: int


class PageReader(DataSourceReader):
    """The zones of a written page in ranges of bytes."""

    def __init__(self, options):
        self.path, self.size, self.zones = local(options["path"]), int(options.get("rangebytes", str(1 << 20))), options["zones"].split(",")

    def partitions(self):
        import mmap

        out = []
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as page:
            for zone in self.zones:
                begin, end = (m.encode() for m in zone_markers(zone))
                a, b = page.find(begin) + len(begin) + 1, page.find(end) - 1
                out += [Range(zone, n, at, min(self.size, b - at)) for n, at in enumerate(range(a, b, self.size))]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.zone:
            with open(self.path, "rb") as f:
                f.seek(part.start)
                yield part.zone, part.number, f.read(part.size)


class OverviewPage(DataSource):
    """Writing: df(zone, html) in the page's order, options path, shell, frames and empty (JSON by zone). Reading: (zone, number, body), ranges of each zone's bytes; options path, zones, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "overviewpage"

    def schema(self) -> str:
        return "zone string, number int, body binary"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options)


def write_page(pieces: DataFrame, order: list[Column], path: str, shell: str, frames: dict[str, tuple[str, str]], empty: dict[str, str], publish: bool = True) -> dict[str, str]:
    """Writes pieces(zone, html) in their order into the shell's zones, as one document at path.

    Pieces are sorted and written by tasks; the commit strings their files together, a block at a
    time, and publishes the document by one rename. A document that loads anything from elsewhere is
    not written: then what it loads is returned by kind, and nothing is left or changed at path.
    publish=False only looks for that.
    """
    split_shell(shell, list(frames))  # a bad shell fails before any work
    spark = pieces.sparkSession
    spark.dataSource.register(OverviewPage)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartitionByRange(n, "zone", *order).sortWithinPartitions("zone", *order).select("zone", "html")
    try:
        rows.write.format("overviewpage").options(shell=shell, frames=json.dumps(frames), empty=json.dumps(empty), publish=str(publish).lower()).mode("append").save(path)
    except Exception as e:
        if found := re.search(f"{MARK}(.*?){MARK}", str(e), re.S):
            return json.loads(found[1])
        raise
    return {}


def read_page(spark: SparkSession, path: str, zones: tuple[str, ...] = H.ZONES, range_bytes: int = 1 << 20) -> DataFrame:
    """(zone, number, body): the bytes of a written page's zones, in ranges that tasks read."""
    spark.dataSource.register(OverviewPage)
    return spark.read.format("overviewpage").options(zones=",".join(zones), rangeBytes=str(range_bytes)).load(path)
