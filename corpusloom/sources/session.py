"""Session folders: artifacts of one run on disk, its manifest with step marks, and their validation.

Small control files, written by the driver; tables of artifacts are read and written by Spark.
"""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from . import sinks

# The steps of a run in order, and a step's states.
STEPS = ("preflight", "parse", "render", "verify", "crossfile", "assemble", "report")
STATES = ("pending", "running", "done", "failed")
ANALYSIS = "slug string, tldr string, sections array<struct<id:string,title:string,kind:string,source_headings:array<string>>>, contracts array<struct<text:string,source_anchor:string>>, _corrupt_record string"
FINDINGS = "cross_file_findings array<struct<type:string,severity:string,files:array<string>,title:string,description:string,claims:array<struct<file:string,claim:string>>>>"


def _dump(path: str, value: object) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")


def selection(entries: object) -> list[dict]:
    """Checked entries of a selection: an array, or an object with files; each with slug and path (or file_path)."""
    entries = entries.get("files") if isinstance(entries, dict) else entries
    if not isinstance(entries, list) or not entries:
        raise ValueError("a selection is a non-empty array")
    out = []
    for i, e in enumerate(entries):
        if not isinstance(e, dict) or not e.get("slug") or not (e.get("path") or e.get("file_path")):
            raise ValueError(f"entry {i} of the selection lacks a path or a slug")
        known = {"path": e.get("path") or e["file_path"], "slug": e["slug"]}
        out.append(known | ({"token_estimate": e["token_estimate"]} if e.get("token_estimate") is not None else {}))
    return out


def create(root: str, entries: object, language: str = "source", folder: str = ".corpusloom", now: datetime.datetime | None = None) -> str:
    """A new dated session folder with its manifest; a number is added if the minute has one already."""
    chosen = selection(entries)
    utc = now or datetime.datetime.now(datetime.timezone.utc)
    stamp = utc.astimezone().strftime("%Y-%m-%d_%H-%M")
    base, name, n = os.path.join(root, folder), stamp, 1
    while os.path.exists(os.path.join(base, name)):
        n += 1
        name = f"{stamp}_{n}"
    path = os.path.join(base, name)
    for part in ("analysis", "fragments", "slices"):
        os.makedirs(os.path.join(path, part))
    _dump(os.path.join(path, "manifest.json"), {
        "session": name, "session_dir": os.path.normpath(path), "created_at": utc.strftime("%Y-%m-%dT%H:%M:%SZ"), "root": root, "output_language": language,
        "selected_files": chosen, "steps": {s: {"status": "pending"} for s in STEPS},
    })
    return os.path.abspath(path)


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"})).toLocalIterator()]


def write_structure(session: str, meta: dict, files: DataFrame, nodes: DataFrame, edges: DataFrame, slices: DataFrame, groups: DataFrame | None = None) -> None:
    """structure.json and one slice a file; a session holds the files of one page. Larger structures are written by write_records."""
    rows = _rows(files)
    named = {} if groups is None else {"groups": _rows(groups.drop("members").orderBy("group"))}
    _dump(os.path.join(session, "structure.json"), {"meta": {**meta, "file_count": len(rows)}, "files": rows, **named, "graph": {"nodes": _rows(nodes), "edges": _rows(edges)}})
    write_slices(slices, os.path.join(session, "slices"))


def write_slices(slices: DataFrame, path: str) -> None:
    """slices(slug, slice) as one file a slug, by tasks; the folder is there with all of them or not at all."""
    sinks.write_keyed(slices.select(F.concat("slug", F.lit(".json")).alias("name"), F.concat("slice", F.lit("\n")).alias("body")), path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """(slug, slice) of a folder of slices."""
    rows = sinks.read_keyed(spark, path)
    return rows.select(F.regexp_replace("name", r"\.json\z", "").alias("slug"), F.regexp_replace(F.col("body").cast("string"), r"\n\z", "").alias("slice"))


RECORD = (
    "slug string, file_path string, language string, title string, token_estimate int, token_estimate_method string, front array<struct<key:string,value:string,items:array<string>>>, "
    "headings array<struct<level:int,text:string,anchor:string>>, links array<struct<raw:string,target:string,type:string,resolved_slug:string>>"
)
STRUCTURE = f"files array<struct<{RECORD.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(', ', ',')}>>, graph struct<nodes:array<struct<slug:string,file_path:string,title:string>>,edges:array<struct<from:string,to:string,strength:string,reason:string>>>"


def write_records(records: DataFrame, path: str) -> None:
    """Records of files (see operators.structure.records) as JSON lines, by Spark, for structures of any size."""
    records.write.mode("overwrite").json(path, ignoreNullFields=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def unfold(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, headings, links) of records, as parse gives them; links with resolved_slug."""
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    heads = some("headings", "array<struct<level:int,text:string,anchor:string>>")
    files = records.select("slug", "file_path", "language", "title", "token_estimate", "token_estimate_method", some("front", "array<struct<key:string,value:string,items:array<string>>>").alias("front"), F.size(heads).alias("n_headings"))
    headings = records.select("slug", "file_path", F.posexplode(heads).alias("pos", "h")).select("slug", "file_path", "pos", "h.level", "h.text", "h.anchor", F.concat("slug", F.lit("--"), "h.anchor").alias("id"))
    links = records.select("slug", "file_path", F.posexplode("links").alias("pos", "l")).select("slug", "file_path", "pos", "l.*")
    return files, headings, links


def read_structure(spark: SparkSession, session: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges) of a session's structure.json. Raises FileNotFoundError where there is none."""
    path = os.path.join(session, "structure.json")
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", STRUCTURE).alias("s"))
    return whole.select(F.explode("s.files").alias("f")).select("f.*"), whole.select(F.explode("s.graph.edges").alias("e")).select("e.*")


def manifest(session: str) -> dict:
    with open(os.path.join(session, "manifest.json"), encoding="utf-8") as f:
        return json.load(f)


def mark(session: str, step: str, state: str, meta: list[str] | None = None) -> None:
    """Sets a step's state and replaces what was noted with it; meta are KEY=VALUE texts."""
    if step not in STEPS or state not in STATES:
        raise ValueError(f"no such step or state: {step!r}, {state!r}")
    notes = {}
    for item in meta or []:
        key, sign, value = item.partition("=")
        if not sign or not key:
            raise ValueError(f"not KEY=VALUE: {item!r}")
        notes[key] = value
    found = manifest(session)
    if not isinstance(found.get("steps"), dict):
        raise ValueError("the manifest has no steps")
    found["steps"][step] = {"status": state, **notes}
    _dump(os.path.join(session, "manifest.json"), found)


def read_fragments(spark: SparkSession, session: str) -> DataFrame:
    """fragments(slug, html)."""
    return _whole(spark, os.path.join(session, "fragments"), "html")


def read_analyses(spark: SparkSession, session: str) -> DataFrame:
    """(slug, tldr, sections, contracts) of the analyses that parse; of equal slugs the last file's."""
    raw = _whole(spark, os.path.join(session, "analysis"), "json").withColumn("a", F.from_json("html", ANALYSIS, {"mode": "PERMISSIVE"}))
    good = raw.where("a is not null and a._corrupt_record is null")
    named = good.select(F.coalesce(F.nullif("a.slug", F.lit("")), "slug").alias("slug"), F.col("slug").alias("stem"), "a.tldr", "a.sections", "a.contracts")
    last = named.groupBy("slug").agg(F.max_by(F.struct("tldr", "sections", "contracts"), "stem").alias("a"))
    return last.select("slug", "a.*")


def read_findings(spark: SparkSession, session: str) -> DataFrame:
    """(ord, type, severity, files, title, description, claims); none if the file is missing or is not an object."""
    path = os.path.join(session, "findings.json")
    if not os.path.exists(path):
        rows = spark.createDataFrame([], "value string")
    else:
        rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.from_json("value", FINDINGS)["cross_file_findings"]).alias("ord", "f")).select("ord", "f.*")


def _whole(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    names = [n for n in sorted(os.listdir(folder)) if n.endswith(f".{extension}")] if os.path.isdir(folder) else []
    if not names:
        return spark.createDataFrame([], "slug string, html string")
    stem = F.regexp_extract("_metadata.file_name", rf"^(.*)\.{extension}$", 1)
    return spark.read.text([os.path.join(folder, n) for n in names], wholetext=True).select(F.url_decode(stem).alias("slug"), F.col("value").alias("html"))


def validate(spark: SparkSession, session: str) -> dict:
    """{ok, missing_fragments, unparsable_analysis, bad_findings} for the files that the manifest selects."""
    slugs = [e["slug"] for e in manifest(session).get("selected_files") or [] if e.get("slug")]
    chosen = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "i int, slug string")
    have = read_fragments(spark, session).where("html <> ''")
    parsed = _whole(spark, os.path.join(session, "analysis"), "json").where(F.try_parse_json("html").isNotNull())
    lacking = lambda df: [r["slug"] for r in chosen.join(df, "slug", "left_anti").orderBy("i").collect()]
    path, bad = os.path.join(session, "findings.json"), False
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            bad = not (isinstance(found, dict) and isinstance(found.get("cross_file_findings"), list))
        except (ValueError, OSError):
            bad = True
    fragments, analyses = lacking(have), lacking(parsed)
    return {"ok": not (fragments or analyses or bad), "missing_fragments": fragments, "unparsable_analysis": analyses, "bad_findings": bad}


def repair(spark: SparkSession, session: str, root: str = ".") -> tuple[int, dict]:
    """Repairs a session's fragments and contracts in place: (status, report).

    Status 2: no structure.json; 1: genuine gaps are left; 0: none. Files that lack a fragment or
    a readable analysis are skipped, and only what changed is written. The report has lists of
    {slug, item} by bucket and kind, in the order of paths.
    """
    report = {bucket: {kind: [] for kind in gates.KINDS} for bucket in gates.BUCKETS}
    try:
        records, _ = read_structure(spark, session)
    except FileNotFoundError:
        return 2, report
    files, headings, _ = unfold(records)
    raw = _whole(spark, os.path.join(session, "analysis"), "json").withColumn("a", F.from_json("html", ANALYSIS, {"mode": "PERMISSIVE"}))
    analyses = raw.where("a is not null and a._corrupt_record is null").select("slug", "a.sections", "a.contracts")
    fragments = read_fragments(spark, session).join(analyses, "slug", "left_semi")
    sections = analyses.select("slug", F.posexplode("sections").alias("ord", "s")).select("slug", "ord", "s.id", "s.source_headings")
    contracts = analyses.select("slug", F.posexplode("contracts").alias("ord", "c")).select("slug", "ord", "c.text")
    paths = [(r["slug"], os.path.join(root, r["file_path"])) for r in files.join(fragments, "slug", "left_semi").select("slug", "file_path").toLocalIterator()]
    sources = [(slug, open(path, encoding="utf-8").read()) for slug, path in paths if os.path.isfile(path)]
    done = gates.reconcile(files, headings, fragments, sections, contracts, spark.createDataFrame(sources, "slug string, text string"))
    items = done.report.join(files.select("slug", "file_path"), "slug").orderBy("file_path", "item")
    for r in items.toLocalIterator():
        report[r["bucket"]].setdefault(r["kind"], []).append({"slug": r["slug"], "item": r["item"]})
    for r in done.fragments.where("changed").toLocalIterator():
        with open(os.path.join(session, "fragments", f"{r['slug']}.html"), "w", encoding="utf-8") as f:
            f.write(r["html"])
    stay = done.contracts.groupBy("slug").agg(F.array_sort(F.collect_list("ord")).alias("kept"))
    for r in analyses.where(F.size("contracts") > 0).join(fragments, "slug", "left_semi").join(stay, "slug", "left").where(F.size("contracts") > F.size(F.coalesce("kept", F.array().cast("array<int>")))).toLocalIterator():
        path = os.path.join(session, "analysis", f"{r['slug']}.json")
        with open(path, encoding="utf-8") as f:
            analysis = json.load(f)
        analysis["contracts"] = [analysis["contracts"][i] for i in r["kept"] or []]
        _dump(path, analysis)
    return int(any(report["genuine_gaps"].values())), report


def load(spark: SparkSession, session: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, edges, findings, analyses) of a session; missing or unreadable findings and analyses give no rows."""
    return *read_structure(spark, session), read_findings(spark, session), read_analyses(spark, session)
