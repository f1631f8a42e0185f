"""The commands as functions that return a Result, their text form, and a command line over them.

Tables stay DataFrames until they are shown: a Result holds what a report prints, so commands over many
files take what they list (files, groups, matches) with ``listed`` rows at most in its data, and the
whole as DataFrames in ``frames``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix import config
from provenix.functions import geo
from provenix.operators import batch as batches
from provenix.operators import cases, files, search
from provenix.results import Finding, Result, audit, progress
from provenix.sources import images, index, storage

#: Rows of a list that a Result holds at most; the frame has all of them.
LISTED = 1000


@dataclass
class Session:
    """What commands share: Spark, the settings and the folder of the case store."""

    spark: SparkSession
    settings: config.Config = field(default_factory=config.load)
    store: str = ""
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def limits(self) -> config.Limits:
        return self.settings.limits

    def case_store(self) -> cases.CaseStore:
        if not self.store:
            raise cases.CaseError("no folder is given for the case store")
        return cases.CaseStore(self.spark, self.store)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(LISTED).collect()]


def _file(s: Session, path: str, tolerance_s: float = 60.0) -> dict:
    """The analysis of one file. A file that isn't there, can't be read or is too large is an OSError or ValueError."""
    place = storage.local(path)
    if place is not None:
        folder = place.rpartition("/")[0] or "."
        if place not in storage.list_files(folder) and f"./{place}" not in storage.list_files(folder):
            raise FileNotFoundError(f"no such file: {path}")
        one = s.spark.createDataFrame([(place,)], "path string").mapInArrow(storage._read(s.limits.max_file_size_bytes), storage.FILES)
    else:
        one = storage.scan(s.spark, path.rpartition("/")[0], largest=s.limits.max_file_size_bytes).where(F.col("path") == path)
    found = files.analyze(images.extract(one, s.limits), tolerance_s).drop("content").first()
    if found is None:
        raise FileNotFoundError(f"no such file: {path}")
    row = found.asDict(recursive=True)
    if row["sha256"] is None or row["status"] == "error":
        raise ValueError(row["error"])
    return row


def _findings(row: dict) -> list[Finding]:
    """What the decoders and the normalization had to say about a file."""
    kept, out = ["parser continued; partial results kept"], []
    if row["format"] == "UNKNOWN":
        out.append(Finding("unrecognized file format", "info", "magic bytes match no known image format; treated as opaque evidence"))
    for label, warnings in (("EXIF", row["warnings"]), *((n.upper(), (row[n] or {}).get("warnings")) for n in ("xmp", "iptc", "icc")), ("thumbnail", row["thumbnail_warnings"])):
        out += [Finding(f"{label} parser warning", "low", w, kept) for w in warnings or []]
    if row["has_gps"] and not row["gps_valid"]:
        out.append(Finding("GPS metadata validity issue", "low", "coordinates are out of range"))
    icc = row["icc"] or {}
    if icc.get("present") and icc.get("signature_valid") is False:
        out.append(Finding("ICC profile signature invalid", "medium", "the embedded ICC profile fails the 'acsp' check; its color claims are not trustworthy"))
    for t in row["timestamps"] or []:
        if not t["parseable"] and t["raw"] is not None and t["source"].startswith(("XMP", "IPTC")):
            out.append(Finding("unparseable timestamp", "low", f"{t['source']} carries a timestamp that could not be parsed: {t['raw']!r}; kept verbatim"))
    return out


def _of_file(command: str, s: Session, path: str, fill: Callable[[Result, dict], None], tolerance_s: float = 60.0) -> Result:
    result = Result(command, path)
    try:
        row = _file(s, path, tolerance_s)
    except (OSError, ValueError) as e:
        return result.fail(str(e))
    for f in _findings(row):
        result.add(f)
    fill(result, row)
    return result


def _dims(row: dict) -> str:
    return f"{row['width']}x{row['height']}" if row["width"] and row["height"] else "dimensions unknown"


def inspect(s: Session, path: str, sha512: bool = False, map_link: bool = False) -> Result:
    def fill(result: Result, row: dict) -> None:
        result.data = {"analysis": row}
        if map_link and row["has_gps"]:
            result.data["map_link"] = f"https://www.openstreetmap.org/?mlat={row['lat']:.6f}&mlon={row['lon']:.6f}#map=15/{row['lat']:.6f}/{row['lon']:.6f}"
        exif = any(row[n] is not None for n in (*images.TEXTS, *images.NUMBERS)) or row["has_gps"]
        note = "EXIF present" if exif else "no EXIF data" if row["format"] in ("JPEG", "TIFF") else "EXIF n/a"
        more = [n.upper() for n in ("xmp", "iptc", "icc") if row[n] and (n != "icc" or row[n]["present"])]
        result.summary = f"{row['filename']}: {row['format']} {_dims(row)}, {row['size_bytes']} bytes, {' + '.join([note, *more])}"

    if sha512:
        wanted = tuple(dict.fromkeys((*s.limits.hash_algorithms, "sha512")))
        s = replace(s, settings=replace(s.settings, limits=replace(s.limits, hash_algorithms=wanted)))
    return _of_file("inspect", s, path, fill)


def timeline(s: Session, path: str) -> Result:
    def fill(result: Result, row: dict) -> None:
        order = lambda t: (0, t["value_utc"]) if t["value_utc"] else (1, t["wall"]) if t["wall"] else (2, t["raw"] or "")
        result.data = {"timeline": sorted(row["timestamps"], key=order), "evidence_id": row["evidence_id"]}
        result.summary = f"timeline for {row['filename']}: {len(row['timestamps'])} timestamp(s)"

    return _of_file("timeline", s, path, fill)


def analyze(s: Session, path: str, tolerance_s: float = 60.0) -> Result:
    def fill(result: Result, row: dict) -> None:
        flags = row["flags"]
        result.data = {"analysis": row, "tolerance_s": tolerance_s, "anomalies": flags, "notes": [row["zone_note"]] if row["zone_note"] else []}
        for f in flags:
            if f["severity"] == "high":
                result.add(Finding(f"anomaly: {f['title']}", "high", f["explanation"], [f"rule: {f['rule_id']}", f"sources: {', '.join(f['sources'])}"], f["confidence"]))
        n = len(flags)
        result.summary = f"analyze {path}: {n} anomal{'y' if n == 1 else 'ies'} flagged" if n else f"analyze {path}: no anomalies detected"

    if not tolerance_s >= 0:
        return Result("analyze", path).fail("tolerance must be >= 0")
    return _of_file("analyze", s, path, fill, tolerance_s)


def thumbnails(s: Session, path: str, folder: str | None = None, force: bool = False) -> Result:
    """Lists embedded thumbnails, and writes them into a folder if one is given."""

    def fill(result: Result, row: dict) -> None:
        found, extracted = row["thumbnails"] or [], []
        if folder and found:
            one = storage.scan(s.spark, path.rpartition("/")[0] or ".").where(F.col("path") == path)
            for r in images.write_thumbnails(one, folder, force).collect():
                if not r.written:
                    result.fail(f"{folder}/{r.name} exists; it is replaced only if forced")
                    return
                extracted.append(f"{folder}/{r.name}")
                audit({"command": "thumbnails.extract", "target": path, "output": extracted[-1]})
        result.data = {"analysis": row, "extracted": extracted}
        result.summary = f"thumbnails {path}: {len(found)} embedded thumbnail(s)" + (f", {len(extracted)} extracted to {folder}" if extracted else "") if found else f"thumbnails {path}: none embedded"

    return _of_file("thumbnails", s, path, fill)


def config_show(s: Session) -> Result:
    return Result("config show", data=s.settings.shown(), summary=f"profile {s.settings.profile!r} from {s.settings.source}")


def _analyzed(s: Session, folder: str, recursive: bool, jobs: int | None) -> DataFrame:
    """All files of a folder, analyzed; ``jobs`` or the settings' are the tasks that decode, else as many as Spark deals."""
    if jobs is not None and jobs < 1:
        raise ValueError("jobs must be >= 1")
    found = storage.scan(s.spark, folder, recursive, s.limits.max_file_size_bytes)
    jobs = jobs or s.limits.batch_jobs
    return files.analyze(images.extract(found.repartition(jobs, "path") if jobs else found, s.limits))


def batch(s: Session, folder: str, recursive: bool = False, jobs: int | None = None, with_timeline: bool = False, index_path: str | None = None, csv: str | None = None, told: Callable[[int, int], None] | None = None) -> Result:
    """Analyzes a folder; the report's tables are in the session's frames, an index and a CSV are written if asked for."""
    result = Result("batch", folder)
    try:
        analyzed = _analyzed(s, folder, recursive, jobs)
        with progress(s.spark, told):
            s.frames = batches.report(analyzed, with_timeline)
    except (OSError, ValueError) as e:
        return result.fail(str(e))
    summary = s.frames["summary"].first().asDict()
    for name in ("by_format", "by_device", "by_capture_day", "by_location"):
        shown = s.frames[name] if name == "by_format" else batches.display_counts(s.frames[name])
        summary[name] = {r[0]: r["n"] for r in shown.limit(LISTED).collect()}
    result.data = {"batch": {"root": folder, "recursive": recursive, "jobs": jobs or s.limits.batch_jobs, "summary": summary, "duplicates": _rows(s.frames["duplicates"].orderBy("sha256"))}}
    if with_timeline:
        result.data["batch"]["timeline"] = _rows(s.frames["timeline"])
    duplicates = f", {summary['duplicate_groups']} duplicate group(s)" if summary["duplicate_groups"] else ""
    flagged = f", {summary['with_anomalies']} file(s) with anomaly flags" if summary["anomaly_flags"] else ""
    result.summary = f"batch {folder}: {summary['analyzed']} analyzed, {summary['skipped']} skipped, {summary['errors']} errors{duplicates}{flagged}"
    if index_path:
        index.write_index(s.frames["files"], index_path, folder)
        result.data["index"] = {"path": index_path, "records": summary["analyzed"]}
        result.summary += f", index: {summary['analyzed']} record(s)"
    if csv:
        batches.write_csv(batches.csv_rows(s.frames["files"]), csv)
    for r in s.frames["files"].where("status <> 'ok'").orderBy("path").select("path", "status", "error").limit(LISTED).collect():
        skipped = r.status == "skipped"
        result.add(Finding("file skipped" if skipped else "file failed analysis", "info" if skipped else "medium", f"{r.path}: {r.error}"))
    if summary["duplicate_groups"]:
        result.add(Finding("duplicate files detected", "info", f"{summary['duplicate_groups']} group(s), {summary['duplicate_files']} file(s) share identical content (SHA-256)", ["exact content match only"]))
    if summary["with_conflicts"]:
        result.add(Finding("files with conflicting timestamp claims", "info", f"{summary['with_conflicts']} file(s) have metadata sources that disagree; recorded, not judged"))
    return result


def build_index(s: Session, folder: str, index_path: str, recursive: bool = False, jobs: int | None = None) -> Result:
    result = Result("search", folder)
    try:
        index.write_index(_analyzed(s, folder, recursive, jobs), index_path, folder)
    except (OSError, ValueError) as e:
        return result.fail(str(e))
    n = index.read_index(s.spark, index_path).count()
    result.data = {"search_action": "build-index", "index_path": index_path, "records": n, "root": folder}
    result.summary = f"index {index_path}: {n} record(s) from {folder}"
    return result


def searched(s: Session, index_path: str, action: str = "search", **given: object) -> Result:
    """Records that match all filters (as texts, see search.Filters.parsed), their clusters or their timeline."""
    result = Result("search", index_path)
    try:
        filters = search.Filters.parsed(**given)
        records = index.read_index(s.spark, index_path)
    except (ValueError, index.IndexProblem) as e:
        return result.fail(str(e))
    matched = records.where(filters.predicate())
    n = matched.count()
    result.data = {"search_action": action, "filters": filters.describe()}
    if action == "clusters":
        located = matched.where("has_gps").withColumns({"lat": F.col("gps_lat"), "lon": F.col("gps_lon")})
        found, members = search.clusters(located)
        s.frames = {"clusters": found, "members": members}
        result.data |= {"clusters": _rows(found.orderBy("center_lat", "center_lon").drop("label")), "disclaimer": geo.DISCLAIMER}
        result.summary = f"search {index_path}: {found.count()} cluster(s) from {n} matching record(s)"
    elif action == "timeline":
        s.frames = {"timeline": batches.ordered(batches.timeline(matched))}
        result.data |= {"timeline": _rows(s.frames["timeline"])}
        result.summary = f"search {index_path}: {s.frames['timeline'].count()} timestamp(s) from {n} matching record(s)"
    else:
        s.frames = {"matches": matched}
        result.data |= {"total_records": records.count(), "matches": _rows(matched.orderBy("path"))}
        result.summary = f"search {index_path}: {n} of {result.data['total_records']} record(s) match"
    return result


def case(s: Session, action: str, case_id: str | None = None, **given: object) -> Result:
    """The operations of the case store: create, list, show, add, flags, review, note, custody, manifest, verify, report and status."""
    result = Result("case", case_id)
    try:
        _case(s, s.case_store(), result, action, case_id, given)
    except (cases.CaseError, OSError, ValueError) as e:
        return result.fail(str(e))
    result.data = {"case_action": action} | result.data
    return result


def _case(s: Session, store: cases.CaseStore, result: Result, action: str, case_id: str | None, given: dict) -> None:
    if action == "create":
        new = store.create(given["title"], given.get("description") or "")
        result.data, result.summary = {"case": store.get(new)}, f"case {new} created: {given['title']}"
    elif action == "list":
        found = _rows(store.cases())
        result.data, result.summary = {"cases": found}, f"{len(found)} case(s)" if found else "no cases yet"
    elif action == "show":
        info, counts = store.get(case_id), store.counts(case_id)
        result.data, result.summary = {"case": info, "counts": counts}, f"case {case_id}: {info['title']} [{info['status']}], {counts['evidence']} evidence item(s)"
    elif action == "add":
        store.get(case_id)
        row = _file(s, given["image"])
        shown = storage.snapshot(row)
        store.add_evidence(case_id, s.spark.createDataFrame([(given["image"], row["sha256"], shown)], "path string, sha256 string, snapshot_json string"), given.get("note") or "")
        last = store.evidence(case_id).orderBy(F.desc("n")).first().asDict()
        result.data = {"case_id": case_id, "evidence": last, "anomaly_count": len(row["flags"])}
        result.summary = f"added {given['image']} to {case_id} as {last['id']} ({len(row['flags'])} anomal{'y' if len(row['flags']) == 1 else 'ies'} flagged)"
    elif action == "flags":
        found = _rows(store.flags(case_id).orderBy("flag_id"))
        result.data, result.summary = {"flags": found}, f"{case_id}: {len(found)} anomaly flag(s)"
    elif action == "review":
        store.review(case_id, given["flag"], given["verdict"], given.get("note") or "")
        result.data, result.summary = {"case_id": case_id, "review": {k: given.get(k) for k in ("flag", "verdict", "note")}}, f"review recorded: {given['flag']} -> {given['verdict']} ({case_id})"
    elif action == "note":
        store.add_note(case_id, given["text"])
        result.data, result.summary = {"case_id": case_id}, f"note added to {case_id}"
    elif action == "custody":
        found = _rows(store.custody(case_id))
        result.data, result.summary = {"events": found}, f"{case_id}: {len(found)} custody event(s)"
    elif action == "manifest":
        made = store.manifest(case_id)
        store.log(case_id, "manifest", f"sha256={made['sha256'][:16]}…")
        if given.get("output"):
            storage.write_file(s.spark, storage.as_uri(given["output"]), (cases.canonical(made) + "\n").encode())
        result.data, result.summary = {"manifest": made}, f"manifest for {case_id}: {len(made['evidence'])} evidence item(s), sha256 {made['sha256'][:16]}…"
    elif action == "verify":
        checks = _rows(store.verify(case_id))
        bad = [c for c in checks if c["status"] != "ok"]
        for c in bad:
            reason = f"{c['path']}: recorded sha256 {c['expected_sha256'][:16]}… does not match the file" if c["status"] == "changed" else f"{c['path']}: {c['status']}"
            result.add(Finding(f"evidence {c['status']}: {c['evidence_id']}", "high" if c["status"] in ("changed", "missing") else "medium", reason, [f"evidence_id: {c['evidence_id']}"], 100))
        tally = ", ".join(f"{x}={sum(c['status'] == x for c in bad)}" for x in sorted({c["status"] for c in bad}))
        result.data, result.summary = {"checks": checks}, f"verify {case_id}: {len(checks) - len(bad)} ok, {tally or 'nothing changed'}"
    elif action == "report":
        made = store.report(case_id, given["output"], bool(given.get("force")))
        result.data, result.summary = made, f"report for {case_id} written to {made['output_dir']}: {len(made['artifacts'])} artifact(s)"
    elif action == "status":
        store.set_status(case_id, given["status"], given.get("note"))
        result.data, result.summary = {"case_id": case_id, "status": given["status"]}, f"case {case_id} status -> {given['status']}"
    else:
        raise ValueError(f"unknown case action {action!r}")


def _stamp(t: dict) -> str:
    if t.get("value_utc"):
        return t["value_utc"]
    return f"{t['wall']} (timezone unknown)" if t.get("wall") else f"unparseable: {t.get('raw') or '?'}"


def human(result: Result) -> str:
    """A Result as lines of text."""
    d, lines = result.data, [result.summary] if result.summary else []
    row = d.get("analysis")
    if row and result.command in ("inspect", "analyze"):
        lines += [f"  evidence:  {row['evidence_id']}", f"  sha256:    {row['sha256']}", *([f"  sha512:    {row['sha512']}"] if row.get("sha512") else []), f"  encoding:  {row['encoding']}", f"  device:    {row['device_display']}", f"  captured:  {row['capture_day_display']}"]
        if row["has_gps"]:
            lines += [f"  location:  {row['lat']:.6f}, {row['lon']:.6f}", f"  note       {geo.DISCLAIMER}", *([f"  map:       {d['map_link']}"] if "map_link" in d else [])]
        lines += [f"  {f['fact']:13} {f['status']}" for f in row["comparison"] or []]
    if row and result.command in ("inspect", "thumbnails"):
        lines += [f"  #{t['index']} {t['source']}: {t['width']}x{t['height']} {t['format']}, {t['byte_size']} bytes, sha256 {t['sha256'][:16]}…" for t in row["thumbnails"] or []]
    for f in d.get("anomalies") or []:
        lines += [f"  [{f['severity']}] {f['title']} (confidence {f['confidence']})", *(f"    {x}" for x in f["explanation"].split("\n") if x)]
    lines += [f"  note: {n}" for n in (d.get("notes") or []) if isinstance(n, str)]
    if "timeline" in d:
        lines += [f"  {_stamp(t) if 'value_utc' in t else t['timestamp'] or t['raw']:34} {t.get('filename', ''):24} {t['source']} {t['label']}" for t in d["timeline"]] or ["  (no timestamp claims)"]
    if "batch" in d:
        total = d["batch"]["summary"]
        lines += [f"  {k:18} {v}" for k, v in total.items() if not isinstance(v, dict)]
        for name in ("by_format", "by_device", "by_capture_day", "by_location"):
            lines += [f"  {name}:", *(f"    {k:40} {n}" for k, n in sorted(total[name].items()))]
        lines += [f"  note       {geo.DISCLAIMER}"] if total["by_location"] else []
    for r in d.get("matches") or []:
        lines.append(f"  {r['path'][:44]:44} {r['format'][:8]:8} {r['device_display'][:28]:28} {r['capture_day'][:10]:10} {','.join(r['anomaly_rule_ids']) or '-'}")
    if "clusters" in d:
        lines += [f"  note  {d['disclaimer']}", *(f"  #{i} {c['center_lat']:.4f}, {c['center_lon']:.4f} (radius {c['radius_km']:.2f} km): {c['n']} file(s), {c['first_day'] or 'date unknown'} .. {c['last_day'] or ''}" for i, c in enumerate(d["clusters"]))]
    lines += [f"  {c['id']}: {c['title']} [{c['status']}]" for c in d.get("cases") or []]
    if "case" in d:
        lines += [f"  {k + ':':12} {v}" for k, v in (d["case"] | d.get("counts", {})).items()]
    lines += [f"  {f['flag_id']} [{f['severity']}] {f['title']} (confidence {f['confidence']}) — {'reviewed: ' + f['verdict'] if f['verdict'] else 'unreviewed'}" for f in d.get("flags") or []]
    lines += [f"  [{e['ts_utc']}] {e['actor']}: {e['action']}" + (f" — {e['detail']}" if e["detail"] else "") for e in d.get("events") or []]
    lines += [f"  {c['evidence_id']}: {c['status']} ({c['path']})" for c in d.get("checks") or []]
    lines += [f"  {e['evidence_id']}: {e['path']} sha256 {e['sha256'][:16]}…" for e in (d.get("manifest") or {}).get("evidence", [])]
    lines += [f"  {name}: {digest[:16]}…" for name, digest in (d.get("artifacts") or {}).items()]
    if result.command == "config show":
        lines += [f"  {k}: {v}" for k, v in d.items()]
    lines += [f"  ! [{f.severity}] {f.title}: {f.reason}" for f in result.findings]
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("provenix")
    out.add_argument("--json", action="store_true")
    out.add_argument("--config")
    out.add_argument("--profile", default="default")
    out.add_argument("--store", default="")
    sub = out.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(a) for a in args)][0]
    one = add("inspect", "image")
    one.add_argument("--sha512", action="store_true")
    one.add_argument("--map-link", action="store_true")
    add("timeline", "image")
    add("analyze", "image").add_argument("--tolerance", type=float, default=60.0)
    small = add("thumbnails", "image")
    small.add_argument("--extract", dest="folder")
    small.add_argument("--force", action="store_true")
    add("config")
    many = add("batch", "directory")
    for flag in ("--recursive", "--timeline"):
        many.add_argument(flag, action="store_true")
    many.add_argument("--jobs", type=int)
    many.add_argument("--index")
    many.add_argument("--csv")
    found = add("search")
    found.add_argument("action", nargs="?", default="search", choices=("search", "clusters", "timeline"))
    found.add_argument("--index", required=True)
    found.add_argument("--build-index")
    found.add_argument("--recursive", action="store_true")
    for name in ("device", "date", "date-range", "near", "anomaly", "text", "hash"):
        found.add_argument(f"--{name}")
    found.add_argument("--gps", action="store_true")
    kept = add("case")
    kept.add_argument("action")
    kept.add_argument("case_id", nargs="?")
    for name in ("title", "description", "image", "note", "flag", "verdict", "text", "output", "status"):
        kept.add_argument(f"--{name}")
    kept.add_argument("--force", action="store_true")
    return out


def run(s: Session, a: argparse.Namespace) -> Result:
    if a.command == "inspect":
        return inspect(s, a.image, a.sha512, a.map_link)
    if a.command == "timeline":
        return timeline(s, a.image)
    if a.command == "analyze":
        return analyze(s, a.image, a.tolerance)
    if a.command == "thumbnails":
        return thumbnails(s, a.image, a.folder, a.force)
    if a.command == "config":
        return config_show(s)
    if a.command == "batch":
        return batch(s, a.directory, a.recursive, a.jobs, a.timeline, a.index, a.csv)
    if a.command == "search":
        if a.build_index:
            return build_index(s, a.build_index, a.index, a.recursive)
        return searched(s, a.index, a.action, **{n: getattr(a, n) for n in ("device", "date", "date_range", "gps", "near", "anomaly", "text", "hash")})
    given = {n: getattr(a, n) for n in ("title", "description", "image", "note", "flag", "verdict", "text", "output", "status", "force")}
    return case(s, a.action, a.case_id, **given)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command, prints its Result and returns its exit code."""
    a = parser().parse_args(argv)
    try:
        settings = config.load(a.config, a.profile)
    except config.ConfigError as e:
        print(Result(a.command).fail(str(e)).json() if a.json else e, file=sys.stdout if a.json else sys.stderr)
        return 2
    s = Session(spark or SparkSession.builder.getOrCreate(), settings, a.store)
    try:
        result = run(s, a)
    except AnalysisException as e:
        result = Result(a.command).fail(str(e))
    audit({"command": a.command, "target": result.target, "status": result.status})
    print(result.json() if a.json else human(result))
    return result.exit_code
