"""Case management on append-only tables: cases, evidence, custody, notes, reviews and status changes.

Nothing is updated: a case's state follows from its last status row, a flag's from its last review. Each
operation appends rows to Parquet folders below the store's root, and a custody row that says so. One
writer at a time is assumed; numbers follow from what is there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenix import __version__
from provenix.sources import storage
from provenix.sources.shared import shared_dir

STATUSES = ("open", "in-progress", "closed")
VERDICTS = ("confirmed", "dismissed", "unsure")
ACTOR = "analyst"
VERSION = 1
#: Rows of a range that one task numbers; bytes hashed at a time.
RANGE, CHUNK = 65_536, 1 << 20
#: The tables and their columns.
TABLES = {
    "cases": "id string, title string, description string, created_utc string", "status": "n long, case_id string, status string, ts_utc string",
    "evidence": "id string, n long, case_id string, path string, sha256 string, added_utc string, note string, snapshot_json string", "custody": "id long, case_id string, ts_utc string, actor string, action string, detail string",
    "notes": "id long, case_id string, ts_utc string, actor string, text string", "flag_reviews": "id long, case_id string, evidence_id string, flag_id string, rule_id string, verdict string, ts_utc string, actor string, note string",
}
_FLAGS = "array<struct<rule_id:string,severity:string,confidence:int,title:string,explanation:string,sources:array<string>,does_not_prove:string>>"


class CaseError(Exception):
    """The operation isn't possible; the message says why."""


def now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def latest(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key: state follows from events, nothing is updated."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_latest_review(flags: DataFrame, reviews: DataFrame, flag: str, order: str, *columns: str) -> DataFrame:
    last = reviews.groupBy(flag).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(flag, *(F.col(f"_r.{x}").alias(x) for x in columns))
    return flags.join(last, flag, "left")


def numbered(items: DataFrame, case: str, *order: str) -> DataFrame:
    """Evidence ids ``<case>-E01`` in order of insertion."""
    n = F.row_number().over(Window.partitionBy(case).orderBy(*order))
    return items.withColumn("evidence_no", n).withColumn("evidence_id", F.format_string("%s-E%02d", F.col(case).cast("string"), n))


def placed(items: DataFrame, name: str, *order: str) -> DataFrame:
    """``name`` from 1 over all rows in their order: ranges of the order are written, numbered each by itself and get their starts from counts."""
    spark = items.sparkSession
    path = shared_dir(spark, "cases-ranges")
    items.repartitionByRange(items.count() // RANGE + 1, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())  # a row a range
    starts = list(zip((k for k, _ in counts), accumulate((n for _, n in counts), initial=0)))  # noqa: B905
    inner = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    starts = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    return inner.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_i")).drop("_range", "_start", "_i")


def stats(cases: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The cases (case_id) with the number of their rows in each table."""
    for name, rows in tables.items():
        cases = cases.join(rows.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return cases


def verify_status(recorded: Column, found: Column, present: Column) -> Column:
    return F.when(~F.coalesce(present, F.lit(False)), "missing").when(found.isNull(), "unreadable").when(recorded == found, "ok").otherwise("changed")


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether a path's file is there, its SHA-256, read in chunks, and what went wrong."""
    for batch in batches:
        out = []
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            present, digest, detail = True, None, None
            try:
                fs, place = pafs.FileSystem.from_uri(storage.as_uri(path) if not path.startswith("file:") else "file://" + storage.local(path))
                present = fs.get_file_info(place).type == pafs.FileType.File
                if present:
                    h = hashlib.sha256()
                    with fs.open_input_stream(place) as f:
                        while chunk := f.read(CHUNK):
                            h.update(chunk)
                    digest = h.hexdigest()
            except (OSError, pa.ArrowException) as e:
                detail = str(e)
            out.append((present, digest, detail))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.bool_(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.bool_(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "present", "actual_sha256", "detail"])


def verify(recorded: DataFrame) -> DataFrame:
    """Rows (path, sha256, ...) with status ok, changed, missing or unreadable, and the hash found now: every file is read again by the tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recorded.schema) + ", present boolean, actual_sha256 string, detail string"
    return recorded.repartition("path").mapInArrow(_rehash, schema).withColumn("status", verify_status(F.col("sha256"), F.col("actual_sha256"), F.col("present"))).drop("present")


def snapshot_flags(evidence: DataFrame) -> DataFrame:
    """evidence_id, case_id, flag_id and the flags stored in snapshots; a snapshot that can't be read has none."""
    found = F.from_json("snapshot_json", f"anomalies {_FLAGS}", {"mode": "PERMISSIVE"})["anomalies"]
    each = evidence.select(F.col("id").alias("evidence_id"), "case_id", F.explode(found).alias("f"))
    return each.select("evidence_id", "case_id", F.concat("evidence_id", F.lit(":"), F.coalesce("f.rule_id", F.lit(""))).alias("flag_id"), "f.*")


def canonical(value: object) -> str:
    """JSON without white space and with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


class CaseStore:
    """The tables below a root folder that Spark writes and reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last: dict[str, int] = {}  # the last number given in a table, by the one writer
        try:
            found = spark.read.parquet(f"{self.root}/schema").first()["version"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise CaseError(f"{root} is no case store") from e
            spark.range(1).select(F.lit(VERSION).alias("version")).coalesce(1).write.parquet(f"{self.root}/schema")
            found = VERSION
        if found != VERSION:
            raise CaseError(f"case store {root} has schema version {found}, not {VERSION}; set it aside and start a new one")

    # tables

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])

    def _append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        rows = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, TABLES[name]).coalesce(1)
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _next(self, name: str, column: str = "id", many: int = 1) -> int:
        """The first of so many new numbers."""
        if name not in self._last:
            self._last[name] = self.table(name).agg(F.max(column)).first()[0] or 0
        self._last[name] += many
        return self._last[name] - many + 1

    def _known(self, case: str) -> None:
        if not self.table("cases").where(F.col("id") == case).limit(1).count():
            raise CaseError(f"unknown case: {case}")

    def log(self, case: str, action: str, detail: str = "", when: str | None = None) -> None:
        self._append("custody", [(self._next("custody"), case, when or now(), ACTOR, action, detail)])

    # cases

    def create(self, title: str, description: str = "", when: str | None = None, year: int | None = None) -> str:
        """A new case; its id is the next number of the (local) year."""
        prefix = f"MT-CASE-{year or datetime.now().year}-"
        last = self.table("cases").where(F.startswith("id", F.lit(prefix))).agg(F.max(F.substring("id", len(prefix) + 1, 9).try_cast("int"))).first()[0]
        case = f"{prefix}{(last or 0) + 1:03d}"
        self.put(case, title, description, when)
        return case

    def put(self, case: str, title: str, description: str = "", when: str | None = None) -> None:
        """A new case of a given id."""
        if self.table("cases").where(F.col("id") == case).limit(1).count():
            raise CaseError(f"case {case} already exists")
        when = when or now()
        self._append("cases", [(case, title, description, when)])
        self._append("status", [(self._next("status", "n"), case, "open", when)])
        self.log(case, "create", f"title: {title}", when)

    def cases(self) -> DataFrame:
        """All cases with their status, in order of creation."""
        return self.table("cases").join(latest(self.table("status"), "case_id", "status", "n").withColumnRenamed("case_id", "id"), "id").orderBy("created_utc", "id")

    def get(self, case: str) -> dict:
        found = self.cases().where(F.col("id") == case).first()
        if found is None:
            raise CaseError(f"unknown case: {case}")
        return found.asDict()

    def overview(self) -> DataFrame:
        """All cases with the counts of their rows."""
        tables = {"evidence": "evidence", "custody_events": "custody", "notes": "notes", "reviews": "flag_reviews"}
        return stats(self.cases().withColumn("case_id", F.col("id")), {k: self.table(t) for k, t in tables.items()}).drop("case_id")

    def counts(self, case: str) -> dict:
        self.get(case)
        found = self.overview().where(F.col("id") == case).first()
        return {k: found[k] for k in ("evidence", "custody_events", "notes", "reviews")}

    def set_status(self, case: str, status: str, note: str | None = None, when: str | None = None) -> None:
        """A case is closed only with a note."""
        if status not in STATUSES:
            raise CaseError(f"invalid status {status!r}; there are {', '.join(STATUSES)}")
        if status == "closed" and not note:
            raise CaseError("closing a case requires a note (record the resolution)")
        before, when = self.get(case)["status"], when or now()
        self._append("status", [(self._next("status", "n"), case, status, when)])
        if note:
            self._append("notes", [(self._next("notes"), case, when, ACTOR, note)])
        self.log(case, "status", f"{before} -> {status}" + (f"; note: {note[:120]}" if note else ""), when)

    # evidence

    def add_evidence(self, case: str, files: DataFrame, note: str = "", when: str | None = None) -> None:
        """Records files (path, sha256, snapshot_json) by their hashes and frozen analyses; contents are never copied. Many are added in order of their paths, each with a custody row."""
        self._known(case)
        when = when or now()
        before = self.table("evidence").where(F.col("case_id") == case).count()
        rows = placed(files.select("path", "sha256", "snapshot_json"), "_n", "path", "sha256", "snapshot_json").withColumn("n", F.col("_n") + before)
        rows = rows.select(F.format_string("%s-E%02d", F.lit(case), "n").alias("id"), "n", F.lit(case).alias("case_id"), "path", "sha256", F.lit(when).alias("added_utc"), F.lit(note).alias("note"), "snapshot_json")
        self._append("evidence", rows)
        added = self.table("evidence").where((F.col("case_id") == case) & (F.col("n") > before))
        first = self._next("custody", many=added.count())
        detail = F.concat("id", F.lit(": "), "path", F.lit(" sha256="), F.substring("sha256", 1, 16), F.lit("…"))
        self._append("custody", added.select((F.col("n") - before - 1 + first).alias("id"), "case_id", F.lit(when).alias("ts_utc"), F.lit(ACTOR).alias("actor"), F.lit("add-evidence").alias("action"), detail.alias("detail")))

    def evidence(self, case: str | None = None) -> DataFrame:
        """Evidence of a case, or of all, by id."""
        rows = self.table("evidence")
        if case is not None:
            self._known(case)
            rows = rows.where(F.col("case_id") == case)
        return rows.orderBy("id")

    def custody(self, case: str) -> DataFrame:
        self._known(case)
        return self.table("custody").where(F.col("case_id") == case).orderBy("id")

    def add_note(self, case: str, text: str, when: str | None = None) -> None:
        self._known(case)
        when = when or now()
        self._append("notes", [(self._next("notes"), case, when, ACTOR, text)])
        self.log(case, "note", text[:120], when)

    def notes(self, case: str) -> DataFrame:
        self._known(case)
        return self.table("notes").where(F.col("case_id") == case).orderBy("id")

    # flags and reviews

    def flags(self, case: str | None = None) -> DataFrame:
        """Flags of the snapshots of a case, or of all, with the verdict of their last review (null: unreviewed)."""
        return with_latest_review(snapshot_flags(self.evidence(case)), self.table("flag_reviews").withColumnRenamed("note", "review_note"), "flag_id", "id", "verdict", "ts_utc", "review_note")

    def review(self, case: str, flag_id: str, verdict: str, note: str = "", when: str | None = None) -> None:
        """A verdict on a flag that is there; earlier ones are kept."""
        if verdict not in VERDICTS:
            raise CaseError(f"invalid verdict {verdict!r}; there are {', '.join(VERDICTS)}")
        evidence, _, rule = flag_id.partition(":")
        if not evidence or not rule:
            raise CaseError(f"invalid flag id {flag_id!r}; it has to be '<evidence-id>:<rule-id>'")
        known = {r.rule_id for r in snapshot_flags(self.evidence(case).where(F.col("id") == evidence)).select("rule_id").distinct().collect()}  # the rules of one file
        if not known and not self.evidence(case).where(F.col("id") == evidence).limit(1).count():
            raise CaseError(f"unknown evidence {evidence} in {case}")
        if rule not in known:
            raise CaseError(f"no flag with rule {rule!r} on {evidence}")
        when = when or now()
        self._append("flag_reviews", [(self._next("flag_reviews"), case, evidence, flag_id, rule, verdict, when, ACTOR, note)])
        self.log(case, "review-flag", f"{flag_id} -> {verdict}", when)

    def reviews(self, case: str) -> DataFrame:
        self._known(case)
        return self.table("flag_reviews").where(F.col("case_id") == case).orderBy("id")

    # manifest, verification, report

    def manifest_items(self, case: str | None = None) -> DataFrame:
        return self.evidence(case).select(F.col("id").alias("evidence_id"), "path", "sha256", "added_utc", "note", F.sha2("snapshot_json", 256).alias("snapshot_sha256")).orderBy("evidence_id")

    def manifest(self, case: str, when: str | None = None) -> dict:
        """The items of a case, the number of custody rows and the hash of all of it but itself, as canonical JSON."""
        body = {"case_id": self.get(case)["id"], "generated_utc": when or now(), "tool_version": __version__, "evidence": [r.asDict() for r in self.manifest_items(case).toLocalIterator()], "custody_event_count": self.custody(case).count()}
        return body | {"sha256": hashlib.sha256(canonical(body).encode()).hexdigest()}

    def verify(self, case: str) -> DataFrame:
        """Each evidence file's status now; nothing is recorded, as looking changes nothing."""
        rows = self.evidence(case).select(F.col("id").alias("evidence_id"), "path", "sha256")
        return verify(rows).select("evidence_id", "path", F.col("sha256").alias("expected_sha256"), "actual_sha256", "status", "detail").orderBy("evidence_id")

    def report(self, case: str, folder: str, force: bool = False) -> dict:
        """Writes case, evidence, custody, flags and notes, and the digests of these five, into a folder; one that isn't empty only if forced. A custody row says so."""
        folder = storage.as_uri(folder).rstrip("/")
        info, counts = self.get(case), self.counts(case)
        fs, path = storage.hadoop(self.spark, folder)
        if fs.exists(path) and len(fs.listStatus(path)) and not force:
            raise CaseError(f"report output {folder} already exists and is not empty")
        rows = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]  # noqa: E731  a case's rows, as the report lists them
        flags = rows(snapshot_flags(self.evidence(case)).drop("case_id").orderBy("flag_id"))
        notes = "\n\n".join(f"[{n['ts_utc']}] {n['actor']}: {n['text']}" for n in rows(self.notes(case)))
        shown = lambda value: json.dumps(value, indent=2, sort_keys=True) + "\n"
        texts = {
            "case.json": shown(info | {"counts": counts}), "evidence.json": shown(self.manifest(case)), "custody.json": shown(rows(self.custody(case))), "flags.json": shown({"flags": flags, "reviews": rows(self.reviews(case))}),
            "notes.txt": notes + ("\n" if notes else ""),
        }
        artifacts = {}
        for name, text in texts.items():
            storage.write_file(self.spark, f"{folder}/{name}", text.encode())
            artifacts[name] = hashlib.sha256(text.encode()).hexdigest()
        storage.write_file(self.spark, f"{folder}/report-manifest.json", shown({"case_id": case, "artifacts": artifacts}).encode())
        self.log(case, "report", f"bundle written to {folder}")
        return {"output_dir": folder, "artifacts": artifacts, "evidence_count": counts["evidence"], "flag_count": len(flags)}


def valid_case_id(text: str) -> bool:
    return re.fullmatch(r"MT-CASE-\d{4}-\d{3,}", text) is not None
