"""Case queries: orders as cases, lineitem as evidence, events as custody and reviews."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.operators import cases
from provenix.plans.registry import query, table
from provenix.sources import storage
from provenix.sources.shared import shared_dir

c = F.col
#: Every order is a flag, and every line of an order that was returned or accepted is a review of it; the last by date, part and line counts.
REVIEWS_SQL = "reviews AS (SELECT l_orderkey AS flag_id, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'dismissed' ELSE 'unsure' END AS verdict, (l_shipdate, l_partkey, l_linenumber) AS moment, l_partkey, l_linenumber FROM lineitem)"


def _flags(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(c("o_orderkey").alias("flag_id"))


def _reviews(s: SparkSession, d: str) -> DataFrame:
    verdict = F.when(c("l_returnflag") == "A", "confirmed").when(c("l_returnflag") == "R", "dismissed").otherwise("unsure")
    return table(s, d, "lineitem").select(c("l_orderkey").alias("flag_id"), verdict.alias("verdict"), F.struct("l_shipdate", "l_partkey", "l_linenumber").alias("moment"), "l_partkey", "l_linenumber")


query("flags_with_latest_review", f"WITH {REVIEWS_SQL} SELECT o_orderkey AS flag_id, arg_max(verdict, moment) AS verdict, arg_max(l_partkey, moment) AS l_partkey FROM orders LEFT JOIN reviews ON flag_id = o_orderkey GROUP BY o_orderkey")(
    lambda s, d: cases.with_latest_review(_flags(s, d), _reviews(s, d), "flag_id", "moment", "verdict", "l_partkey"))
query("review_semi_join", f"WITH {REVIEWS_SQL} SELECT flag_id, l_partkey, l_linenumber FROM reviews WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = flag_id)")(lambda s, d: _reviews(s, d).join(_flags(s, d), "flag_id", "left_semi").select("flag_id", "l_partkey", "l_linenumber"))
query("unreviewed_anti_join", f"WITH {REVIEWS_SQL} SELECT o_orderkey AS flag_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM reviews WHERE flag_id = o_orderkey)")(lambda s, d: _flags(s, d).join(_reviews(s, d), "flag_id", "left_anti"))
query("latest_status", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")(lambda s, d: cases.latest(table(s, d, "events"), "user_id", "event_type", "event_id"))
query("custody_chain", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")(
    lambda s, d: cases.numbered(table(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", c("evidence_no").cast("long").alias("seq")))
query("evidence_sequence", "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || '-E' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR, 2, '0') AS evidence_id FROM lineitem")(
    lambda s, d: cases.numbered(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "evidence_id"))
_SNAPSHOT = "l_partkey || ':' || l_suppkey || ':' || l_returnflag"


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sha2(F.concat_ws(":", c("l_partkey").cast("string"), c("l_suppkey").cast("string"), "l_returnflag"), 256).alias("snapshot_sha256"))


query("manifest_items", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256({_SNAPSHOT}) AS snapshot_sha256 FROM lineitem")(_items)
_VERIFY = "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size % 10 = 0 THEN 'unreadable' WHEN sha256(l_partkey::VARCHAR) = sha256((p_partkey + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) THEN 'ok' ELSE 'changed' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 11 <> 0"


def _verify(s: SparkSession, d: str) -> DataFrame:
    found = F.when(c("p_size") % 10 != 0, F.sha2((c("p_partkey") + F.when(c("p_size") % 7 == 0, 1).otherwise(0)).cast("string"), 256))
    disk = table(s, d, "part").where("p_partkey % 11 <> 0").select("p_partkey", found.alias("found"), F.lit(True).alias("present"))
    items = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("p_partkey"), F.sha2(c("l_partkey").cast("string"), 256).alias("recorded"))
    return items.join(disk, "p_partkey", "left").select("l_orderkey", "l_linenumber", cases.verify_status(c("recorded"), c("found"), c("present")).alias("status"))


query("verify_status", _VERIFY)(_verify)
query("verify_tally", f"SELECT status, count(*) AS n FROM ({_VERIFY}) GROUP BY status")(lambda s, d: _verify(s, d).groupBy("status").agg(F.count("*").alias("n")))
query("list_cases_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")(
    lambda s, d: cases.placed(table(s, d, "orders").select("o_orderdate", "o_orderkey"), "place", "o_orderdate", "o_orderkey").select("o_orderkey", "place"))


@query("case_stats", """SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS evidence, (SELECT count(*) FROM events WHERE user_id = o_orderkey) AS custody_events, (SELECT count(*) FROM events WHERE user_id = o_orderkey AND event_type = 'view') AS notes,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS reviews, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in-progress' ELSE 'closed' END AS status FROM orders""")
def case_stats(s: SparkSession, d: str) -> DataFrame:
    """Orders as cases: lines as evidence (returned ones as reviews), events of the user of that number as custody (views as notes)."""
    lines, events = table(s, d, "lineitem"), table(s, d, "events")
    tables = {"evidence": lines.select(c("l_orderkey").alias("case_id")), "custody_events": events.select(c("user_id").alias("case_id")), "notes": events.where("event_type = 'view'").select(c("user_id").alias("case_id")),
              "reviews": lines.where("l_returnflag = 'R'").select(c("l_orderkey").alias("case_id"))}
    status = F.when(c("o_orderstatus") == "O", "open").when(c("o_orderstatus") == "P", "in-progress").otherwise("closed")
    return cases.stats(table(s, d, "orders").select("o_orderkey", c("o_orderkey").alias("case_id"), status.alias("status")), tables).drop("case_id")


def _lifecycle(s: SparkSession, d: str) -> cases.CaseStore:
    """A store with a case for each region and its nations as evidence, reviewed, noted and partly closed; region and nation are of fixed size."""
    store = cases.CaseStore(s, shared_dir(s, "case-store"))
    regions = {r.r_regionkey: r.r_name for r in table(s, d, "region").collect()}
    ids = {k: store.create(regions[k], f"region {k}", when="2026-01-02T03:04:05Z", year=2026) for k in sorted(regions)}
    nations = table(s, d, "nation").where(c("n_nationkey").isNotNull())
    for k, case in ids.items():
        found = nations.where(c("n_regionkey") == k).select(F.concat(F.lit("/n/"), F.lpad(c("n_nationkey").cast("string"), 2, "0")).alias("path"), F.sha2("n_name", 256).alias("sha256"),
            F.concat(F.lit('{"anomalies":[{"rule_id":"serial-number-conflict","severity":"high","confidence":80,"title":"t"}],"name":"'), c("n_name"), F.lit('"}')).alias("snapshot_json"))
        store.add_evidence(case, found, when="2026-01-02T03:04:06Z")
        store.add_note(case, f"note of {k}", when="2026-01-02T03:04:07Z")
        store.review(case, f"{case}-E01:serial-number-conflict", "unsure", when="2026-01-02T03:04:08Z")
        if k % 2:
            store.review(case, f"{case}-E01:serial-number-conflict", "confirmed", when="2026-01-02T03:04:09Z")
            store.set_status(case, "closed", "done", when="2026-01-02T03:04:10Z")
    return store


_CASE = "'MT-CASE-2026-' || lpad((r_regionkey + 1)::VARCHAR, 3, '0')"
_NO = "lpad((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::VARCHAR, 2, '0')"
query("case_lifecycle", f"SELECT {_CASE} AS id, r_name AS title, CASE WHEN r_regionkey % 2 = 1 THEN 'closed' ELSE 'open' END AS status, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS evidence, CASE WHEN r_regionkey % 2 = 1 THEN 6 ELSE 4 END::BIGINT + (SELECT count(*) - 1 FROM nation WHERE n_regionkey = r_regionkey) AS custody_events, CASE WHEN r_regionkey % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS notes, CASE WHEN r_regionkey % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS reviews FROM region")(
    lambda s, d: _lifecycle(s, d).overview().select("id", "title", "status", "evidence", "custody_events", "notes", "reviews"))
query("case_flags", f"SELECT flag_id, rule_id, CASE WHEN e = '01' THEN CASE WHEN r % 2 = 1 THEN 'confirmed' ELSE 'unsure' END END AS verdict FROM (SELECT {_CASE} || '-E' || {_NO} || ':serial-number-conflict' AS flag_id, 'serial-number-conflict' AS rule_id, {_NO} AS e, r_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey)")(
    lambda s, d: _lifecycle(s, d).flags().select("flag_id", "rule_id", "verdict"))
query("case_manifest", f"SELECT {_CASE} || '-E' || {_NO} AS evidence_id, '/n/' || lpad(n_nationkey::VARCHAR, 2, '0') AS path, sha256(n_name) AS sha256, sha256('{{\"anomalies\":[{{\"rule_id\":\"serial-number-conflict\",\"severity\":\"high\",\"confidence\":80,\"title\":\"t\"}}],\"name\":\"' || n_name || '\"}}') AS snapshot_sha256 FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: _lifecycle(s, d).manifest_items().select("evidence_id", "path", "sha256", "snapshot_sha256"))


@query("verify_files", "SELECT 'r' || n_regionkey || '/' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 1 THEN 'changed' WHEN n_nationkey % 5 = 2 THEN 'missing' ELSE 'ok' END AS status FROM nation")
def verify_files(s: SparkSession, d: str) -> DataFrame:
    """Evidence files, some of which are changed and some removed after they were recorded, hashed again."""
    root = shared_dir(s, "verified")
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # of fixed size
    kept = [(f"{root}/r{n.n_regionkey}/{n.n_nationkey}", n) for n in rows]
    for path, n in kept:
        if n.n_nationkey % 5 != 2:
            storage.write_file(s, path, n.n_name.encode() + b"!" * (n.n_nationkey % 5 == 1))
    recorded = s.createDataFrame([(path, hashlib.sha256(n.n_name.encode()).hexdigest()) for path, n in kept], "path string, sha256 string")
    return cases.verify(recorded).select(F.regexp_extract("path", r"(r\d+/\d+)$", 1).alias("path"), "status")
