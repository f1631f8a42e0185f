"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must
satisfy: a list of clauses, each a set of trigrams that must all occur (letters in lower case). The
index holds postings (trigram, document) of the trigrams that queries mention; a document is known by the place of its row. Intersecting them gives
each rule's candidates, and only candidates are verified with the expression itself. A rule whose
query is empty, as it can match without any fixed trigram, scans every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import let, located, shielded, written

#: A set of alternatives is followed exactly up to so many strings.
EXACT = 64
#: Candidates go to every executor up to so many (16 bytes each); beyond, they are joined by shuffle, by the place of their row, which no two rows share.
BROADCAST_HITS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` as both Java and Python read it; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed by the contract of the scan.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _least(clauses) -> Clauses:
    """Without clauses that another one already covers."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _all_of(a: Clauses, b: Clauses) -> Clauses:
    both = _least(frozenset(x | y for x in a for y in b))
    return both if len(both) <= EXACT else min(a, b, key=len)


def _strings(strings: set[str]) -> Clauses:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Clauses]:
    """(all strings that the parsed expression can match, lower-cased, or None if they are too many; what any match needs)."""
    need, run, exact = ANY, {""}, True
    for op, arg in items:
        strings, clauses = _node(op, arg)
        if strings is not None and len(longer := {a + b for a in run for b in strings}) <= EXACT:
            run = longer
            continue
        exact = False
        need = _all_of(need, _strings(run))
        run = {""} if strings is None else strings
        need = _all_of(need, clauses if strings is None else ANY)
    return (run, ANY) if exact else (None, _all_of(need, _strings(run)))


def _node(op, arg) -> tuple[set[str] | None, Clauses]:
    if op is rc.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is rc.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                chars.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < 4:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 4 else (None, ANY)
    if op is rc.SUBPATTERN:
        return _walk(arg[3])
    if op is rc.BRANCH:
        branches = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in branches) and len(every := set().union(*(s for s, _ in branches))) <= EXACT:
            return every, ANY
        return None, _least(frozenset().union(*(c if s is None else _strings(s) for s, c in branches)))
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, item = arg
        strings, clauses = _walk(item)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), ANY
        return None, ANY if low == 0 else clauses if strings is None else _strings(strings)
    return None, ANY  # anchors, assertions, any character


def trigram_query(pattern: str) -> Clauses:
    """Clauses, one of which every match satisfies; ANY if no trigram is mandatory."""
    strings, clauses = _walk(rp.parse(pattern))
    return clauses if strings is None else _strings(strings)


def postings(df: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id) of the given trigrams, found in texts in lower case; any column may name the documents."""
    found = let(F.lower(F.col(text_col)), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return df.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """doc_id and a boolean for each query, of documents that satisfy at least one: postings intersected by document."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("_held"))  # at most the queries' trigrams
    holds = {k: _any_of(q) for k, q in queries.items()}
    return held.select("doc_id", *(c.alias(k) for k, c in holds.items())).where(" or ".join(f"`{k}`" for k in holds))


def _any_of(query: Clauses) -> Column:
    out = F.lit(False)
    for clause in sorted(map(sorted, query)):
        out = out | (F.size(F.array_except(F.array(*map(F.lit, clause)), F.col("_held"))) == 0)
    return out


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's leftmost, non-overlapping matches that are long enough, in code points.

    Each step matches the text up to the next match and the match itself, beginning where the last
    one ended, so lengths alone give the places.
    """
    step = F.lit(rf"\G([\s\S]*?)(?:{rule.pattern})")
    whole, gap = F.regexp_extract_all(text, step, F.lit(0)), F.regexp_extract_all(text, step, F.lit(1))
    value = F.regexp_extract_all(text, step, F.lit(rule.group + 1)) if rule.group else None
    long_enough = F.transform(value, lambda v: F.length(v) >= rule.least) if rule.group else F.zip_with(whole, gap, lambda w, g: F.length(w) - F.length(g) >= rule.least)
    parts = F.arrays_zip(F.transform(gap, F.length).alias("gap"), F.transform(whole, F.length).alias("whole"), long_enough.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def follow(acc: Column, p: Column) -> Column:
        found = F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["whole"]).alias("end"))
        return F.struct((acc["at"] + p["whole"]).alias("at"), F.when(p["ok"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, follow, lambda acc: acc["out"])


NONE = "cast(array() as array<struct<start:int,end:int>>)"


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", prefix: str = "_found_") -> DataFrame:
    """All columns, and ``_found_<kind>``, the array of spans of each rule; a column of the input so named is replaced.

    Null texts have none. Every row is a document of its own, whatever its id, and is verified on its
    own text, so repeated rows are kept and right. An empty table gives no rows.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if frozenset() not in q}
    inner, name, _ = shielded(df)
    text = F.col(name[text_col])
    out = inner
    if asked:
        grams = sorted({t for q in asked.values() for c in q for t in c})
        out = located(inner)
        hits = candidates(postings(out, grams, "_at", name[text_col]), asked)
        hits = written(hits.select(F.col("doc_id").alias("_at"), *(F.col(k).alias(f"_is_{k}") for k in asked)), "secret-candidates")
        out = out.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, "_at", "left")
    columns = {}
    for r in rules:
        sure = F.col(f"_is_{r.kind}") if r.kind in asked else text.rlike(r.pattern if r.group or r.least == 1 or not r.pattern.endswith("+") else f"{r.pattern[:-1]}{{{r.least},}}")
        columns[prefix + r.kind] = F.when(sure, spans(text, r)).otherwise(F.expr(NONE))
    return out.select(*(F.col(n).alias(c) for c, n in name.items() if c not in columns), *(x.alias(c) for c, x in columns.items()))


def listed(rules: tuple[Rule, ...], prefix: str = "_found_") -> Column:
    """All spans by start, then kind as listed: array<struct<start, no, end, kind>>."""
    def of(no: int, r: Rule) -> Column:
        return F.transform(F.col(prefix + r.kind), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(r.kind).alias("kind")))

    each = [of(i, r) for i, r in enumerate(rules)]
    return F.sort_array(F.concat(*each))


def digest(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each rule, base_sha256 and spans (``kind:start:end``, comma-joined)."""
    rows = scan(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rules)
    rows = rows.select("doc_id", *(F.size(f"_found_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules), listed(rules).alias("_all"))
    rows = rows.withColumn("spans", F.array_join(F.transform("_all", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","))
    return rows.select("doc_id", *(f"n_{r.kind}" for r in rules), F.sha2(F.encode("spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span, of whatever rule, replaced by ``mark``; overlapping spans are one. Other columns stay, whatever their names; null texts stay null."""
    inner, name, back = shielded(df)
    text = F.col(name[text_col])

    def hide(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(F.col("_all"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), hide, rest)
    found = scan(inner, rules, name[text_col]).withColumn("_all", listed(rules))
    return back(found.withColumn(name[text_col], F.when(F.size("_all") > 0, clean).otherwise(text)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS i FROM documents),
m AS (
  SELECT i, 'assign' AS kind, 0 AS no, regexp_extract_all(text, '(?s)(.*?)(ASSIGN)', 1) AS g,
         regexp_extract_all(text, '(?s)(.*?)(ASSIGN)', 2) AS w,
         list_transform(regexp_extract_all(text, '(?s)(.*?)(ASSIGN)', 4), lambda x: length(x) >= 6) AS ok FROM d
  UNION ALL
  SELECT i, 'access', 1, regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2),
         list_transform(regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2), lambda x: length(x) >= 20) FROM d
  UNION ALL
  SELECT i, 'hex', 2, regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 1), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2),
         list_transform(regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2), lambda x: length(x) >= 24) FROM d
),
u AS (SELECT i, kind, no, unnest(range(len(w))) AS j, unnest(g) AS g, unnest(w) AS w, unnest(ok) AS ok FROM m),
p AS (SELECT i, kind, no, ok, length(w) AS n, sum(length(g) + length(w)) OVER (PARTITION BY i, kind ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM u),
s AS (SELECT i, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
             string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, no) AS spans FROM p WHERE ok GROUP BY i)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (i)
""".replace("ASSIGN", RULES[0].pattern.replace("'", "''"))
