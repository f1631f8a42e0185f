"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each signal of a text has cutoffs from lenient to strict. On labelled holdouts, a cutoff is certified
for a stratum (the language) if the exact binomial (Clopper-Pearson) upper bound on its false
rejections, the share of good documents above it, stays within ``risk``. Cutoffs are tested in that
fixed order up to the first that fails, which needs no correction among them; the level is divided by
the number of (stratum, signal) tests (Bonferroni). So with probability 1 - ``delta`` all certified
cutoffs together reject at most signals x risk of any stratum's good documents. Of the certified ones
the strictest is used, if it rejects at least ``power`` of the stratum's bad labels: a signal that
finds hardly any bad document isn't worth its false rejections. Strata without enough labels get no
cutoff, and their documents stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import let, shielded, words, written

#: False rejections allowed for a signal in a stratum; overall chance to exceed any; least share of bad labels found.
RISK, DELTA, POWER = 0.0125, 0.05, 0.05
#: Cutoffs of each signal, lenient to strict: a document is rejected above one.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.48, 0.44, 0.4, 0.35, 0.3, 0.25, 0.2),
    "mean_word": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0),
}
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Labels go to every executor up to so many (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_LABELS = 1_000_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows whose 64-bit hashes agree are few, and are compared by their words."""

    def twice(marks: Column, key: str) -> Column:
        """Those that agree on the key with another one, sorted by it."""
        return let(F.array_sort(marks), lambda o: F.filter(o, lambda x, i: (x[key] == F.get(o, i + 1)[key]) | ((i > 0) & (x[key] == F.get(o, i - 1)[key]))))

    def covered(w: Column, marks: Column) -> Column:
        spelled = F.transform(twice(marks, "h"), lambda x: F.struct(F.array_join(F.slice(w, x["i"] + 1, F.lit(3)), " ").alias("words"), x["i"].alias("i")))
        places = F.sort_array(F.transform(twice(spelled, "words"), lambda x: x["i"]))
        # each window covers three words, or as many as the next one's start leaves
        return let(places, lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"]))

    def of(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(ws, of))


def measures(text: Column) -> Column:
    """Struct of MEASURES; of null all 0."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols"))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, the MEASURES and base_failed."""
    df = df.withColumn("_m", F.explode(F.array(measures(F.col(text_col)))))  # a generator: what refers to it is not merged into it, so a text is measured once
    where = {"n_symbols": "_m.n_symbols", "n_lines": "_m.l.n_lines", "n_dup_lines": "_m.l.n_dup_lines"}
    df = df.withColumns({m: F.col(where.get(m, f"_m.w.{m}")) for m in MEASURES}).drop("_m")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def signals() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"), "mean_word": part("word_chars", "n_words")}


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X, exact but for rounding; terms are summed from their logarithms."""
    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("sum"))

    def term(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["sum"] + F.exp(t)).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), first, term, lambda a: a["sum"])


def thresholds(labelled: DataFrame, risk: float = RISK, delta: float = DELTA, power: float = POWER, stratum_col: str = "lang") -> DataFrame:
    """_stratum and the cutoff of each signal (null: none), from rows with measures, ``quality`` (1 good, 0 bad) and the stratum; rows that fail the base rules take no part."""
    rows = labelled.where(~F.col("base_failed") & F.col("quality").isin(0, 1)).select(F.col(stratum_col).alias("_stratum"), "quality", *(c.alias(n) for n, c in signals().items()))
    grid = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(i).alias("no"), F.lit(c).alias("cutoff"), (F.col(s) > c).alias("above")) for s, cs in CUTOFFS.items() for i, c in enumerate(cs)))
    good, above = F.col("quality") == 1, F.col("_g.above")
    counts = rows.select("_stratum", "quality", F.explode(grid).alias("_g")).groupBy("_stratum", "_g.signal", "_g.no", "_g.cutoff").agg(
        F.count_if(good).alias("n_good"), F.count_if(good & above).alias("k_good"), F.count_if(~good).alias("n_bad"), F.count_if(~good & above).alias("k_bad"))
    everything = counts.groupBy("_stratum", "signal").agg(F.sort_array(F.collect_list(F.struct("no", "cutoff", "n_good", "k_good", "n_bad", "k_bad"))).alias("_c"))  # the grid's size
    tests = everything.agg(F.count("*").alias("_tests"))
    sure = lambda c: (c["k_good"] < risk * c["n_good"]) & (binomial_at_most(c["k_good"], c["n_good"], risk) <= delta / F.col("_tests"))
    checked = everything.join(tests).withColumn("_ok", F.transform("_c", sure))
    passed = F.coalesce(F.nullif(F.array_position("_ok", F.lit(False)), F.lit(0)) - 1, F.size("_ok").cast("long")).cast("int")
    last = F.get(F.col("_c"), passed - 1)
    used = checked.select("_stratum", "signal", F.when(last["k_bad"] >= F.greatest(F.lit(1.0), power * last["n_bad"]), last["cutoff"]).alias("cutoff"))
    return used.groupBy("_stratum").agg(*(F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"_cut_{s}") for s in CUTOFFS))


def usable_labels(labels: DataFrame) -> DataFrame:
    """_label_id and quality, a row an id."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.min("quality").alias("quality"))


def cutoffs(holdout: DataFrame, stratum_col: str = "lang", **limits: float) -> DataFrame:
    """The thresholds of measured rows with their quality, as a written table: a row a stratum."""
    return written(thresholds(holdout, stratum_col=stratum_col, **limits), "quality-cutoffs").withColumnRenamed("_stratum", "_cut_stratum")


def judged(rows: DataFrame, cuts: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Measured rows with ``kept``: neither failed by the base rules nor above a cutoff of their stratum."""
    out = rows.join(cuts, F.col(stratum_col).eqNullSafe(F.col("_cut_stratum")), "left")
    rejected = F.lit(False)
    for name, value in signals().items():
        rejected = rejected | F.coalesce(value > F.col(f"_cut_{name}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cut_stratum", *(f"_cut_{s}" for s in CUTOFFS))


def passing(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", **limits: float) -> DataFrame:
    """The rows that are kept, with their columns, whatever their names.

    Null texts have no words and go; a null language is a stratum of its own; an empty table or one
    without labels has no cutoffs, only the base rules. Repeated rows are judged alike. Only labelled
    texts are measured for the cutoffs; ids of labels go to every executor if they are few.
    """
    rows, name, back = shielded(df)
    given = usable_labels(labels)
    known = F.broadcast(given) if given.count() <= BROADCAST_LABELS else given
    holdout = measured(rows.join(known, F.col(name[id_col]) == F.col("_label_id")), name[text_col])
    cuts = cutoffs(holdout, name[stratum_col], **limits)
    return back(judged(measured(rows, name[text_col]), cuts, name[stratum_col]).where("kept"))


def digest(df: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    Null texts have no words and fail; a null language is a stratum of its own. Labels of null ids or
    other values than 0 and 1 are left out; of several labels for one id the lower counts. Repeated
    rows are judged alike. Without labels there are no cutoffs.
    """
    rows = measured(df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")).drop("text")
    rows = written(rows, "quality-measures")
    cuts = cutoffs(rows.join(usable_labels(labels), F.col("doc_id") == F.col("_label_id")), **limits)
    rows = judged(rows, cuts)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
