"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a predicate over measures of one text. plan() runs every rule over a
bounded sample, takes its seconds and its share of rejected rows, and orders the rules
by rejections per second; apply() evaluates them in that order inside one CASE, so a
text that an early rule rejects never pays for the later ones. The order changes the
cost only: a text is kept if no rule rejects it.

All measures are computed inside the row (no shuffle). Repeated 3-word windows are
compared by 64-bit hashes within one text.

The text is split into words once for each row, and all rules and measures read that split.

Cases: a null, empty or blank text has no words and fails the base rule; a very long text is judged whole, in one row;
of several rules that reject, the first in the order counts (kept is the same in any order); rows with
null ids, repeated rows and extra columns pass through, and a new column whose name is taken gets underscores after it; an
empty table gives an empty result with the rules in their written order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_RUN, Scratch, documents, free_name, let

SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 1_000


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


def _repeated_positions(h: Column) -> Column:
    """Positions of the values of h that occur twice or more."""

    def few(d):
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i)))

    pairs = F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))
    by_sort = let(
        F.sort_array(pairs),
        lambda s: F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"]))),
            lambda x: x["i"],
        ),
    )
    doubled = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    return let(doubled, lambda d: F.when(F.size(d) <= 8, few(d)).otherwise(by_sort))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def covered(h):
        spread = F.flatten(F.transform(_repeated_positions(h), lambda p: F.array(p, p + 1, p + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.size(F.array_distinct(spread)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, covered)).cast("long")


class Measures:
    """Measures of one text by name; each is an expression of the text and its words, made where it is asked for, so a measure
    that no evaluated rule needs is not computed. `known` has those that are there already."""

    def __init__(self, text: Column, w: Column, known: dict[str, Column] | None = None):
        filled = F.coalesce(text, F.lit(""))
        self.known = known or {}
        self.by_name = {
            "n_words": lambda: F.size(w).cast("long"),
            "word_chars": lambda: F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": lambda: F.regexp_count(filled, F.lit(SYMBOLS)).cast("long"),
            "n_lines": lambda: F.size(worded_lines(text)).cast("long"),
            "n_dup_lines": lambda: let(worded_lines(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": lambda: repeat_words(w),
            "n_letter_words": lambda: F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long"),
        }

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else self.by_name[name]()


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


#: Production rules; all comparisons are between integers.
RULES = (
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("word_length", lambda m: ~m["word_chars"].between(2 * m["n_words"], 15 * m["n_words"])),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("no_letters", lambda m: 100 * m["n_letter_words"] < 80 * m["n_words"]),
)
BASE = ("too_short", "repeated_windows")


def plan(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) by rejections per second, most first.

    The sample has about sample_rows rows of all of docs, at any size of docs. All rules share one split into words, so it
    is made once and not charged to a rule; nor is what a job takes that evaluates no rule.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    scratch = Scratch(docs.sparkSession, "quality-sample")
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, sample_rows / total), seed=seed)
    sample = scratch.save(sample.select("text", words(F.col("text")).alias("w")).repartition(1), "sample")
    read = F.sum(F.octet_length("text").cast("long") + F.size("w"))

    def probe(rejects: Column) -> tuple[float, int, int]:
        job, took = sample.agg(read, F.count("w").alias("n"), F.count_if(rejects).alias("bad")), []
        for _ in range(3):
            began = time.perf_counter()
            row = job.first()
            took.append(time.perf_counter() - began)
        return min(took), row["n"], row["bad"]

    empty = probe(F.lit(False))[0]
    found = []
    for rule in rules:
        took, n, bad = probe(rule.rejects(Measures(F.col("text"), F.col("w"))))
        found.append((rule, max(took - empty, 1e-4), bad / n if n else 0.0))
    scratch.drop("sample")
    return sorted(found, key=lambda x: -x[2] / x[1])


def verdict(order: list[Rule], m: Measures) -> Column:
    """Name of the first rule of the order that rejects, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.rejects(m), rule.name).otherwise(out)
    return out


REJECTED_BY = "__rejected_by"


def cascade(docs: DataFrame, rules=RULES, report: tuple[str, ...] = ()) -> DataFrame:
    """docs plus __rejected_by, the first rule in cascade order that rejects the text (null: kept), and a column for each
    measure in `report` (computed for every row; the rules read it). New names are free_name() of these."""
    order = [r for r, _, _ in plan(docs, rules)]
    text = docs["text"].cast("string")

    def judged(w: Column) -> Column:
        m = Measures(text, w)
        if not report:
            return F.struct(verdict(order, m).alias(REJECTED_BY))
        given = F.struct(*[m[k].alias(k) for k in report])
        return let(given, lambda g: F.struct(*[g[k].alias(k) for k in report], verdict(order, Measures(text, w, {k: g[k] for k in report})).alias(REJECTED_BY)))

    inner = free_name(docs, "__judged")
    out = docs.withColumn(inner, let(words(text), judged))
    names = [free_name(docs, k) for k in (*report, REJECTED_BY)]
    return out.select(*docs.columns, *[F.col(inner)[k].alias(n) for k, n in zip((*report, REJECTED_BY), names, strict=True)])


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = cascade(documents(spark, sf_dir).select("doc_id", "text"), report=REPORT)
    base = [r.rejects({k: F.col(k) for k in REPORT}) for r in RULES if r.name in BASE]
    return out.select("doc_id", *REPORT, (base[0] | base[1]).alias("base_failed"), F.col(REJECTED_BY).isNull().alias("kept"))


def quality_sql(docs: str) -> str:
    """CTEs ending in `quality` (doc_id, the measures, base_failed, kept) over the relation docs."""
    return f"""
 q_text AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
 q_words AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM q_text),
 q_win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS a FROM q_words)),
 q_rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_win WHERE c > 1) GROUP BY doc_id),
 q_m AS (SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
   coalesce(r, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words FROM q_words LEFT JOIN q_rep USING (doc_id)),
 quality AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
     OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_letter_words < 80 * n_words) AS kept FROM q_m)"""


OP7_SQL = f"""WITH {quality_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality"""
