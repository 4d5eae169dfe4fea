"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Words lose surrounding punctuation and case; numbers, units after numbers and names (capitalised
words inside a sentence) become typed placeholders. Of slots in a row only the first (or a number with its unit, or a
name of two words) is a placeholder, the others keep their value: so tables of numbers and lists of names are compared by value, and every
window can be joined. Windows of WINDOW template tokens of a document are joined with those of the
benchmark items by the hash of the whole window; windows with a token that no item has are not hashed.
The windows of one document and item on one alignment vote on the slots: the value that most places of an item's
value have in the document (the first of equals) is its value there, and windows that hold another one are not
counted. A document is contaminated by an item if MIN_PERCENT of the item's windows or more are matched, so a question with
other numbers or names is still found.

The benchmark side is counted and broadcast up to BROADCAST_WINDOWS windows (under 100 bytes each);
a larger one is joined by a shuffle of ids, places and hashes.

Cases: null or empty texts have no windows; an item with fewer tokens than WINDOW is one window of its own
length, and is never found if more than half of it is placeholders; equal items match as items of their own; rows with null ids take part like others, on both sides; repeated rows of a
document or item count once, and equal ids with unequal texts are documents or items of their own; an empty
table on either side gives no rows; a very long text is one row and searched whole; of equally frequent values of a slot the first in the item counts; other
columns are ignored and can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, let

WINDOW, MIN_PERCENT = 8, 30
BROADCAST_WINDOWS = 500_000
PUNCTUATION = ".,;:!?()[]{}\"'`"
NUMBER = "^[0-9][0-9.,:/-]*$"
UNITS = ("g", "kg", "mg", "m", "km", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "%", "usd", "eur", "dollars", "euros", "percent", "mph", "kmh")
#: A slot begins with one of these characters; they stand for nothing else (see _marked).
NUM, NAME, UNIT = 1, 2, 3

_PUNCT = "[" + re.escape(PUNCTUATION) + "]*"
_WS = "\\x20\\x09-\\x0D"
_BETWEEN = f"(?:(?<!{_PUNCT[:-1]}){_PUNCT[:-1]}++)?[{_WS}]+{_PUNCT}"
_NAME = f"(?<=[^.!?{_WS}])([{_WS}]+{_PUNCT})(\\p{{Lu}}[^{_WS}]*)"
_NUMBER = f"(?<![^{_WS}])({_PUNCT})([0-9][0-9.,:/-]*{_PUNCT})(?![^{_WS}])"
_UNIT = f"(\x01[^{_WS}]*[{_WS}]+{_PUNCT})\x02?((?i:{'|'.join(map(re.escape, UNITS))}){_PUNCT})(?![^{_WS}])"


def _marked(text: Column) -> Column:
    """The text with a mark before each name, number and unit after a number, and A-Z in lower case.

    One pass of a pattern over the whole text is far cheaper than rules on each word.
    """
    filled = F.coalesce(text, F.lit(""))
    filled = F.when(filled.rlike("[\x01-\x03]"), F.translate(filled, "\x01\x02\x03", "\x04\x04\x04")).otherwise(filled)
    names = F.regexp_replace(filled, _NAME, "$1\x02$2")
    numbers = F.when(filled.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(names, _NUMBER, "$1\x01$2"), _UNIT, "$1\x03$2")).otherwise(names)
    return ascii_lower(numbers)


def _kind(value: Column) -> Column:
    """NUM, NAME or UNIT of a token's value, 0 for a plain word."""
    return value.bitwiseAND(F.lit(3))


def values(text: Column) -> Column:
    """A hash of each word, with its kind in the lowest two bits.

    One split removes white space and the punctuation beside it; the spaces added at both ends make the first and
    the last part empty. Marks are told by comparing strings, which needs no decoding.
    """

    def one(word):
        kind = F.when((word >= "\x04") | (word < "\x01"), 0).when(word < "\x02", NUM).when(word < "\x03", NAME).otherwise(UNIT)
        return F.xxhash64(word).bitwiseAND(F.lit(~3)).bitwiseOR(kind.cast("long"))

    parts = F.split(F.concat(F.lit(" "), _marked(text), F.lit(" ")), _BETWEEN)
    return let(parts, lambda p: F.transform(F.slice(p, 2, F.size(p) - 2), one))


def template(v: Column) -> Column:
    """The tokens of a text by its values: those of plain words, the kinds of slots."""

    def token(x, i):
        before = lambda k: F.coalesce(_kind(F.get(v, i - k)), F.lit(0))
        pair = (before(2) == 0) & (((before(1) == NUM) & (_kind(x) == UNIT)) | ((before(1) == NAME) & (_kind(x) == NAME)))
        return F.when(_kind(x) == 0, x).when((before(1) == 0) | pair, _kind(x)).otherwise(x)

    return F.transform(v, token)


def _prepared(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, __v (values) and __t (template tokens)."""
    return df.select(*ids, values(F.col("text")).alias("__v")).select(*ids, "__v", template(F.col("__v")).alias("__t"))


#: The vocabulary of the benchmark as a map of 64 * WORDS bits by token hash; full for a very large one, when it passes every token.
WORDS = 4096


def _spot(token: Column) -> tuple[Column, Column]:
    """Word and bit of a token in the map; its lowest two bits are its kind."""
    return F.shiftrightunsigned(token, 8).bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftrightunsigned(token, 2).bitwiseAND(F.lit(63)).cast("int")


def _vocabulary(items: DataFrame) -> Column:
    """The map of all tokens of the items, a constant of the plan."""
    word, bit = _spot(F.col("t"))
    tokens = items.select(F.explode("__t").alias("t")).select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    rows = {r["w"]: r["b"] for r in tokens.groupBy("w").agg(F.bit_or("b").alias("b")).collect()}  # WORDS rows at most
    return F.split(F.lit(",".join(str(rows.get(w, 0)) for w in range(WORDS))), ",").cast("array<bigint>")


def _windows(tokens: Column, size: int, known: Column | None = None) -> Column:
    """Place and hash of each window of `size` tokens; with a map, of those whose tokens may all be in it."""
    n = F.size(tokens) - size + 1
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def possible(i: Column) -> Column:
        # Most windows fail at once: both ends first, and nothing further is looked at after a token that isn't there.
        there = None
        for k in dict.fromkeys((0, size - 1, *range(size))):
            word, bit = _spot(F.get(tokens, i + k))
            one = F.getbit(F.get(known, word), bit) == 1
            there = one if there is None else there & one
        return there

    places = places if known is None else F.filter(places, possible)
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), *[F.get(tokens, i + k) for k in range(size)]).alias("key")))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """__key, item_id, __item, __ipos, __n (windows of the item) and __slots (place in the item and value) of each window.

    An item shorter than a window of which more than half is placeholders says too little to be found.
    """
    out = None
    for size in range(1, window + 1):
        own = items.filter(F.size("__t") >= window if size == window else F.size("__t") == size)
        each = own.select("item_id", "__item", "__v", "__t", F.explode(_windows(F.col("__t"), size)).alias("w"))
        cut = F.sequence(F.col("w.pos"), F.col("w.pos") + size - 1)
        slots = F.transform(F.filter(cut, lambda p: F.get(F.col("__t"), p).between(NUM, UNIT)), lambda p: F.struct(p.alias("p"), F.get(F.col("__v"), p).alias("a")))
        if size < window:
            each = each.filter(2 * F.size(F.filter("__t", lambda t: t.between(NUM, UNIT))) <= size)
        each = each.select(F.col("w.key").alias("__key"), "item_id", "__item", F.col("w.pos").alias("__ipos"), F.lit(size).alias("__size"), (F.size("__t") - size + 1).cast("long").alias("__n"), slots.alias("__slots"))
        out = each if out is None else out.unionByName(each)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, __text (hash of the text), item_id, matched_windows, item_windows of each contaminated document and item."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = _prepared(benchmark.select("item_id", F.xxhash64("text").alias("__item"), "text").dropDuplicates(), ["item_id", "__item"])
    items = scratch.save(items.filter("__t is not null and size(__t) > 0"), "items")
    side, known = scratch.save(_item_windows(items, window), "windows"), _vocabulary(items)
    facts = side.agg(F.count("*").alias("n"), F.collect_set("__size").alias("sizes")).first()
    sizes, doc = sorted(facts["sizes"]) or [window], ["doc_id", "__text"]  # at most `window` sizes
    side = side.drop("__size")

    texts = _prepared(docs.select("doc_id", F.xxhash64("text").alias("__text"), "text"), doc)
    spots = texts.select(*doc, "__v", F.explode(F.concat(*[_windows(F.col("__t"), n, known) for n in sizes])).alias("w")).select(*doc, "__v", F.col("w.pos").alias("__pos"), F.col("w.key").alias("__key"))
    shift = F.col("__pos") - F.col("__ipos")
    met = lambda v: F.transform("__slots", lambda s: F.struct(s["p"].alias("p"), s["a"].alias("a"), F.get(v, s["p"] + F.col("__shift")).alias("b")))
    hit = [*doc, "item_id", "__item", "__n", "__ipos", "__shift"]
    if facts["n"] <= BROADCAST_WINDOWS:
        found = spots.join(F.broadcast(side), "__key").withColumn("__shift", shift).select(*hit, met(F.col("__v")).alias("__slots"))
    else:
        # Ids, places and hashes meet the windows; the values of slots are fetched for the hits.
        found = spots.drop("__v").join(side, "__key").withColumn("__shift", shift).select(*hit, "__slots")
        of = texts.select(F.col("doc_id").alias("__d"), F.col("__text").alias("__dt"), "__v").dropDuplicates(["__d", "__dt"])
        found = found.join(of, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text").eqNullSafe(F.col("__dt")))).select(*hit, met(F.col("__v")).alias("__slots"))

    at = [*doc, "item_id", "__item", "__n", "__shift"]
    aligned = found.groupBy(*at).agg(F.collect_set("__ipos").alias("__spots"), F.array_distinct(F.flatten(F.collect_list("__slots"))).alias("__slots"))
    aligned = scratch.save(aligned, "aligned")
    scratch.drop("items")
    scratch.drop("windows")
    several = F.size(F.array_distinct(F.transform("__slots", lambda s: s["a"]))) < F.size(F.array_distinct(F.transform("__slots", lambda s: F.struct(s["a"], s["b"]))))
    voters = aligned.filter(several).select(*at, F.explode("__slots").alias("s")).select(*at, "s.*")
    votes = voters.groupBy(*at, "a", "b").agg(F.count("*").alias("n"), F.min("p").alias("first"), F.collect_set("p").alias("ps"))
    best = votes.groupBy(*at, "a").agg(F.max_by("b", F.struct("n", -F.col("first"))).alias("best"), F.collect_list(F.struct("b", "ps")).alias("all"))
    wrong = best.select(*at, F.flatten(F.transform(F.filter("all", lambda x: x["b"] != F.col("best")), lambda x: x["ps"])).alias("__wrong"))
    wrong = wrong.groupBy(*at).agg(F.flatten(F.collect_list("__wrong")).alias("__wrong"))

    def matched(df, spots):
        return df.select(*[c for c in at if c != "__shift"], spots.alias("__spots"))

    fits = F.filter("__spots", lambda p: ~F.exists("__wrong", lambda x: x.between(p, p + window - 1)))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in at]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    voted = aligned.filter(several).alias("x").join(wrong.alias("y"), condition).select(*[F.col(f"x.{c}").alias(c) for c in at], "__spots", "__wrong")
    counted = matched(aligned.filter(~several), F.col("__spots")).unionByName(matched(voted, fits))
    share = counted.groupBy(*doc, "item_id", "__item", "__n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("__spots")))).cast("long").alias("matched_windows"))
    return share.filter((F.col("matched_windows") > 0) & (100 * F.col("matched_windows") >= min_percent * F.col("__n"))).select(*doc, "item_id", "matched_windows", F.col("__n").alias("item_windows"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "matched_windows", "item_windows")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_TRIM = PUNCTUATION.replace("'", "''")


def _low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def contaminated_sql(docs: str) -> str:
    """CTEs ending in `leaks` (doc_id, item_id, matched_windows, item_windows) over the relation docs."""

    def side(name: str, relation: str, key: str) -> str:
        number = f"regexp_matches({{}}, '{NUMBER}')"
        return f"""
 {name}_w AS (SELECT {key}, w, list_transform(w, lambda x: trim(x, '{_TRIM}')) AS c FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)), '[^\\x20\\x09-\\x0D]+') AS w FROM {relation}) WHERE len(w) > 0),
 {name}_m AS (SELECT {key}, list_transform(c, lambda x: {_low('x')}) AS c, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {number.format('c[i]')} THEN {NUM}
   WHEN i > 1 AND {number.format('c[i - 1]')} AND lower(c[i]) IN ({_UNIT_LIST}) THEN {UNIT}
   WHEN i > 1 AND right(w[i - 1], 1) NOT IN ('.', '!', '?') AND left(c[i], 1) <> lower(left(c[i], 1)) THEN {NAME} ELSE 0 END) AS m FROM {name}_w),
 {name}_t AS (SELECT {key}, list_transform(range(1, len(c) + 1), lambda i: chr(64 + m[i]) || c[i]) AS c, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN m[i] > 0 AND (i = 1 OR m[i - 1] = 0
   OR ((i = 2 OR m[i - 2] = 0) AND (m[i - 1] = {NUM} AND m[i] = {UNIT} OR m[i - 1] = {NAME} AND m[i] = {NAME}))) THEN chr(64 + m[i]) ELSE chr(64 + m[i]) || ' ' || c[i] END) AS t FROM {name}_m)"""

    return f"""{side('ditem', 'benchmark', 'item_id')},{side('ddoc', docs, 'doc_id')},
 ditem_n AS (SELECT *, least(len(t), {WINDOW}) AS n FROM ditem_t),
 ditem_x AS (SELECT item_id, n, p, t[p:p + n - 1] AS it, c[p:p + n - 1] AS ic FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS p FROM ditem_n) WHERE n = {WINDOW} OR 2 * len(list_filter(t, lambda x: len(x) = 1)) <= n),
 ddoc_x AS (SELECT doc_id, n, p, t[p:p + n - 1] AS dt, c[p:p + n - 1] AS dc FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS p FROM ddoc_t, (SELECT DISTINCT n FROM ditem_n))),
 dhits AS (SELECT doc_id, item_id, i.n AS n, i.p AS ip, d.p - i.p AS shift, it, ic, dc FROM ddoc_x d JOIN ditem_x i ON d.n = i.n AND d.dt = i.it),
 dslots AS (SELECT DISTINCT doc_id, item_id, shift, ip + k AS p, ic[k] AS a, dc[k] AS b FROM (SELECT *, unnest(range(1, len(it) + 1)) AS k FROM dhits) WHERE len(it[k]) = 1),
 dvotes AS (SELECT *, first_value(b) OVER (PARTITION BY doc_id, item_id, shift, a ORDER BY n DESC, f) AS best FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift, a, b) AS n, min(p) OVER (PARTITION BY doc_id, item_id, shift, a, b) AS f FROM dslots)),
 dwrong AS (SELECT doc_id, item_id, shift, p FROM dvotes WHERE b <> best),
 dbad AS (SELECT DISTINCT doc_id, item_id, shift, ip FROM dhits h JOIN dwrong x USING (doc_id, item_id, shift) WHERE x.p BETWEEN ip + 1 AND ip + n),
 dgood AS (SELECT doc_id, item_id, count(DISTINCT ip) AS matched_windows FROM dhits ANTI JOIN dbad USING (doc_id, item_id, shift, ip) GROUP BY doc_id, item_id),
 leaks AS (SELECT doc_id, item_id, matched_windows, len(t) - n + 1 AS item_windows FROM dgood JOIN ditem_n USING (item_id) WHERE 100 * matched_windows >= {MIN_PERCENT} * (len(t) - n + 1))"""


OP9_SQL = f"WITH {contaminated_sql('documents')} SELECT doc_id, item_id, matched_windows, item_windows FROM leaks"
