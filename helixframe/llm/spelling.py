"""Spelling variants: words of a corpus one edit apart, and the form that each of them goes back to.

Words are counted over all texts (in each task first), and those frequent enough meet by an even-partition pigeonhole join.
A word of L code points is indexed by its two even segments; one edit leaves one of them whole, so a word of equal or one more
length that is one edit away holds that segment at its place: the first where it starts, the second shifted by the difference in length. The key is the segment with
its length and place, and pairs that share a key are verified.

Short segments are shared by many words. Where a key has more than GROUP_PAIRS pairs, the half that holds the edit is cut in two
again: the key becomes all but a quarter of the word, then all but an eighth, down to one place. There all pairs of equal length are true
ones, and a longer word without its letter is the shorter word, so what is compared stays in proportion to the words and the links found, no
pair is left out and no group is held in one task.

Cases: null and empty texts have no words; repeated rows count each; words with null ids count like others; words of any length take part;
ties between near words of equal counts go to the smallest in code-point order; other columns are ignored and can't clash; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import halves
from .common import LOWER, UPPER, Scratch, documents

MIN_LENGTH, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as the word it is the form of.
RATIO = 2
GROUP_PAIRS = 1_000
LETTERS = "A-Za-zÀ-ÿ"
#: Counts that a task holds before it hands them on.
HELD_WORDS = 200_000
PART_BYTES = 4 << 20
_LOWER = str.maketrans(UPPER, LOWER)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, alter: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): maximal runs of LETTERS, A-Z lower-cased, of at least min_length code points and min_count occurrences.

    alter, if given, gets the document's id and a word of min_length code points at least and returns what is counted in its place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run that is too short fails where it starts and at each later place of it.
        find, held = re.compile(f"[{LETTERS}]{{{min_length},}}").findall, Counter()
        for whole in batches:
            for batch in halves(whole, 1, PART_BYTES):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own: Counter = Counter()
                    for w, n in Counter(find(text or "")).items():
                        own[w.lower() if w.isascii() else w.translate(_LOWER)] += n
                    for w, n in own.items():
                        held[alter(doc, w) if alter else w] += n
                    if len(held) >= HELD_WORDS:
                        yield _table(held)
                        held.clear()
        yield _table(held)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    total = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _table(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _key() -> Column:
    """The word without the places [a, b) that may hold the edit (one more in the longer word), with where they are."""
    after = F.col("b") + F.col("longer").cast("int")
    left, right = F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(after + 1, F.length("word"))
    return F.xxhash64("kind", "size", "a", "b", left, right)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with the halves of [a, b). A single place becomes the two borders, for a letter more."""
    a, b = F.col("a"), F.col("b")
    middle = F.expr("(a + b) div 2").cast("int")
    halves_of = F.when(b - a > 1, F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b"))))
    borders = F.array(F.struct(a.alias("a"), a.alias("b")), F.struct(b.alias("a"), b.alias("b")))
    return rows.withColumn("__of", F.explode(halves_of.otherwise(borders))).withColumns({"a": F.col("__of.a"), "b": F.col("__of.b")}).drop("__of")


def near_pairs(words: DataFrame, scratch: Scratch, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of distinct words one edit apart, once. words: a saved table (word, n)."""
    size = F.length("word")
    whole = words.select("word", "n", F.lit(0).alias("a"))
    same = whole.select("*", size.alias("size"), F.lit("same").alias("kind"), F.lit(False).alias("longer"))
    index = same.withColumn("kind", F.lit("more"))
    probe = whole.select("*", (size - 1).alias("size"), F.lit("more").alias("kind"), F.lit(True).alias("longer"))
    rows = same.unionByName(index).unionByName(probe).withColumn("b", F.col("size"))
    found, step = None, 0
    while True:
        keyed = scratch.save(_halved(rows).withColumn("key", _key()), f"keys-{step}")
        shorter, longer = F.sum((~F.col("longer")).cast("long")), F.sum(F.col("longer").cast("long"))
        pairs = F.when(F.first("kind") == "same", shorter * (shorter - 1) / 2).otherwise(shorter * longer)
        # Words of equal length that differ in one place at most are pairs all; where only a border is left, all pairs are true ones too.
        last = F.first(F.col("b") - F.col("a")) <= F.when(F.first("kind") == "same", 1).otherwise(0)
        sizes = keyed.groupBy("key").agg(pairs.alias("pairs"), last.alias("last")).filter("pairs > 0")
        sizes = sizes.select("key", ((F.col("pairs") > group_pairs) & ~F.col("last")).alias("hot"))
        live = scratch.save(keyed.join(sizes, "key"), f"live-{step}")
        scratch.drop(f"keys-{step}")
        cold = live.filter("not hot")
        one = cold.filter("not longer").select("key", "kind", "word", "n")
        two = cold.filter("longer or kind = 'same'").select("key", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
        met = one.join(two, "key").filter((F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
        met = scratch.save(met.select("word", "n", "other", "other_n"), f"pairs-{step}")
        found = met if found is None else found.unionByName(met)
        rows = live.filter("hot").drop("key", "hot")
        if rows.isEmpty():
            return found.dropDuplicates(["word", "other"])
        step += 1


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from a saved table (word, form) without cycles, by pointer jumping: a chain's length halves each round."""
    now, step = forms.select("word", F.col("form").alias("root")), 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved"))
        moved = scratch.save(moved, f"roots-{step}")
        if step > 1:
            scratch.drop(f"roots-{step - 2}")
        now, step = moved.select("word", "root"), step + 1
        if moved.filter("__moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: float = RATIO, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    pairs = near_pairs(words, scratch, group_pairs)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("__best"))
    is_form = -F.col("__best.less") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(is_form, F.col("__best.other")).alias("form"), F.when(is_form, -F.col("__best.less")).alias("form_n"))
    near = scratch.save(near, "near")
    roots = roots_of(near.filter("form is not null").select("word", "form"), scratch)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def planted(doc_id: int | None, word: str) -> str:
    """The word without one code point where the crc32 of document and word says so, as the query's contract asks (null ids: never)."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 97 or doc_id is None:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir), alter=planted)).select("word", "form", "root", "n", "n_near", "form_n")
