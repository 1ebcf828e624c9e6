"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``symbols`` symbols. Two words that differ by one inserted, deleted or replaced code point have
reduced words that are equal or differ by one such edit, so:

1. the distinct reduced words generate their one-edit neighbourhoods (each unordered pair once: a deletion from the
   longer one stands for the insertion, a replacement is generated from the side with the smaller symbol);
2. the neighbourhoods are joined to the reduced vocabulary, which leaves pairs of reduced words that both occur;
3. the words behind each such pair, and behind one and the same reduced word, are verified on their strings.

Nothing but the vocabulary is compared, so repeated words, however frequent, cost one row each; counts are combined before
they are shuffled. The number of symbols grows with the vocabulary's seventh root, which keeps the words behind a
reduced word few; it changes no result. Candidates are tested inside the join and never written.

A word's *form* is its near word with the largest count (ties: the smallest in code-point order), if that is ``TIMES``
times its own or more. Counts grow along forms, so chains end; the *root* is the last word of the chain, found by
pointer jumping in at most log2(log5(largest count)) + 1 rounds, each written to the shared folder.

Defined results: NULL and empty texts have no words; a NULL doc_id counts as the empty text in the draw of deletions;
repeated rows count again; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

# What the words are made of.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
LENGTH, SEEN, TIMES = 6, 5, 5
SYMBOLS = "".join(map(chr, range(0x4E00, 0x4E00 + 64)))  # none of them a letter
MULTIPLIER = 2654435761


def drawn_words(docs: DataFrame, modulus: int = 199) -> DataFrame:
    """(word): every occurrence of the texts' letter runs, lower-cased in A-Z; of runs whose crc32 with the document is
    divisible by ``modulus`` one code point is missing. Short ones are left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(F.coalesce("text", F.lit("")), NOT_LETTERS)).alias("run"))
    runs = runs.where(F.length("run") >= LENGTH).select("d", lower_ascii(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    word = F.when(F.col("h") % modulus == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LENGTH)


def vocabulary(words: DataFrame, seen: int = SEEN) -> DataFrame:
    """(word, n) of the words that occur ``seen`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def near_words(words: DataFrame, *, symbols: int | None = None) -> DataFrame:
    """(a, b, na, nb): all pairs of different words of ``words`` (word, n; written) one edit apart, each once."""
    if symbols is None:
        symbols = max(4, math.ceil(words.count() ** (1 / 7)))
    symbols = min(symbols, len(SYMBOLS))
    hashed = "".join(SYMBOLS[(ord(c) * MULTIPLIER >> 7) % symbols] for c in LETTERS)
    reduced = words.select("word", "n", F.translate("word", LETTERS, hashed).alias("r"))
    named = reduced.select("word", "n", "r", F.xxhash64("r").alias("k"))
    distinct = cut(named.select("k", "r").distinct(), "reduced-words")
    marks = ", ".join(f"'{s}'" for s in SYMBOLS[:symbols])
    split = "left(r, i - 1)", "substr(r, i, 1)", "substr(r, i + 1)"
    fewer = f"array_distinct(transform(sequence(1, length(r)), i -> xxhash64(concat({split[0]}, {split[2]}))))"
    other = f"flatten(transform(sequence(1, length(r)), i -> transform(filter(array({marks}), s -> s > {split[1]}), s -> xxhash64(concat({split[0]}, s, {split[2]})))))"
    around = distinct.select(F.col("k").alias("ka"), F.explode(F.expr(f"concat({fewer}, {other})")).alias("kb"))
    pairs = around.join(distinct.select(F.col("k").alias("kb")), "kb").select("ka", "kb")
    pairs = pairs.unionByName(distinct.select(F.col("k").alias("ka"), F.col("k").alias("kb")))
    left = named.select(F.col("k").alias("ka"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = named.select(F.col("k").alias("kr"), F.col("word").alias("b"), F.col("n").alias("nb"))
    sides = pairs.join(left, "ka")
    one = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    # Behind one and the same reduced word each pair is met from both sides.
    once = (F.col("ka") != F.col("kb")) | (F.col("a") < F.col("b"))
    return sides.join(right, (F.col("kb") == F.col("kr")) & once & one).select("a", "b", "na", "nb")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = cut(vocabulary(drawn_words(docs)), "vocabulary")
    return forms(words, cut(near_words(words), "near-words"))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n by their near ``pairs`` (a, b, na, nb); both written."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("x")
    best = pairs.select(ends).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("m", -F.col("best.m"))
    has = F.col("m") >= TIMES * F.col("n")
    out = cut(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "forms")
    step = cut(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(step.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return out.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
