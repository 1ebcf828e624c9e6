"""Benchmark decontamination over a positional inverted index of the training tokens. DataFrame functions only.

Test phrases are the windows of ``width`` consecutive words of each benchmark item (an item of fewer words is one
window). The index holds a posting (term, document, position) for every occurrence of the terms that are among the
``lists`` rarest of some window, counted over the whole training table. A window's candidate starts are the postings of
its rarest term, shifted by the term's offset, intersected with the shifted lists of its next terms; the words at each
remaining start are then compared with the phrase.

Defined results: NULL and empty texts have no words and no hits; an item without words has no window, and a NULL item_id
counts as the text "". Repeated rows of a document are each returned, repeated items count once. Rows are told apart by
doc_id and text together, so a NULL or repeated doc_id does no harm. Other columns are ignored, empty tables give empty
or clean results. No hit gives the SHA-256 of the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, alnum_words, cut, hint_within, lower_ascii, settled


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k): k names a row by its id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.xxhash64("doc_id", "text"))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """(win, item_id, words): every distinct window of every item; win is its text."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), alnum_words(_lowered(F.col("text"))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    some = words.where("size(w) > 0").select("item_id", "w", F.explode(starts).alias("i"))
    return some.select("item_id", F.expr(f"slice(w, i, {width})").alias("words")).withColumn("win", F.array_join("words", " ")).select("win", "item_id", "words").distinct()


def tokens(rows: DataFrame) -> DataFrame:
    """(k, pos, term): every word occurrence, positions from 0."""
    cased = rows.select("k", F.posexplode(alnum_words(F.col("text"))).alias("pos", "cased"))
    return cased.select("k", "pos", lower_ascii(F.col("cased")).alias("term"))


class Index:
    """Positional postings of the terms that the phrases need; ``postings`` (term, k, pos) is a table in the shared folder."""

    def __init__(self, docs: DataFrame, phrases: DataFrame, lists: int = 3):
        """``phrases`` has (win, words), distinct."""
        rows = _rows(docs)
        entries = cut(phrases.select("win", F.posexplode("words").alias("off", "term")), "phrase-terms")
        vocabulary = hint_within(cut(entries.select("term").distinct(), "vocabulary"))
        counts = tokens(rows).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
        # A window with a term that the training table lacks cannot occur, and drops out of the inner join.
        ranked = entries.join(counts, "term").groupBy("win").agg(F.count("*").alias("known"), F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by_count"))
        sizes = entries.groupBy("win").agg(F.count("*").alias("size"))
        ranked = ranked.join(sizes, "win").where("known = size").select("win", "size", F.slice("by_count", 1, lists).alias("rare"))
        self.anchors = cut(ranked, "anchors")
        self.lists = lists
        wanted = hint_within(cut(self.anchors.select(F.explode("rare.term").alias("term")).distinct(), "index-terms"))
        self.postings = cut(tokens(rows).join(wanted, "term").select("term", "k", "pos"), "postings")

    def starts(self) -> DataFrame:
        """(win, k, start): positions at which the shifted lists of a window's rarest terms meet."""
        # Few rows and narrow: the windows' first terms. A frequent one joins on its own postings alone.
        first = self.anchors.select("win", "rare", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["off"].alias("off"))
        met = self.postings.join(first, "term").select("win", "rare", "k", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
        for i in range(1, self.lists):
            nth = F.coalesce(F.try_element_at("rare", F.lit(i + 1)), F.col("rare")[0])
            asked = met.withColumn("term", nth["term"]).withColumn("pos", F.col("start") + nth["off"])
            met = asked.join(self.postings, ["term", "k", "pos"], "left_semi").select("win", "rare", "k", "start")
        return met.select("win", "k", "start")

    def near(self, slop: int = 5) -> DataFrame:
        """(win, k): documents in which the two rarest terms of a window stand within ``slop`` words of the places
        they would have in an exact match. Starts are put in cells of ``slop`` words, so a cell pair holds at most
        slop x slop starts, however often the terms repeat."""
        lists = []
        for i in (0, 1):
            nth = F.coalesce(F.try_element_at("rare", F.lit(i + 1)), F.col("rare")[0])
            at = self.postings.join(self.anchors.select("win", nth["term"].alias("term"), nth["off"].alias("off")), "term")
            lists.append(at.select("win", "k", (F.col("pos") - F.col("off")).alias(f"s{i}")))
        cells = lists[0].withColumn("cell", F.explode(F.array([F.floor(F.col("s0") / slop) + d for d in (-1, 0, 1)])))
        other = lists[1].withColumn("cell", F.floor(F.col("s1") / slop))
        return cells.join(other, ["win", "k", "cell"]).where(f"abs(s0 - s1) <= {slop}").select("win", "k").distinct()


def phrase_hits(docs: DataFrame, items: DataFrame, *, width: int = 10, lists: int = 3) -> DataFrame:
    """(k, hit_words, wins): for rows with an exact phrase, the distinct word positions inside any occurrence and the
    windows that occur."""
    return settled(docs.sparkSession, lambda: _hits(docs, items, width, lists), "hits")


def _hits(docs: DataFrame, items: DataFrame, width: int, lists: int) -> DataFrame:
    phrases = cut(windows(items, width).select("win", "words").distinct(), "phrases")
    found = Index(docs, phrases, lists).starts().distinct()
    per_row = found.groupBy("k").agg(F.collect_list(F.struct("win", "start")).alias("cands"))
    words = F.transform(alnum_words(F.col("text")), lower_ascii)
    # The generator keeps the words a column: written into the filter, they would be cut anew for each candidate.
    checked = _rows(docs).join(per_row, "k").select("k", "cands", F.explode(F.array(words)).alias("w"))
    same = F.expr(r"filter(cands, c -> array_join(slice(w, c.start + 1, size(split(c.win, ' '))), ' ') = c.win)")
    checked = checked.select("k", same.alias("ok")).where("size(ok) > 0")
    spans = F.expr("array_distinct(flatten(transform(ok, c -> sequence(c.start, c.start + size(split(c.win, ' ')) - 1))))")
    return checked.select("k", spans.alias("hit_words"), F.array_distinct("ok.win").alias("wins")).dropDuplicates(["k"])


def contamination(docs: DataFrame, items: DataFrame, *, width: int = 10, lists: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    hits = phrase_hits(docs, items, width=width, lists=lists)
    named = hits.select("k", F.explode("wins").alias("win")).join(windows(items, width).select("win", "item_id"), "win")
    names = named.groupBy("k").agg(F.sort_array(F.collect_set("item_id")).alias("names"))
    marks = hits.select("k", F.size("hit_words").cast("long").alias("n_hit")).join(names, "k")
    # Cutting takes a fraction of the time of counting the words' matches.
    n_words = F.size(alnum_words(F.col("text")))
    base = _rows(docs).select("doc_id", "k", n_words.cast("long").alias("n_words"))
    out = base.join(marks, "k", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    n_items = F.when(F.col("names").isNull(), 0).otherwise(F.size("names"))
    sha = F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, width: int = 10) -> DataFrame:
    """Rows of ``docs`` without an exact benchmark phrase, all columns."""
    hits = phrase_hits(docs, items, width=width).select("k")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    # The columns travel as one, so that none can clash.
    return docs.select(F.struct("*").alias("row"), key.alias("k")).join(hits, "k", "left_anti").select("row.*")
