"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct 5-word shingles. Register i keeps floor(1 - log_b x), clipped to [0, q + 1], where x
is the least of the exponential variables (rate ``rate``) that hash i gives the set's shingles: an exponentially spaced,
truncated minimum. The registers of a union are the element-wise maxima, so sketches merge; equal registers are the more
likely the more two sets share, so bands of registers bring similar sets together. Pairs from the bands pass a joint
likelihood test on all registers and are confirmed on the full sets.

Defined results: NULL and empty text and text without words have the empty set (0 shingles), are linked with nothing and
kept. Equal sets are collapsed before anything is compared and expanded again at the end; repeated rows of a doc_id are
each returned, and different texts of one doc_id take part by themselves. A row with a NULL doc_id takes part by its text and
is the last choice of its component, whose id is NULL if it has no other; it is kept then. Any 64-bit doc_id will do. A row is
known inside by (no doc_id, doc_id, hash of the text). Other columns are passed on in one column, so no name can clash. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, among, cut, hint_within, mix64, settled, shingles, space_words
from .graph import bucket_mates, linked_groups

BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 24, 6  # misses a pair of similarity 0.85 with probability (1 - 0.85^6)^24, about 1e-5
REGISTERS = BANDS * ROWS
ID = "missing int, doc long, h long"
SKETCH = f"{ID}, n_shingles long, key1 long, key2 long, bands array<long>, registers binary"

_GRID = np.linspace(0.0, 1.0, 201)[:-1]


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def registers(elements: np.ndarray, n: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes. -log(1 - u) turns a uniform hash into an
    exponential one and is increasing, so the minimum can be taken on the integers."""
    a = _multipliers(n)
    low = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(elements), 512):
        low = np.minimum(low, (elements[i : i + 512, None] * a[None, :]).min(axis=0))
    # A multiplicative hash is linear in the element; the second scrambling happened when the element was made.
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + r[:, j])
    return key


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids = WordIds()
    for batch in batches:
        out = []
        for *doc, text in zip(batch["missing"], batch["doc"], batch["h"], batch["text"]):
            full = np.unique(shingles(ids.of(space_words(text))))
            if len(full) == 0:
                out.append((*doc, 0, 0, 0, [], b""))
                continue
            regs = registers(full)
            keys = np.array([full.sum(dtype=np.uint64), mix64(full).sum(dtype=np.uint64)]).view(np.int64)
            out.append((*doc, len(full), keys[0], keys[1], band_keys(regs).view(np.int64), regs.tobytes()))
        yield pd.DataFrame(out, columns=["missing", "doc", "h", "n_shingles", "key1", "key2", "bands", "registers"])


def _id() -> Column:
    """(missing, doc, h): rows without a doc_id come last; the hash tells the texts of one doc_id apart."""
    doc = F.col("doc_id").cast("long")
    return F.struct(doc.isNull().cast("int").alias("missing"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64("text").alias("h"))


def _rows(docs: DataFrame) -> DataFrame:
    """(id, text as bytes)."""
    return docs.select(_id().alias("id"), F.col("text").cast("binary").alias("text"))


def _named(flat: DataFrame) -> DataFrame:
    """The three parts of an id as the column id again; Python gets them as plain columns."""
    return flat.select(F.struct("missing", "doc", "h").alias("id"), *[c for c in flat.columns if c not in ("missing", "doc", "h")])


def sketches(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, key1, key2, bands, registers): one row per document; key1 and key2 name its set."""
    return _named(_rows(docs).select("id.*", "text").mapInPandas(_sketch, SKETCH))


def likelihood(na: np.ndarray, nb: np.ndarray, less: np.ndarray, more: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Log-likelihood (rows x grid of similarities) of the register comparisons, given both set sizes: a register is
    larger in A with probability p(u - v J), with u and v the sets' shares and p(x) = -log_b(1 - x (b - 1) / b)."""
    u = (na / (na + nb))[:, None]
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * _GRID), p(v - u * _GRID)
    tiny = 1e-12
    ll = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.clip(1 - up - down, tiny, 1))
    return np.where(_GRID[None, :] <= np.minimum(u / v, v / u) + 1e-9, ll, -np.inf)


def _plausible(threshold: float, slack: float):
    @F.pandas_udf("boolean")
    def plausible(na: pd.Series, ra: pd.Series, nb: pd.Series, rb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(ra), np.uint16).reshape(len(ra), -1).astype(np.int32)
        b = np.frombuffer(b"".join(rb), np.uint16).reshape(len(rb), -1).astype(np.int32)
        ll = likelihood(na.to_numpy(float), nb.to_numpy(float), (a < b).sum(1), (a > b).sum(1), (a == b).sum(1))
        high = ll[:, _GRID >= threshold - 0.005].max(axis=1)
        return pd.Series(high >= ll.max(axis=1) - slack)

    return plausible


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids = WordIds()
    for batch in batches:
        full = [np.unique(shingles(ids.of(space_words(t)))).view(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"missing": batch["missing"], "doc": batch["doc"], "h": batch["h"], "members": full})


def prefix_pairs(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of ``ids`` (id, comp) in different groups that can reach the similarity, and few others.

    For crowds of documents that are alike but mostly not alike enough, where bands would bring nearly all pairs: two
    sets that share enough must share one of their rarest members (rarest within the crowd), at places that leave room for
    the rest of what they need to share. Sets with many members of their own meet nobody.
    """
    each = sets.join(ids, "id").select("id", "comp", F.size("members").alias("n"), F.explode("members").alias("s"))
    each = cut(each, "crowd-members")
    spread = each.groupBy("s").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    front = each.join(spread, "s").withColumn("i", place).where(f"df > 1 and i <= n - floor(({percent} * n + 99) / 100) + 1")
    front = cut(front.select("id", "comp", "n", "s", "i"), "crowd-prefixes")
    other = front.select(F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("nb"), "s", F.col("i").alias("j"))
    reach = f"{100 + percent} * (1 + least(n - i, nb - j)) >= {percent} * (n + nb)"
    return front.join(other, "s").where(f"id < b and comp <> comp_b and {reach}").select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    doc_id, comp = (F.when(F.col(f"{c}.missing") == 0, F.col(f"{c}.doc")) for c in ("id", "comp"))
    kept = F.coalesce(doc_id == comp, F.col("id") == F.col("comp"))
    return groups_of(docs, percent=percent).select(doc_id.alias("doc_id"), "n_shingles", comp.alias("component_id"), kept.alias("kept"))


def groups_of(docs: DataFrame, *, percent: int, slack: float = 14.0) -> DataFrame:
    """(id, n_shingles, comp): every row with the smallest id of its group, ids as in ``_rows``.

    Links join sets with 100 * |A and B| >= ``percent`` * |A or B|. ``slack``: a candidate goes on to the full sets
    unless its best similarity is that many log-likelihood units better than any at the threshold (about 1e-7).
    """
    return settled(docs.sparkSession, lambda: _groups(docs, percent, slack), "set-groups")


def _groups(docs: DataFrame, percent: int, slack: float) -> DataFrame:
    sk = cut(sketches(docs), "sketch")
    full = sk.where("n_shingles > 0")
    names = ["key1", "key2", "n_shingles"]
    # One document stands for each distinct set; equal sets have equal sketches.
    heads = cut(full.groupBy(*names).agg(F.min("id").alias("id"), F.first(F.struct("bands", "registers")).alias("x")).select(*names, "id", "x.*"), "heads")
    reps = heads.select(*names, F.col("id").alias("rep"))
    mates = cut(bucket_mates(heads.select(F.explode("bands").alias("bucket"), "id")), "mates")
    active = cut(mates.select("id").distinct(), "active")
    # Rows of an id have one text.
    texts = among(_rows(docs), active).dropDuplicates(["id"])
    sets = cut(_named(texts.select("id.*", "text").mapInPandas(_sets, f"{ID}, members array<long>")), "sets")
    info = cut(among(heads.select("id", "n_shingles", "registers"), active), "active-heads")

    def verify(pairs: DataFrame) -> DataFrame:
        a = info.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
        b = info.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
        # The smaller set must hold the threshold's share of the larger one.
        likely = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        likely = likely.where(_plausible(percent / 100, slack)("na", "ra", "nb", "rb")).select("a", "b", "na", "nb")
        left = sets.select(F.col("id").alias("a"), F.col("members").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("members").alias("sb"))
        both = likely.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return both.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")

    groups = linked_groups(mates, verify, lambda ids: prefix_pairs(sets, ids, percent)).select(F.col("id").alias("rep"), "comp")
    named = reps.join(groups, "rep", "left").select(*names, F.coalesce("comp", "rep").alias("comp"))
    linked = full.select("id", *names).join(named, names).select("id", "n_shingles", "comp")
    alone = sk.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("comp"))
    return linked.unionByName(alone)


def one_per_group(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` whose document stays: one per group; repeated rows of the kept document stay once."""
    each = groups_of(docs.select("doc_id", "text"), percent=percent)
    # Rows that go or are repeated are told by their ids; all others pass without a shuffle as long as those few can be sent to them.
    per_id = each.groupBy("id").agg(F.count("*").alias("n"), F.first(F.col("id") == F.col("comp")).alias("stays"))
    some = hint_within(cut(per_id.where("n > 1 or not stays").select("id", "stays"), "gone-or-repeated"), 48)
    rows = docs.select(F.struct("*").alias("row"), _id().alias("id")).join(some, "id", "left")
    once = rows.where("stays is null").select("row.*")
    return once.union(rows.where("stays").dropDuplicates(["id"]).select("row.*"))
