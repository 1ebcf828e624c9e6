"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hint_within

PARTS = 1_000_000


def sample_per_class(rows: DataFrame, label: str, cap: int, seed: int = 17) -> tuple[DataFrame, dict]:
    """About ``cap`` rows of each value of ``label`` (all, where there are fewer), chosen by a hash of doc_id, and the
    number of rows that each value has in ``rows``. The driver receives one count per label value."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(PARTS))
    share = F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, int(min(1.0, cap / n) * PARTS))]) if counts else F.create_map(F.lit(""), F.lit(0))
    return (rows.where(draw < share[F.col(label)]) if counts else rows.limit(0)), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, cap: int) -> tuple[DataFrame, dict]:
    """(text, y) of a bounded sample of the documents with a label that ``learn`` (on doc_id) admits, and the label
    counts. The sampled ids are few, so the documents are filtered where they are read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learn)
    picked, counts = sample_per_class(known.dropDuplicates(["doc_id"]), "y", cap)
    ids = hint_within(cut(picked, "sample"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, "doc_id").select("text", "y"), counts
