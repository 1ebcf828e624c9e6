"""Shared pieces: shared-storage cuts, word rules, shingle hashes, splits of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two word rules of the contracts, as character classes of separators.
SPACE = r"[\x20\x09-\x0D]+"
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
NON_ALNUM_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one gets a folder of its own, since there the
    driver and the tasks share a disk; a cluster session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/tidemark-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)  # by ``cut``, inside ``settled``
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps see the very same rows and a lost executor
    costs a read, not a recomputation. The shuffle files of the write go when it ends, as nothing asks for them again; by
    themselves they would stay until the driver collects garbage, those of all steps at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, written by ``cut``. The tables that were cut on the way to it are deleted then, as nothing reads them again:
    shared storage holds those of one operator, not of all so far. ``make`` may hand no other table to the outside."""
    before = _WRITTEN.set(steps := [])
    try:
        out = make()
        _WRITTEN.reset(before)
        before = None
        return cut(out, name)
    finally:
        if before is not None:
            _WRITTEN.reset(before)
        for path in steps:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def among(rows: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """``rows`` whose ``name`` is in ``ids`` (written by ``cut``, distinct). A bitmap of the ids' hashes, 16 bits an id and 16 MB
    at most, is sent to the rows first, so that beside the wanted rows only a few others are shuffled, whatever the size."""
    wanted = max(1, ids.count())
    parts = 1 << max(0, min(12, (wanted * 16 // 32768).bit_length()))  # 4 KB each
    place = F.pmod(F.xxhash64(name), F.lit(parts * 32768))
    marks = ids.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("marks"))
    at = rows.withColumns({"_place": place}).withColumn("part", F.shiftright("_place", 15))
    byte = F.conv(F.hex(F.expr("substring(marks, cast((_place & 32767) div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    some = at.join(F.broadcast(marks), "part").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place & 7 AS int))")) != 0)
    return some.select(*rows.columns).join(ids, name, "left_semi")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_of(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(token: Column) -> Column:
    """Lower-case A-Z alone. The JVM's ``lower`` is fast and equal on pure ASCII, so only tokens with other
    characters take the character map."""
    return F.when(F.length(token) == F.octet_length(token), F.lower(token)).otherwise(F.translate(token, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in their original case; empty for NULL or no word."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{NON_ALNUM_ANY_CASE}", "")
    words = F.split(body, NON_ALNUM_ANY_CASE)
    # Only the last piece can be empty (a trailing separator, or no word at all).
    return F.when(F.element_at(words, -1) == "", F.slice(words, 1, F.size(words) - 1)).otherwise(words)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word (bytes) -> 64-bit id; forgets everything once it holds ``limit`` words, which only costs time."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def space_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text (bytes methods treat ASCII only, as the rule does)."""
    return text.lower().split() if text else []


def shingles(ids: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words in text order; fewer words make one run; none make none."""
    n = len(ids)
    if n == 0:
        return ids
    step = np.uint64(0x9E3779B97F4A7C15)
    w = min(width, n)
    out = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        out = out * step + ids[i : n - w + 1 + i]
    return mix64(out)


def hint_within(df: DataFrame, megabytes: int = 64) -> DataFrame:
    """``df`` (already written by ``cut``) with a broadcast hint if its texts and rows take at most ``megabytes``;
    otherwise as it is, and the join shuffles."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if kind == "string" else F.lit(8))
    total = df.agg(F.sum((size + 16).cast("double"))).first()[0] or 0
    return F.broadcast(df) if total <= megabytes * 1e6 else df
