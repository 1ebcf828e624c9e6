"""License scans: ordered signature rules on a text's words. DataFrame functions only.

A rule is a keyword, a regular expression over lower-cased words (one space between them), a label and a priority. A text
first has to hold the keyword of some rule; its words are then cut into blocks of ``BLOCK`` words with ``MARGIN`` words of the
neighbours on either side (no rule is longer than that), and a block meets only the rules whose keyword it holds. A
detection is suppressed if another one contains its interval and has a higher priority, or the same priority and a
greater length, or the same interval and an earlier rule. Detections of the three base phrases always stay.

Defined results: NULL and empty texts have no words and no detection (NULL first_word and last_word, empty labels, score
0). Repeated rows and NULL doc_ids are scanned like any other, other columns are ignored, an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_ALNUM, NON_ALNUM_ANY_CASE, UPPER

BLOCK, MARGIN = 1024, 64

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# License names. label: (keyword, name as words, SPDX words or ""). Every match holds the keyword.
NAMES = {
    "mit": ("mit", "mit", "mit"),
    "mit-0": ("mit", "mit no attribution", "mit 0"),
    "apache-1.1": ("apache", "apache( software)? license (version )?1 1", "apache 1 1"),
    "apache-2.0": ("apache", "apache( software)? license (version )?2 0", "apache 2 0"),
    "apache": ("apache", "apache( software)?", ""),
    "gpl-1.0": ("gnu", "gnu general public license (version |v)?1( 0)?", "gpl 1 0( only| or later)?"),
    "gpl-2.0": ("gnu", "gnu general public license (version |v)?2( 0)?", "gpl 2 0( only| or later)?"),
    "gpl-3.0": ("gnu", "gnu general public license (version |v)?3( 0)?", "gpl 3 0( only| or later)?"),
    "gpl": ("gnu", "gnu general public", ""),
    "gpl-short-2": ("gplv2", "gplv2", ""),
    "gpl-short-3": ("gplv3", "gplv3", ""),
    "lgpl-2.1": ("lesser", "(gnu )?lesser general public license (version |v)?2 1", "lgpl 2 1( only| or later)?"),
    "lgpl-3.0": ("lesser", "(gnu )?lesser general public license (version |v)?3( 0)?", "lgpl 3 0( only| or later)?"),
    "lgpl": ("lesser", "(gnu )?lesser general public", ""),
    "lgpl-2.0": ("library", "(gnu )?library general public license", "lgpl 2 0( only| or later)?"),
    "agpl-3.0": ("affero", "(gnu )?affero general public license( (version |v)?3( 0)?)?", "agpl 3 0( only| or later)?"),
    "gfdl-1.3": ("documentation", "(gnu )?free documentation license( (version |v)?1 [123])?", "gfdl 1 [123]( only| or later)?"),
    "bsd-2-clause": ("bsd", "(simplified bsd|bsd 2 clause|freebsd)", "bsd 2 clause"),
    "bsd-3-clause": ("bsd", "(new bsd|modified bsd|revised bsd|bsd 3 clause)", "bsd 3 clause"),
    "bsd-4-clause": ("bsd", "(original bsd|bsd 4 clause)", "bsd 4 clause"),
    "0bsd": ("bsd", "zero clause bsd", "0bsd"),
    "bsd": ("bsd", "bsd( style)?", ""),
    "mpl-1.1": ("mozilla", "mozilla public license (version |v)?1 1", "mpl 1 1"),
    "mpl-2.0": ("mozilla", "mozilla public license (version |v)?2 0", "mpl 2 0"),
    "mpl": ("mozilla", "mozilla public", ""),
    "epl-1.0": ("eclipse", "eclipse public license (version |v)?1 0", "epl 1 0"),
    "epl-2.0": ("eclipse", "eclipse public license (version |v)?2 0", "epl 2 0"),
    "edl-1.0": ("eclipse", "eclipse distribution license( (version |v)?1 0)?", ""),
    "cddl-1.0": ("distribution", "common development and distribution license( (version |v)?1 0)?", "cddl 1 [01]"),
    "cpl-1.0": ("common", "common public license( (version |v)?1 0)?", "cpl 1 0"),
    "ipl-1.0": ("ibm", "ibm public license( (version |v)?1 0)?", "ipl 1 0"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("zlib", "zlib( libpng)?", "zlib"),
    "bsl-1.0": ("boost", "boost software license( (version |v)?1 0)?", "bsl 1 0"),
    "busl-1.1": ("business", "business source license( (version |v)?1 1)?", "busl 1 1"),
    "sspl-1.0": ("server", "server side public license( (version |v)?1)?", "sspl 1 0"),
    "elastic-2.0": ("elastic", "elastic license( 2 0)?", "elastic 2 0"),
    "unlicense": ("unlicense", "unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl"),
    "artistic-1.0": ("artistic", "artistic license (version )?1 0", "artistic 1 0( perl| cl8)?"),
    "artistic-2.0": ("artistic", "artistic license (version )?2 0", "artistic 2 0"),
    "artistic": ("artistic", "artistic", ""),
    "psf-2.0": ("python", "python software foundation", "(psf|python) 2 0"),
    "psf-2.0-long": ("psf", "psf", ""),
    "php-3.01": ("php", "php license( (version |v)?3 0?1?)?", "php 3 0?1"),
    "ruby": ("ruby", "ruby", "ruby"),
    "ofl-1.1": ("font", "(sil )?open font license( (version |v)?1 [01])?", "ofl 1 [01]"),
    "ms-pl": ("microsoft", "microsoft public", "ms pl"),
    "ms-rl": ("microsoft", "microsoft reciprocal", "ms rl"),
    "eupl-1.2": ("european", "european union public licen[cs]e( (version |v)?1 [012])?", "eupl 1 [012]"),
    "cecill-2.1": ("cecill", "cecill( (version |v)?2 [01])?", "cecill 2 [01]"),
    "osl-3.0": ("open", "open software license( (version |v)?3 0)?", "osl [123] 0"),
    "afl-3.0": ("academic", "academic free license( (version |v)?3 0)?", "afl 3 0"),
    "ncsa": ("illinois", "university of illinois( open source)?", "ncsa"),
    "ncsa-long": ("ncsa", "ncsa( open source)?", ""),
    "w3c": ("w3c", "w3c( software)?( notice and)?", "w3c"),
    "x11": ("x11", "x11", "x11"),
    "upl-1.0": ("universal", "universal permissive license( (version |v)?1 0)?", "upl 1 0"),
    "odbl-1.0": ("database", "open database license( (version |v)?1 0)?", "odbl 1 0"),
    "odc-by-1.0": ("commons", "open data commons attribution license( (version |v)?1 0)?", "odc by 1 0"),
    "pddl-1.0": ("commons", "open data commons public domain dedication", "pddl 1 0"),
    "cc0-1.0": ("cc0", "cc0( 1 0)?", "cc0 1 0"),
    "cc-by": ("cc", "cc by( [1234] [05])?", "cc by [1234] [05]"),
    "cc-by-sa": ("cc", "cc by sa( [1234] [05])?", "cc by sa [1234] [05]"),
    "cc-by-nc": ("cc", "cc by nc( [1234] [05])?", "cc by nc [1234] [05]"),
    "cc-by-nd": ("cc", "cc by nd( [1234] [05])?", "cc by nd [1234] [05]"),
    "cc-by-nc-sa": ("cc", "cc by nc sa( [1234] [05])?", "cc by nc sa [1234] [05]"),
    "cc-by-nc-nd": ("cc", "cc by nc nd( [1234] [05])?", "cc by nc nd [1234] [05]"),
    "cc-by-long": ("creative", "creative commons attribution( [1234] [05])?", ""),
    "cc-by-sa-long": ("creative", "creative commons attribution share ?alike( [1234] [05])?", ""),
    "cc-by-nc-long": ("creative", "creative commons attribution non ?commercial( [1234] [05])?", ""),
    "cc-by-nd-long": ("creative", "creative commons attribution no ?deriv(ative)?s?( [1234] [05])?", ""),
    "cc-by-nc-sa-long": ("creative", "creative commons attribution non ?commercial share ?alike( [1234] [05])?", ""),
    "cc": ("creative", "creative commons", ""),
    "openrail": ("rail", "(creativeml )?open ?rail( [ms])?", ""),
    "llama": ("llama", "llama [23]( [0123])? community", ""),
}

# Sentences of license texts. (keyword, words, label)
SENTENCES = (
    ("hereby", "permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("endorse", "neither the name of .{1,60} nor the names of its contributors may be used to endorse or promote", "bsd-3-clause"),
    ("acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4-clause"),
    ("redistribute", "this program is free software you can redistribute it and or modify it", "gpl"),
    ("redistribute", "this library is free software you can redistribute it and or modify it", "lgpl"),
    ("mozilla", "this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("misrepresented", "the origin of this software must not be misrepresented", "zlib"),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated", "dedicated (this work )?to the public domain", "public-domain"),
    ("domain", "(this (work|file|software) is )?(released )?in(to)? the public domain", "public-domain"),
    ("reserved", "all rights reserved", "all-rights-reserved"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("unauthorized", "unauthorized (copying|reproduction|use) of this (file|work|material)", "proprietary"),
    ("noncommercial", "for non ?commercial (use|purposes) only", "noncommercial"),
    ("commercial", "for non commercial (use|purposes) only", "noncommercial"),
    ("commercial", "commercial use (is )?(prohibited|not (allowed|permitted))", "noncommercial"),
    ("research", "for (academic and )?research (use|purposes) only", "research-only"),
    ("warranty", "without warranty of any kind", "warranty-disclaimer"),
    ("warranties", "without warranties or conditions of any kind", "warranty-disclaimer"),
    ("educational", "for (personal|educational) (and|or) (personal|educational) use only", "noncommercial"),
    ("personal", "for personal (and|or) personal use only", "noncommercial"),
)

# The ways a name is cited; NAME stands for it. (priority, words)
CITATIONS = (
    (35, "((this|the) [a-z]+ (is|are) )?(dual )?(licen[cs]ed|released|distributed|published|available|provided|made available) (under|according to|subject to)( the)?( terms of( the)?)? NAME( licen[cs]e)?"),
    (30, "(under|subject to)( the)? terms (and conditions )?of( the)? NAME( licen[cs]e)?"),
    (25, "licen[cs]e(s)? NAME( licen[cs]e)?"),
    (20, "NAME licen[cs]e"),
)

# Keywords whose names are distinctive enough to count alone, and the priority of that.
ALONE = ("cc", "cc0", "creative", "gplv2", "gplv3", "wtfpl", "gnu", "mozilla", "eclipse", "boost")
ALONE_PRIORITY = 15

def rules() -> list[tuple[int, str, str, str, int, bool]]:
    """(number, keyword, expression, label, priority, base), in order."""
    found = [("license", words, label, 10, True) for words, label in BASE]
    for label, (keyword, name, spdx) in NAMES.items():
        label = label.removesuffix("-long")
        if label.startswith("gpl-short"):
            label = f"gpl-{label[-1]}.0"
        if spdx:
            found.append(("spdx", f"spdx licen[cs]e identifier {spdx}", label, 50, False))
        if keyword in ALONE:
            found.append((keyword, name, label, ALONE_PRIORITY, False))
        found += [(keyword, words.replace("NAME", f"({name})"), label, priority, False) for priority, words in CITATIONS]
    found += [(keyword, words, label, 40, False) for keyword, words, label in SENTENCES]
    return [(i, keyword, f"(?<= ){words}(?= )", label, priority, base) for i, (keyword, words, label, priority, base) in enumerate(found)]


def anchors() -> str:
    """An expression for the texts that hold a rule's keyword, in any case: no rule can match another text. A keyword
    that begins with a shorter one is found by that one."""
    keywords = sorted({r[1] for r in rules()}, key=lambda k: (len(k), k))
    least = [k for i, k in enumerate(keywords) if not any(k.startswith(o) for o in keywords[:i])]
    return "(?i)" + "|".join(least)


def rule_table(spark: SparkSession) -> DataFrame:
    names = ("rule", "keyword", "pattern", "label", "priority", "base")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rules()])
    return spark.range(1).select(F.inline(table))


def detections(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, lo, hits): one row for each block and matching rule (one at least for each row of ``docs``);
    hits are structs (start, stop, priority, rule, label, base) with word positions in the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n_words = F.regexp_count("text", F.lit(NON_ALNUM_ANY_CASE.replace("[", "[^", 1))).cast("long")
    flat = F.trim(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), NON_ALNUM, " "))
    words = F.when(F.col("text").rlike(anchors()), F.split(flat, " "))
    rows = rows.select("row", "doc_id", n_words.alias("n_words"), words.alias("words"))
    cut_up = F.expr(f"transform(sequence(0, size(words) - 1, {BLOCK}), lo -> struct(lo, greatest(lo - {MARGIN}, 0) AS first, slice(words, greatest(lo - {MARGIN}, 0) + 1, lo - greatest(lo - {MARGIN}, 0) + {BLOCK + MARGIN}) AS part))")
    blocks = rows.select("row", "doc_id", "n_words", F.explode_outer(F.when(F.size("words") > 0, cut_up)).alias("b"))
    blocks = blocks.select("row", "doc_id", "n_words", "b.lo", "b.first", F.concat(F.lit(" "), F.array_join("b.part", " "), F.lit(" ")).alias("body"))
    table = rule_table(docs.sparkSession)
    keywords = sorted({r[1] for r in rules()})
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("body"), k))
    gated = blocks.withColumn("keyword", F.explode_outer(F.when(F.col("body").isNotNull(), held)))
    # The rules are a fixed table of a few hundred rows.
    met = gated.join(F.broadcast(table), "keyword", "left")
    met = met.withColumn("found", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("body", F.col("pattern"), F.lit(0))))
    met = met.withColumn("between", F.when(F.size("found") > 0, F.split("body", F.col("pattern"), F.lit(-1))))
    # Word positions from the words between the matches; a block has a few hundred matches at most.
    step = F.expr("""aggregate(zip_with(slice(between, 1, size(found)), found, (b, m) -> struct(length(b) - length(replace(b, ' ', '')) - 1 AS gap, length(m) - length(replace(m, ' ', '')) + 1 AS len)),
        named_struct('at', first, 'out', cast(array() AS array<struct<start: int, stop: int>>)),
        (acc, x) -> named_struct('at', acc.at + x.gap + x.len, 'out', concat(acc.out, array(named_struct('start', acc.at + x.gap, 'stop', acc.at + x.gap + x.len)))), acc -> acc.out)""")
    met = met.withColumn("spans", F.when(F.size("found") > 0, step))
    hits = F.expr("transform(spans, s -> named_struct('start', s.start, 'stop', s.stop, 'priority', priority, 'rule', rule, 'label', label, 'base', base))")
    return met.select("row", "doc_id", "n_words", "lo", hits.alias("hits"))


def surviving(found: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, base, kept): the base places and the unsuppressed detections of every row."""
    per_block = found.groupBy("row", "doc_id", "n_words", "lo").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    beaten = """exists(hits, o -> o.rule <> h.rule AND o.start <= h.start AND o.stop >= h.stop AND (o.priority > h.priority
        OR (o.priority = h.priority AND (o.stop - o.start > h.stop - h.start OR (o.stop - o.start = h.stop - h.start AND o.rule < h.rule)))))"""
    # A block reports the detections that start in it; those in its margins only suppress.
    own = f"h.start >= lo AND h.start < lo + {BLOCK}"
    per_block = per_block.withColumn("places", F.expr(f"filter(hits, h -> h.base AND {own})")).withColumn("kept", F.expr(f"filter(hits, h -> {own} AND NOT {beaten})"))
    return per_block.select("row", "doc_id", "n_words", "places", "kept")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row. The score is the
    highest priority of a detection, 50 being 1."""
    per_block = surviving(detections(docs))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("places", "kept")]
    x = per_block.groupBy("row", "doc_id", "n_words").agg(*lists)
    names = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "kept.label")))
    top = F.array_max(F.concat("places.priority", "kept.priority"))
    return x.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(top.isNull(), 0.0).otherwise(F.least(top / 50.0, F.lit(1.0))).alias("score"),
    )
