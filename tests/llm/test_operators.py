"""Every dealt operator against brute force on a small table with NULLs, empty and long texts, ties, repeated rows and
clashing column names; and on an empty table."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import decontaminate, graph, language, licenses, lines, mixing, neighbours, passages, quality, setsketch, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, n long, size string, words string, bucket int, member string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, lang="en"):
    parts = {"en": "the of and ing er th on an re ed".split(), "de": "der die und sch ung ein ver ich heit".split()}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module", autouse=True)
def ansi(spark):
    """Sessions of users run in ANSI mode, Spark's default."""
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield
    spark.conf.set("spark.sql.ansi.enabled", "false")


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    base, passage, line = prose(rng, 200), prose(rng, 60), prose(rng, 24)
    item = prose(rng, 14)
    texts = [None, "", "   \n\t ", "123 !!", "one", "one", "one two three four", "Ünïcode Éa éa İx", base, base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 9), edited(rng, base, 9)]
    texts += [edited(rng, base, 3) for _ in range(12)]
    texts += [prose(rng, 80) + " " + passage + " " + prose(rng, 30), prose(rng, 20) + " " + passage, "\n".join([prose(rng, 30), line, prose(rng, 30)]), "\n".join([line.upper() + " 7!", prose(rng, 40), "short"]), "\n".join([line] * 3)]
    texts += ["See. Licensed under the\nApache License, Version 2.0. MIT license; mit-License", "GNU General Public License general public\tlicense", "word " * 3000 + "the MIT License", item, "So " + item.upper() + " end", " ".join(item.split(" ")[:9])]
    texts += ["a # b $ c | d " * 30, "same same same same " * 40, prose(rng, 200000), prose(rng, 90, "de"), prose(rng, 90, "de")]
    rows = []
    for i, t in enumerate(texts):
        rows.append((None if i == 20 else i, t, None if i % 9 == 0 else "de" if i > len(texts) - 3 else "en", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), 7, "k", 1, "size", "w", 0, "m"))
    rows.append(rows[9])
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    return rows, item


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def test_license_scan(docs, nothing, table):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    want = Counter()
    for doc_id, text, *_ in table[0]:
        w, starts, names = ALNUM.findall(low(text)), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            names |= {label} if at else set()
        want[doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names))] += 1
    assert got == want
    assert licenses.scan(nothing).count() == 0


def test_license_rules_fire_alone(spark):
    """A text of one rule's phrase and nothing else reaches the rule: nothing before the rules may leave it out."""
    plain = lambda p: re.sub(r"\[[^]]*?(\d|[a-z])\]", r"\1", p)
    texts = {}
    for number, _, pattern, label, *_ in licenses.rules():
        words = plain(pattern.removeprefix("(?<= )").removesuffix("(?= )").replace("[a-z]+", "work").replace(".{1,60}", "some body"))
        while "(" in words:
            words = re.sub(r"\(([^()|]*)(\|[^()]*)?\)\??", r"\1", words)
        words = words.replace("?", "").upper()
        assert re.search(pattern, f" {words.lower()} "), (number, words)
        texts[number] = (words, label)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, w) for i, (w, _) in texts.items()], "doc_id long, text string")).collect()}
    silent = [w for i, (w, _) in texts.items() if not got[i].labels or not got[i].score > 0]
    assert silent == []


def test_license_suppression(spark):
    text = "This work is licensed under the Apache License, Version 2.0, and under CC BY-NC-SA 4.0."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "apache,apache-2.0,cc-by-nc-sa" and 0 < row.score <= 1  # the longer, more specific rules win; the base label stays
    plain = licenses.scan(spark.createDataFrame([(1, "nothing of the kind")], "doc_id long, text string")).first()
    assert plain.labels == "" and plain.score == 0 and plain.first_word is None


def test_license_matches_across_blocks(spark):
    text = " ".join(["w"] * (licenses.BLOCK - 1) + ["mit", "license"] + ["w"] * 2000 + ["apache", "license"])
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word) == (2, licenses.BLOCK - 1, licenses.BLOCK + 2001)


def test_quality_counts(docs, nothing, table):
    got = Counter(tuple(r)[:7] for r in quality.verdicts(docs).collect())
    want = Counter()
    for doc_id, text, *_ in table[0]:
        text = text or ""
        w = SPACED.findall(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        ls = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(inside), failed] += 1
    assert got == want
    assert quality.verdicts(nothing).count() == 0


def test_quality_thresholds_adapt(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 100), "en", "ac"[i % 2]) for i in range(120)]
    rows += [(200 + i, " ".join(w + "#" if j < 11 else w for j, w in enumerate(prose(rng, 100).split())), "en", "b") for i in range(60)]
    rows += [(900, rows[120][1], "en", "a"), (901, prose(rng, 100), None, None)]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior=20).collect()}
    assert all(got[i].kept for i in range(120)) and all(got[200 + i].kept for i in range(60)) and got[901].kept  # usual in its own group
    assert not got[900].kept and got[900].failed_rules == "symbols"  # the same text is out of line elsewhere


def brute_limits(measured, fence=3.0, prior=100.0):
    """Limits of (lang, source) from rows (lang, source, n_words, word_chars, the other counts)."""
    import math

    def bucket(v):
        return 0.0 if v <= 0 else 2 * 1.02 ** math.ceil(math.log(v) / math.log(1.02)) / 2.02

    def reach(values, tolerance):
        values = sorted(values)
        low, mid, top = (values[math.ceil(q * len(values) - 1e-9) - 1] for q in (0.1, 0.5, 0.9))
        return math.log(1.02 * top + fence * (top - mid) + tolerance) if tolerance > 0 else math.log(max(low / 1.02 - fence * (mid - low) + tolerance, 1e-3))

    def median(parts):
        parts, upto = sorted((r, n / (n + prior)) for n, r in parts), 0.0
        for r, w in parts:
            upto += w
            if upto * (1 + 1e-9) >= sum(w for _, w in parts) / 2:
                return r

    out = defaultdict(dict)
    rules = {
        "symbols": (0.05, lambda r: max(r[4] - 5, 0) / r[2]),
        "dup_lines": (0.05, lambda r: max(r[5] - 1, 0) / r[7]),
        "repeats": (0.05, lambda r: max(r[6] - 50, 0) / r[2]),
        "capitals": (0.05, lambda r: max(r[8] - 10, 0) / r[3]),
        "marks": (0.05, lambda r: max(r[9] - 5, 0) / r[2]),
        "long_words": (0.5, lambda r: r[3] / r[2]),
        "short_words": (-0.5, lambda r: r[3] / r[2]),
    }
    good = [r for r in measured if r[2] >= 50 and 100 * r[6] <= 50 * r[2]]
    for name, (tolerance, of) in rules.items():
        groups = defaultdict(list)
        for r in good:
            groups[r[0], r[1]].append(bucket(of(r)))
        own = {g: (len(values), reach(values, tolerance)) for g, values in groups.items()}
        langs = {lang: [own[g] for g in own if g[0] == lang] for lang, _ in own}
        langs = {lang: (sum(n for n, _ in parts), median(parts)) for lang, parts in langs.items()}
        every = median(list(langs.values()))
        for g, (n, r) in own.items():
            m, lang_reach = langs[g[0]]
            lang_limit = every + (lang_reach - every) * m / (m + prior)
            out[g][name] = math.exp(lang_limit + (r - lang_limit) * n / (n + prior) / 2)
    return out, rules


def test_quality_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = prose(rng, rng.choice((20, 60, 90, 150))).split()
        if rng.random() < (0.6 if i % 5 == 0 else 0.1):
            words = [w + rng.choice("#%&") if rng.random() < 0.6 else w for w in words]
        if rng.random() < 0.1:
            words = [w.upper() if rng.random() < 0.5 else w for w in words]
        text = " ".join(words) + ("\n" + "again and again the same line!" * 2) * rng.choice((0, 0, 1, 4))
        rows.append((i, text, rng.choice(("en", "en", "de", None)), f"s{i % 5}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = {i: (lang, source, *quality.measure(text.encode())) for i, text, lang, source in rows}
    limits, rules = brute_limits(list(counted.values()))
    got = {r.doc_id: r for r in quality.verdicts(frame).collect()}
    for i, r in counted.items():
        base = r[2] < 50 or 100 * r[6] > 50 * r[2]
        if not base:
            broken = [k for k, (tolerance, of) in rules.items() if (of(r) > limits[r[0], r[1]][k]) == (tolerance > 0) and of(r) != limits[r[0], r[1]][k]]
            assert got[i].failed_rules == ",".join(broken), i
            assert got[i].kept == (not broken)
        assert got[i].base_failed == base and not (base and got[i].kept)
    assert any(got[i].failed_rules for i in got)


def test_a_dirty_hot_source_does_not_excuse_itself(spark):
    rng = random.Random(4)

    def dirty():
        return " ".join(w + "#" if rng.random() < 0.7 else w for w in prose(rng, 90).split())

    rows = [(i, prose(rng, 90), "en", f"s{i % 6}") for i in range(300)]
    rows += [(1000 + i, dirty(), "en", "hot") for i in range(200)]
    rows += [(2000 + i, prose(rng, 90), "en", "hot") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.verdicts(frame).collect()}
    assert not any(kept[1000 + i] for i in range(200)) and all(kept[2000 + i] for i in range(40))
    assert sum(kept[i] for i in range(300)) >= 297


def test_learned_fences_decide(spark):
    """Word length and capitals have fences of their own in every group; a text beyond one goes although no fixed cutoff says so."""
    rng = random.Random(6)
    short, long_ = "a be so to on in at it up we".split(), "internationalisation responsibilities characterisation straightforwardness".split()
    texts = {"plain": lambda: " ".join(rng.choice(short) + rng.choice(short) for _ in range(80)), "legal": lambda: " ".join(rng.choice(long_) + rng.choice(short) for _ in range(80))}
    rows = [(i + 1000 * j, make(), lang, "s") for j, (lang, make) in enumerate(texts.items()) for i in range(300)]
    rows += [(5000, texts["legal"](), "plain", "s"), (5001, texts["plain"](), "legal", "s")]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior=5).collect()}
    assert got[5000].failed_rules == "long_words" and got[5001].failed_rules == "short_words"
    assert all(got[i].kept and got[1000 + i].kept for i in range(300))


def test_sketches_merge(spark):
    rng = random.Random(1)
    vals = [rng.lognormvariate(0, 2) for _ in range(4000)]
    measured = spark.createDataFrame([(f"l{i % 3}", "s", 1000, int(v * 1000), 0, 0, 0, 1, 0, 0) for i, v in enumerate(vals)], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long")
    merged = quality.sketch(measured).groupBy("measure", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    row = quality.quantiles(merged, [], {"q1": 0.25, "q3": 0.75}).where("measure = 'long_words'").first()
    exact = sorted(int(v * 1000) / 1000 for v in vals)
    assert abs(row.q1 / exact[999] - 1) < 0.011 and abs(row.q3 / exact[2999] - 1) < 0.011


def line_words(line):
    return [w for w in re.split("[\x00-\x60\x7b-\x7f]+", line.lower()) if w]


def test_simhash(docs, table):
    import xxhash

    got = {(r.doc_id, r.line_no): (r.m, r.sim) for r in lines.simhashes(lines.lines(docs, 5)).collect()}
    assert max(m for m, _ in got.values()) > 100_000
    for doc_id, text, *_ in table[0]:
        for no, line in enumerate((text or "").split("\n")):
            words = line_words(line)
            if len(words) >= 5 and doc_id is not None:
                hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
                bits = sum((sum(h >> j & 1 for h in hashes) > len(words) // 2) << j for j in range(64))
                assert got[doc_id, no] == (len(words), bits - (1 << 64) * (bits >> 63))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def within(a, b, most):
    """Whether the edit distance is at most ``most``: the band of the matrix that can stay so low, row by row."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            cell = i if j == 0 else min(row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            new[j] = min(cell, most + 1)
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def test_within_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        for most in range(6):
            assert within(a, b, most) == (edit_distance(a, b) <= most)


def test_fuzzy_lines(spark, nothing):
    rng = random.Random(9)
    body = [prose(rng, 60) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(body) if rng.random() < 0.5 else edited(rng, rng.choice(body), 1) for _ in range(4)) + f"\nshort {i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    at = sorted((i, j) for i, _ in rows for j in range(4))
    norm = {(i, j): " ".join(line_words(t.split("\n")[j])) for i, t in rows for j in range(4)}
    parent = {p: p for p in at}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    @cache
    def near(a, b):
        return a == b or within(a, b, max(len(a), len(b)) // 10)

    for i, p in enumerate(at):
        for q in at[:i]:
            if near(*sorted((norm[p], norm[q]))):
                a, b = sorted((root(p), root(q)))
                parent[b] = a
    want = defaultdict(list)
    for p in at:
        if root(p) != p:
            want[p[0]].append(p[1])
    got = {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in lines.line_report(frame).collect()}
    assert got == {i: want.get(i, []) for i, _ in rows}
    kept = {r.doc_id: r.text for r in lines.without_repeats(frame).collect()}
    for i, text in rows:
        stay = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in want.get(i, []))
        assert kept.get(i) == stay
    assert lines.line_report(nothing).count() == 0


def typo(rng, text, edits):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), edits):
        j = rng.randrange(len(words[i]))
        words[i] = words[i][:j] + "q" + words[i][j + 1 :]
    return " ".join(words)


def test_fuzzy_lines_of_every_length(spark):
    """Against plain edit similarity: pairs of lines with one letter changed, or one word of a long line."""
    rng = random.Random(31)
    pairs = []
    for n in (5, 6, 8, 10, 20, 50, 100):
        for _ in range(12):
            base = prose(rng, n)
            pairs.append((base, edited(rng, base, 1) if n >= 50 else typo(rng, base, 1 if n < 8 else 2)))
    near = [edit_distance(a, b) <= 0.1 * max(len(a), len(b)) for a, b in ((" ".join(line_words(x)) for x in p) for p in pairs)]
    rows = [(2 * i + j, text) for i, p in enumerate(pairs) for j, text in enumerate(p)]
    got = {r.doc_id: r.n_dropped for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(near) >= 60
    assert [got[2 * i + 1] == 1 for i in range(len(pairs))] == near
    assert not any(got[2 * i] for i in range(len(pairs)))


def test_bounds_before_the_edit_distance_are_exact(spark):
    """Random edits of repetitive and of other texts: the pair test says what the plain edit distance says."""
    rng, rows = random.Random(5), []
    for i in range(240):
        words = ["".join(rng.choices("abcdeé𝔞xyz", k=rng.randint(1, 8))) for _ in range(rng.choice([3, 40]))]
        a = " ".join(rng.choices(words, k=rng.choice([12, 120])))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 7))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", " ", "𝔞"])
        rows.append((a, "".join(b) if i % 4 else " ".join(rng.choices(words, k=a.count(" ") + 1))))
    both = spark.createDataFrame(rows, "ta string, tb string").withColumn("la", lines.letters("ta")).withColumn("lb", lines.letters("tb"))
    most = "cast(floor(0.1 * greatest(length(ta), length(tb)) + 1e-9) AS int)"
    got = both.select(lines.within(most).alias("got"), F.expr(f"levenshtein(ta, tb) <= {most}").alias("want")).collect()
    assert all(r.got == r.want for r in got) and 40 < sum(r.want for r in got) < 200


def test_only_close_pairs_leave_a_bucket(spark):
    """One bucket of unlike members: the open pairs that the signs rule out are never tested."""
    members = spark.createDataFrame([(1, i) for i in range(60)], "bucket long, id long")
    signs, asked = spark.createDataFrame([(i, i // 2) for i in range(60)], "id long, s long"), []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a div 2 = b div 2")

    got = graph.linked_groups(graph.bucket_mates(members), verify, rounds=2, signs=signs, close="s_a = s_b")
    assert {(r.id, r.comp) for r in got.collect()} == {(i, i - i % 2) for i in range(60)}
    assert len(asked) <= 60


def test_line_distance_is_settled_before_the_square(spark):
    """Lines of one edit or one longer run never reach the bounded distance whole, and the verdict is its own on any pair."""
    rng = random.Random(5)
    pairs = [("a b c d e", "a b c d e f"), ("b c d e f", "a b c d e f"), ("a a a a a b", "a a b"), ("x", "y z"), ("a b", "c d"), ("a b c", "a c")]
    for _ in range(150):
        words = [rng.choice(["la", "der", "thing", "o", "straße"]) for _ in range(rng.randint(1, 60))]
        other = list(words)
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(other) + 1)
            other[i : i + rng.choice([0, 1, 1, 3])] = rng.choices(["la", "der", "neu"], k=rng.choice([0, 1, 1, 2, 30]))
        pairs.append((" ".join(words), " ".join(other) or "o"))
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame(pairs, "ta string, tb string").selectExpr("*", "split(ta, ' ') AS wa", "split(tb, ' ') AS wb", "length(ta) AS na", "length(tb) AS nb")
    for most in ("2", "cast(floor(0.1 * greatest(na, nb) + 1e-9) AS int)", "30"):
        got = df.select(lines.within(most).alias("in"), F.expr(f"levenshtein(ta, tb) <= {most}").alias("want"), F.expr(lines.between(most)).alias("mid"), F.expr(f"levenshtein(ta, tb, {most})").alias("whole"), F.expr(f"{lines.aligned('100000')} >= levenshtein(ta, tb)").alias("above")).collect()
        assert all(r["in"] == r["want"] and r["mid"] == r["whole"] and r["above"] for r in got)
    # Texts of 400,000 characters: their square would take hours.
    run = " ".join(["thor"] * 40_000) + " "
    text = run + " ".join(f"w{i}" for i in range(40_000))
    changed = text.replace(" w777 ", " v ").replace(" w30000 ", " ").replace(" w5 ", " w5 more ")
    long_ = spark.createDataFrame([(text, changed), (text, run * 2 + "a"), (text, "thor " * 5_000 + text)], "ta string, tb string")
    long_ = long_.selectExpr("*", "split(ta, ' ') AS wa", "split(tb, ' ') AS wb", "length(ta) AS na", "length(tb) AS nb")
    got = long_.select(lines.within("cast(floor(0.1 * greatest(na, nb) + 1e-9) AS int)").alias("in")).collect()
    assert [r["in"] for r in got] == [True, False, True]


def test_fuzzy_lines_edge_rows(docs, table):
    got = lines.line_report(docs).collect()
    assert len(got) == len(table[0])
    assert all(r.n_lines >= 1 and r.n_dropped <= r.n_lines for r in got)
    stay = lines.without_repeats(docs)
    assert stay.columns == docs.columns and stay.where("text is null").count() == 2


def test_mixing(docs, nothing, table):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(table[0])
    assert all(0 <= r.taken <= 2 * r.size and r.size >= 0 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sources[0]].append(r)
    names = sorted([s for s in by if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {s: 2 * sum(r.size for r in by[s]) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(cap.values()) / 2
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap[s]}
        if not full:
            target |= share
            break
        target |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    for s in names:
        assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == cap[s] // 2
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0
    taken = mixing.mixed(docs)
    assert taken.columns == [*docs.columns, "repeats"] and taken.count() == sum(r.times > 0 for r in rows)


def test_flow_is_cheapest():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 1, ("c",): 4}
    quota = {"a": 5.0, "b": 14.0, "c": 8.0}
    flow = mixing.route(capacity, quota)
    for s, q in quota.items():
        assert sum(v for (_, t), v in flow.items() if t == s) == pytest.approx(q)
    used = Counter()
    for (p, _), v in flow.items():
        used[p] += v
    cost = sum(min(used[p], c) + 4 * max(used[p] - c, 0) for p, c in capacity.items())
    best = min(a + 4 * max(a - 1, 0) + min(14 - a, 10) + 4 * max(14 - a - 10, 0) for a in (x / 8 for x in range(17)))
    assert cost == pytest.approx(5 + best + 4 + 16)


def test_overlapping_sources(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(5, 60)), [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, belongs array<string>"), sources="belongs").collect()
    assert len(out) == 400 and all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), rel=0.35)


def test_toxicity(spark, docs, nothing, table):
    rng = random.Random(4)
    rows = [(1000 + i, prose(rng, 60) + (" you wretchling" if i % 2 else "") + " " + prose(rng, 20), i % 2) for i in range(400)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    known = labels(spark, [(r[0], 1, r[2], "clash") for r in rows] + [(None, 1, 1, ""), (3, None, None, "")])
    got = toxicity.scores(all_docs, known).collect()
    assert len(got) == len(table[0]) + 400 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r for r in got if r.held_out and (r.doc_id or 0) >= 1000}
    assert held and all(held[r[0]].predicted == r[2] for r in rows if r[0] in held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3, 4, 5))  # no words, or clean ones
    assert toxicity.scores(nothing, labels(spark)).count() == 0
    assert {r.score for r in toxicity.scores(docs, labels(spark)).collect()} == {0.0}


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idiot ": 4.0, " idi": 1.0})
    assert lexicon.weigh("You 1D10T!")[0] == 4.0  # digits, capitals, punctuation
    assert lexicon.weigh("іdіоt")[0] == 4.0  # Cyrillic letters
    assert lexicon.weigh("the trash can is full")[:2] == (0, 0) and lexicon.weigh("trash canoe")[0] == 3.0
    assert lexicon.weigh("idiomatic")[0] == 1.0 and lexicon.weigh(None) == (0, 0, 0)


def hits_of(words, wins):
    inside, items = set(), set()
    for size in {len(w) for w in wins}:
        for i in range(len(words) - size + 1):
            found = wins.get(tuple(words[i : i + size]))
            if found:
                inside |= set(range(i, i + size))
                items |= found
    return inside, items


def test_decontamination(spark, docs, nothing, table):
    items = [(1, table[1]), (2, "one two three"), (3, None), (4, ""), (10, table[1]), (None, "the mit license")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[j : j + 10])].add("" if i is None else str(i))
    want = Counter()
    for doc_id, text, *_ in table[0]:
        w = ALNUM.findall(low(text))
        inside, found = hits_of(w, wins)
        want[doc_id, len(w), len(inside), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(inside)] += 1
    assert Counter(map(tuple, decontaminate.contamination(docs, bench).collect())) == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in want.items() if not r[-1])
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_words_are_cut_not_counted_by_matches(spark):
    """Matches of the words' expression took eight times the time of cutting them; the counts are the same."""
    texts = [None, "", "...", "a", " one  two ", "Ünï côdé x9-y", "tail 1. ", "\x00a\x7fb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("i", "nothing of this stands anywhere")], "item_id string, text string")
    got = decontaminate.contamination(docs, items)
    assert "regexp_count" not in got._jdf.queryExecution().optimizedPlan().toString()
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {i: len(rule.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_words for r in got.collect()} == want


def test_clean_keeps_every_column(spark):
    rng = random.Random(2)
    item = prose(rng, 12)
    docs = spark.createDataFrame([(1, prose(rng, 30), "a", "b", "c"), (2, "so " + item + " end", "d", "e", "f"), (None, None, "g", None, "h")], "doc_id long, text string, _k string, k string, row string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    assert {(r.doc_id, r._k, r.k, r.row) for r in got.collect()} == {(1, "a", "b", "c"), (None, "g", None, "h")}
    assert decontaminate.clean(docs.limit(0), items).count() == 0


def test_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    rows = [(1, "x " + item), (2, item.replace("charlie", "charlie the very")), (3, "alpha bravo " + "pad " * 40 + "charlie"), (4, "nothing")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    phrases = decontaminate.windows(spark.createDataFrame([(1, item)], "item_id long, text string")).select("win", "words").distinct()
    near = decontaminate.Index(frame, phrases, 3).near(slop=5)
    names = decontaminate._rows(frame).join(near, "k").select("doc_id").distinct()
    assert {1, 2} <= {r.doc_id for r in names.collect()} and 4 not in {r.doc_id for r in names.collect()}


def test_language(spark, docs, nothing, table):
    rng = random.Random(6)
    rows = [(2000 + i, prose(rng, 60, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(200)]
    all_docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.languages(all_docs).collect()
    assert len(got) == len(table[0]) + 200
    held = {r.doc_id: r for r in got if r.held_out and (r.doc_id or 0) >= 2000}
    assert held and all(held[r[0]].lang_pred == r[2] for r in rows if r[0] in held)
    for r in got:
        text = dict((x[0], x[1]) for x in table[0] if x[0] is not None).get(r.doc_id)
        if r.doc_id is not None and r.doc_id < 2000 and not (text and any(c.isalpha() for c in text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert language.languages(nothing).count() == 0
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", docs.lang.substr(1, 0))).collect()} <= {"und", ""}
    kept = language.identified(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = '' or text = '123 !!'").count() == 0


def test_language_blocks(monkeypatch):
    text = prose(random.Random(1), 300)
    whole = Counter(int(x) for part in language.features(text) for x in part)
    monkeypatch.setattr(language, "BLOCK", 64)
    assert whole == Counter(int(x) for part in language.features(text) for x in part)


def test_neighbours(spark, docs, nothing, table):
    rng = random.Random(8)
    rows = [(3000 + i, prose(rng, 60) if i % 2 else "JUNK!! " * 40 + prose(rng, 5), i % 2) for i in range(300)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = neighbours.scores(all_docs, labels(spark, [(r[0], r[2], None, "clash") for r in rows])).collect()
    assert len(got) == len(table[0]) + 300 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r for r in got if r.held_out and (r.doc_id or 0) >= 3000}
    assert held and all(held[r[0]].predicted == r[2] for r in rows if r[0] in held)
    assert neighbours.scores(nothing, labels(spark)).count() == 0
    assert {r.score for r in neighbours.scores(docs, labels(spark)).collect()} == {0.0}


def test_exact_neighbours():
    import numpy as np

    rng = np.random.default_rng(0)
    points = neighbours._unit(rng.normal(size=(60, 5)).astype(np.float32))
    model = neighbours.Model(np.ones(neighbours.TERMS, np.float32), rng.normal(size=(neighbours.TERMS, 5)).astype(np.float32), points, rng.integers(0, 2, 60).astype(float))
    texts = [b"some text", b"Other TEXT!!", b"", None]
    for text, score in zip(texts, model.score(texts)):
        cosine = (model.project(neighbours.term_counts(text)[None]) @ points.T)[0].astype(float)
        near = np.argsort(-cosine)[: neighbours.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6) ** 4
        if text:
            assert score == pytest.approx((w * model.votes[near]).sum() / w.sum(), rel=1e-4)


def covered(words, others):
    runs = {tuple(o[j : j + 50]) for o in others for j in range(len(o) - 49)}
    return {x for j in range(len(words) - 49) if tuple(words[j : j + 50]) in runs for x in range(j, j + 50)}


def test_repeated_passages(docs, nothing, table):
    got = {r.doc_id: r for r in passages.repeats(docs).collect()}
    texts = {x[0]: SPACED.findall(low(x[1])) for x in table[0] if x[0] is not None}
    spare = [SPACED.findall(low(x[1])) for x in table[0] if x[0] is None]
    for i, w in texts.items():
        want = covered(w, [o for j, o in texts.items() if j != i] + spare)
        if want:
            have = {x for s in got[i].spans.split(",") for a, b in [map(int, s.split("-"))] for x in range(a, b)}
            assert want <= have, i
        if len(w) < 50:
            assert i not in got
    assert not {33, 37, 38, 39} & set(got)  # repeats inside one document, and text of its own
    assert passages.repeats(nothing).count() == 0


def test_fuzzy_passage(spark):
    rng = random.Random(12)
    passage = prose(rng, 120)
    words = passage.split(" ")
    changed = " ".join([*words[:60], "inserted", *words[60:100], "swapped", *words[101:]])
    rows = [(1, prose(rng, 100) + " " + passage), (2, prose(rng, 40) + " " + changed + " " + prose(rng, 30)), (3, prose(rng, 200))]
    got = {r.doc_id: r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[2].n_repeated >= 118 and got[1].class_id == got[2].class_id == 1


def test_repeat_behind_a_fragment(spark):
    """A smaller id that holds 45 to 49 words of a passage must not stand between two documents that hold all of it."""
    rng = random.Random(17)
    rows, whole = [], set()
    for i, (n, part) in enumerate([(50, 45), (50, 49), (55, 45), (60, 49), (52, 47)] * 8):
        passage = prose(rng, n)
        at = rng.randrange(n - part + 1)
        rows.append((i, " ".join([prose(rng, 30), *passage.split(" ")[at : at + part], prose(rng, 30)])))
        for j in (1000 + 2 * i, 1001 + 2 * i):
            rows.append((j, " ".join([prose(rng, 30), passage, prose(rng, 30)])))
            whole.add(j)
    got = {r.doc_id: r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == whole
    for j in whole:
        assert got[j].class_id == j - j % 2 and got[j].n_repeated >= 50


def test_compact_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 40, 150).astype(np.uint64)
    c, left, right = passages.compact_windows(tokens, 1, 8)
    order = [(int(x), i) for i, x in enumerate(passages.mix64(tokens * passages._A[1]) >> np.uint64(8))]
    runs = {}
    for i in range(150):
        for j in range(i + 7, 150):
            runs[i, j] = min(order[i : j + 1])[1]
    for (i, j), place in runs.items():
        assert [int(p) for p, a, b in zip(c, left, right) if a <= i <= p <= j <= b] == [place]


def test_near_duplicates(docs, nothing, table):
    sets = defaultdict(set)
    rows = table[0]
    for i, (_, text, *_) in enumerate(rows):
        w = SPACED.findall(low(text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    group = {i: {i} for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                union = group[i] | group[j]
                for x in union:
                    group[x] = union
    want = Counter()
    for i in sets:
        names = [rows[x][0] for x in group[i] if rows[x][0] is not None]
        comp = min(names) if names else None
        want[rows[i][0], len(sets[i]), comp, rows[i][0] == comp] += 1
    assert Counter(map(tuple, setsketch.near_duplicates(docs).collect())) == want
    assert setsketch.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_any_id(spark, nothing):
    """Ids over the whole 64-bit range, one doc_id with two texts, NULL ids, columns with internal names."""
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    big = (1 << 62) + 5
    rows = [(big, a), (big + 1, a), (-(1 << 63), c), ((1 << 63) - 1, c), (1, b), (1, d), (5, b + " more"), (6, d + " more"), (None, d), (None, "alone in the world of all these words"), (1, b)]
    frame = spark.createDataFrame([(i, t, f"id{k}", f"_id{k}", k, f"h{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, _id string, comp int, h string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(frame).collect())
    want = [(big, big, True), (big + 1, big, False), (-(1 << 63), -(1 << 63), True), ((1 << 63) - 1, -(1 << 63), False)]
    want += [(1, 1, True)] * 3 + [(5, 1, False), (6, 1, False), (None, 1, False), (None, None, True)]
    assert got == Counter(want)
    kept = setsketch.one_per_group(frame)
    assert kept.columns == frame.columns
    assert Counter(r.text for r in kept.collect()) == Counter([a, b, c, d, "alone in the world of all these words"])
    assert {r._id for r in kept.collect()} <= {f"_id{k}" for k in range(len(rows))}
    assert setsketch.one_per_group(nothing).count() == 0


def test_crowd_of_unlike_copies(spark):
    """Many copies with random edits: most pairs meet in bands, few are links; none may be lost."""
    rng = random.Random(21)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.choice((0, 1, 1, 2, 3, 4, 6, 8)))) for i in range(160)]
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split(" ")] for j in range(len(w) - 4)} for i, t in rows}
    comp = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((comp[i], comp[j]))
                comp = {x: a if c == b else c for x, c in comp.items()}
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_registers_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[400:2400])
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (np.maximum(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
    ra, rb = (setsketch.registers(x, 4096).astype(int) for x in (a, b))
    ll = setsketch.likelihood(np.array([len(a)]), np.array([len(b)]), np.array([(ra < rb).sum()]), np.array([(ra > rb).sum()]), np.array([(ra == rb).sum()]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(setsketch._GRID[ll[0].argmax()] - true) < 0.03


def test_pipeline(spark, docs, tmp_path, table):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, table[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [r.text for r in out]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert out and all(r.repeats in (1, 2) for r in out)
    assert all(t and any(c.isalpha() for c in t) for t in texts) and len(set(texts)) == len(texts)
    wins = {tuple(table[1].split(" ")[j : j + 10]): {1} for j in range(5)}
    assert not any(hits_of(ALNUM.findall(low(t)), wins)[0] for t in texts)


def test_components(spark):
    from tidemark.llm.graph import components

    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(900, i) for i in range(1000, 1300)] + [(1000, 1001), (900, 900)]
    mixed = [(a, b) for a, b in ((rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150))]
    edges = chain + star + mixed
    comp = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: comp[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cut_frees_its_shuffle_files(spark):
    """Disk holds the shuffles of one step, not of all steps so far."""
    import time

    from pyspark.sql import functions as F

    from tidemark.llm.common import TIDY, cut

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    before, setting = shuffles(), spark.conf.get(TIDY, None)
    out = cut(spark.range(2000).groupBy(F.col("id") % 100).agg(F.count("*").alias("n")), "tidy")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before and out.count() == 100 and spark.conf.get(TIDY, None) == setting


def test_operators_leave_only_their_result(spark, docs, table):
    """What was written on the way is gone, so stages of a pipeline do not add up on the disk, and texts that stay are not shuffled."""
    from pathlib import Path

    from tidemark.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    rows = docs.select("doc_id", "text")
    items = spark.createDataFrame([(1, table[1])], "item_id long, text string")
    before = set(folder.glob("*"))
    out = [lines.without_repeats(rows), setsketch.one_per_group(rows), decontaminate.clean(rows, items), passages.passages(rows)]
    names = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before)
    assert names == ["dropped-lines", "gone-or-repeated", "hits", "set-groups", "verified-passages"]
    assert all(x.count() >= 0 for x in out)
    # Repeated rows of a document that stays remain once, as before.
    twice = setsketch.one_per_group(rows.union(rows)).count()
    assert twice == setsketch.one_per_group(rows).count()


def test_among(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import among, cut

    rows = spark.range(5000).select(F.struct((F.col("id") % 2).alias("m"), F.col("id").alias("d")).alias("id"), F.lit("x").alias("text"))
    for step in (1, 3, 5000):
        ids = cut(rows.where(f"id.d % {step} = 0").select("id"), "ids")
        assert sorted(r.id.d for r in among(rows, ids).collect()) == list(range(0, 5000, step))
    assert among(rows, cut(rows.where("false").select("id"), "ids")).count() == 0


def test_passages_with_an_edit(spark):
    """Passages of 50 to 60 words with one word changed in them, most of them behind a smaller id that holds a fragment; and
    many documents that share one line of 30 words and no passage."""
    rng = random.Random(29)
    rows, want, line = [], {}, prose(rng, 30)
    for i in range(30):
        words = prose(rng, (50, 52, 56, 60)[i % 4]).split(" ")
        at = rng.randrange(20, 31) if len(words) > 50 else 25
        changed = " ".join([*words[:at], f"x{i}", *words[at + 1 :]])
        if i % 3:
            rows.append((i, " ".join([prose(rng, 30), *words[:40], prose(rng, 30)])))
        first, second = 1000 + 2 * i, 1001 + 2 * i
        rows += [(first, " ".join([prose(rng, 30), *words, prose(rng, 30)])), (second, " ".join([prose(rng, 20), changed, prose(rng, 40)]))]
        want |= {first: first, second: first}
    rows += [(2000 + i, " ".join([prose(rng, 40), line, prose(rng, 40)])) for i in range(40)]
    got = {r.doc_id: r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.n_repeated >= 50 for r in got.values())


def test_spans_within_a_group_are_whole(spark):
    """All documents share a passage; two and two of them share another one with an edit, beside the common one or beside a line that
    all have. Spans are those of testing all pairs."""
    rng = random.Random(41)
    common, line = prose(rng, 60), prose(rng, 38)
    rows, want = [], {}
    for i in range(16):
        if i % 2 == 0:
            tails = [prose(rng, 16), prose(rng, 16)]
        text = [prose(rng, 39), f"u{i}", common, f"x{i}", tails[0], f"v{i}", prose(rng, 28), f"w{i}", line, f"y{i}", tails[1], f"z{i}", prose(rng, 29)]
        rows.append((i, " ".join(text)))
        want[i] = "40-117,147-202"
    rows += [(100 + i, rows[i][1]) for i in range(3)]
    got = {r.doc_id: r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {i % 100 for i in got if i >= 100}
    for i, r in got.items():
        assert r.class_id == 0 and r.n_links >= 1
        assert r.spans == (f"0-{len(rows[i % 100][1].split())}" if i % 100 in whole else want[i])
        assert r.n_repeated == sum(b - a for a, b in [map(int, s.split("-")) for s in r.spans.split(",")])
    assert len(got) == 19 and len(whole) == 3


def test_passages_of_texts_that_repeat_themselves(spark):
    """A phrase over and over with a few edits makes very many runs; the chains are found in time of their number."""
    import time

    import numpy as np

    rng = random.Random(43)
    words = prose(rng, 7).split(" ") * 400
    sides = []
    for _ in range(2):
        side = list(words)
        for at in rng.sample(range(len(side)), 40):
            side[at] = f"z{rng.randrange(10**6)}"
        sides.append(passages.shingles(passages.WordIds().of([w.encode() for w in side])))
    start = time.time()
    found = passages.chains(*sides, [(7 * d, 0, len(sides[0]) - 1) for d in range(-60, 61)])
    assert found and time.time() - start < 8
    held = np.zeros(len(words), bool)
    for a, b, _, _ in found:
        held[a:b] = True
    assert held.mean() > 0.9


def test_like_members_take_few_links(spark, monkeypatch):
    """One bucket of 4 groups of 40 members, all alike within: a few links a member are tested, not all pairs."""
    monkeypatch.setattr(graph, "WAVES_FROM", 100)
    members, asked = spark.createDataFrame([(1, i) for i in range(160)], "bucket long, id long"), []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a % 4 = b % 4")

    signs = spark.createDataFrame([(i, i % 4) for i in range(160)], "id long, s long")
    got = graph.linked_groups(graph.bucket_mates(members), verify, rounds=2, signs=signs, close="s_a = s_b")
    assert {(r.id, r.comp) for r in got.collect()} == {(i, i % 4) for i in range(160)}
    assert len(asked) == len(set(asked)) <= 500


def test_letter_profiles_bound_the_distance(spark):
    """Long lines: the packed counts are those of the letters, and lines within the edit similarity are never ruled out by them."""
    from pyspark.sql import functions as F

    rng = random.Random(47)
    base = [prose(rng, 500) for _ in range(6)]
    rows = [(i, x) for i, x in enumerate(base)] + [(100 + i, typo(rng, x, 150)) for i, x in enumerate(base)] + [(200, "e " * 3000), (201, "short line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.split(F.trim("text"), " "))
    got = {r.doc_id: r for r in df.select("doc_id", F.array_join("words", " ").alias("t"), *[F.expr(lines.profile(of)).alias(p) for p, of in lines.PROFILE.items()]).collect()}
    for r in got.values():
        for p, of in lines.PROFILE.items():
            want = None if len(r.t) <= lines.LONG else sum(min(r.t.count(c), 4095) << (12 * i) for i, c in enumerate(of))
            assert r[p] == want
    pairs = spark.createDataFrame([(i, 100 + i, *[got[i][p] for p in lines.PROFILE], *[got[100 + i][p] for p in lines.PROFILE]) for i in range(6)] + [(201, 200, None, None, None, 1, 1, 1)], "a long, b long, " + ", ".join(f"{p}_{x} long" for x in "ab" for p in lines.PROFILE))
    for r in pairs.select("a", "b", F.expr(lines.profiles_apart()).alias("apart")).collect():
        assert r.apart + abs(len(got[r.a].t) - len(got[r.b].t)) <= 300 if r.a < 200 else r.apart == 0
