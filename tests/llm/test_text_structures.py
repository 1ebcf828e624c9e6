"""Byte-level BPE, periodic runs and spelling variants against a library round trip and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")

from tidemark.llm import bytepair, periodic, spelling  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, ids string, runs int, word string, n long, k string, data string, collapsed string"
EXTRA = ("x", 1, "w", 5, "k", "d", "c")


def prose(rng, n):
    return " ".join("".join(rng.choice("the of and ing er th on an re ed é ü".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module", autouse=True)
def ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield
    spark.conf.set("spark.sql.ansi.enabled", "false")


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "one", "one", "It's we'll I'd  don't 'twas\r\n x   y", "日本語 ٣٤ 🙂🙂 x́ <|endoftext|>", "a" * 3000, " " * 2000 + "x", "ab" * 1500, "na " * 400, "x y z " * 7 + "x", "a a a a b b b b b b"]
    texts += [prose(rng, 120) for _ in range(40)] + [prose(rng, 30000)]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, "no id " * 9, *EXTRA), (None, None, *EXTRA), ((1 << 62) + 5, "big big big big big big id", *EXTRA)]


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bytepair.parse_ranks(open(vocabulary[0], "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, table, folder, empty, library):
    want = Counter()
    for doc_id, text, *_ in table:
        ids = library[1].encode_ordinary(text or "")
        want[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or "")] += 1
    assert Counter(map(tuple, QUERIES["op11_byte_bpe"](spark, folder).collect())) == want
    assert QUERIES["op11_byte_bpe"](spark, empty).count() == 0


@pytest.mark.parametrize(("block", "leaf"), [(5, 1), (7, 3), (64, 16)])
def test_joins_equal_one_pass(monkeypatch, vocabulary, library, block, leaf):
    monkeypatch.setattr(bytepair, "BLOCK", block)
    monkeypatch.setattr(bytepair, "LEAF", leaf)
    rng, own = random.Random(block), bytepair.Codec(library[0], vocabulary[1])
    parts = ["a", "the", "aaaa", " ", "  ", "\n", "'", "'l", "'ll", "'re", "r", "e", "1", "٣", "é", "字", "#", " ,", "\t", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(70)))
        own.known.clear()
        assert own.splitter.split(text) == own.splitter.find(text)
        ids = own.encode(text)
        assert list(ids) == library[1].encode_ordinary(text)
        assert own.decode(ids)[0] == text.encode()


def test_segments_join_in_any_grouping(vocabulary, library):
    own, rng = bytepair.Codec(library[0], vocabulary[1]), random.Random(2)
    for _ in range(300):
        parts = [own.tree("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 40))).encode()) for _ in range(3)]
        whole = own.merge(b"".join(own.tokens[t] for p in parts for t in p))
        assert own.join(own.join(parts[0], parts[1]), parts[2]) == own.join(parts[0], own.join(parts[1], parts[2])) == whole


def test_decoding_in_blocks(monkeypatch, vocabulary, library):
    import numpy as np

    own = bytepair.Codec(library[0], vocabulary[1])
    ids = own.encode("Some text, and some more of it.")
    data, stops = own.decode(ids)
    monkeypatch.setattr(bytepair, "BATCH", 3)
    again, ends = own.decode(ids)
    assert again == data and (ends == stops).all()
    with pytest.raises(ValueError):
        own.decode(np.array([len(own.tokens)]))


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_runs(spark, table, folder, empty):
    want = Counter()
    for doc_id, text, *_ in table:
        w = repeated(doc_id, text)
        if len(w) > 20000:
            assert zlib.crc32(str(doc_id).encode()) % 10
            runs = []  # the brute force is quadratic; the text of its own has no run
        else:
            runs = brute_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = QUERIES["op12_periodic_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) >= 6
    assert QUERIES["op12_periodic_runs"](spark, empty).count() == 0


def test_runs_of_many_shapes(monkeypatch):
    rng, texts = random.Random(3), []
    for _ in range(1500):
        k, w, n = rng.choice((1, 2, 2, 3, 4, 8)), [], rng.randrange(60)
        while len(w) < n:
            block = [b"%d" % rng.randrange(k) for _ in range(rng.randrange(1, 6))]
            w += block * rng.choice((1, 1, 2, 4, 5, 6, 9)) + block[: rng.randrange(len(block) + 1)]
        texts.append(w)
    want = [brute_runs(w) for w in texts]
    assert periodic.runs_of(texts) == want and sum(map(len, want)) > 1000
    assert periodic.runs_of([[b"w"] * 100_000, []]) == [[(0, 100_000, 1)], []]
    assert periodic.runs_of([[b"%d" % (i % 20000) for i in range(100_000)]]) == [[(0, 100_000, 20000)]]


def test_longest_run_is_exact(spark):
    frame = spark.createDataFrame([([(3, 12, 3), (1, 8, 2), (7, 9, 2)],), ([(4, 8, 2), (6, 16, 4)],), ([],)], f"runs {periodic.RUNS}")
    assert [r.best and tuple(r.best) for r in frame.select(periodic.longest("runs").alias("best")).collect()] == [(7, 9, 2), (4, 8, 2), None]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    mates = {w: [x for x in known if near(w, x)] for w in known}
    form = {}
    for w, n in known.items():
        top = min(mates[w], key=lambda x: (-known[x], x), default=None)
        if top is not None and known[top] >= 5 * n:
            form[w] = top
    out = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(mates[w]), known.get(form.get(w))))
    return out


def test_spelling_variants(spark, empty, tmp_path):
    rng = random.Random(11)
    stems = ["harbour", "señorita", "wonderful", "Éclairs×÷", "kingdom", "kingdoms", "ÀÉÎÕÜß", "straßen"]
    pool = []
    for stem in stems:
        for n in (700, 120, 25, 6, 5, 4):
            pool += [stem] * n
            i = rng.randrange(len(stem))
            stem = stem[:i] + rng.choice(["", "q", "ü", stem[i] + "e"]) + stem[i + 1 :]
    pool += ["seldom"] * 4 + ["short"] * 50 + ["LETTERS", "letters", "Letters"] * 8
    rng.shuffle(pool)
    rows = [(i % 40 if i % 7 else None, " ".join(pool[i * 30 : i * 30 + 30]) + rng.choice([".", "9", " Ā "]), *EXTRA) for i in range(len(pool) // 30 + 1)]
    rows += [(5, None, *EXTRA), (None, "", *EXTRA), rows[3]]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = brute_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] > 0 for r in want) > 10
    assert QUERIES["op13_spelling_variants"](spark, empty).count() == 0


@pytest.mark.parametrize("symbols", [1, 4, 64])
def test_near_words_with_any_alphabet(spark, symbols, tmp_path):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(300)}
    spark.createDataFrame([(w, 5) for w in words], "word string, n long").write.parquet(str(tmp_path / "v"))
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(spark.read.parquet(str(tmp_path / "v")), symbols=symbols).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_deletions_are_drawn_by_document(spark):
    runs = ["wonderful"] * 3
    frame = spark.createDataFrame([(i, " ".join(runs)) for i in range(400)], "doc_id long, text string")
    got = Counter(r.word for r in spelling.drawn_words(frame).collect())
    want = Counter()
    for i in range(400):
        h = zlib.crc32(f"{i}:wonderful".encode())
        want["wonderful" if h % 199 else "wonderful"[: h % 9] + "wonderful"[h % 9 + 1 :]] += 3
    assert got == want and len(want) > 1
