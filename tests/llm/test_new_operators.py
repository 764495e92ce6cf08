"""Periodic runs, quality rules and importance resampling against brute force on whole small tables, and odd inputs."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from evigrid.llm import importance_resampling, periodic_runs, quality_rules, queries
from evigrid.llm.common import table

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, clashing columns, periodic words, a long word and a long text."""
    long_ = " ".join(f"w{i % 6000}" for i in range(20_000))
    rows = [(1, None, 9), (2, "", 9), (3, "   \n", 9), (None, "ab " * 30, 9), (4, "same words in both of these rows", 9), (5, "same words in both of these rows", 9), (5, "same words in both of these rows", 9),
            (6, "x" * 3000, 9), (7, "Menu | Home | About | Help\nİstanbul T̈ 中文 ﬁ ends here.\nMenu | Home | About | Help\nAll Rights reserved", 9), (8, "one two", 9), (9, long_, 9), (10, "a b c " * 500 + "\n" + "d e. " * 3, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lines int").selectExpr("*", "1 as n_words", "2 as _words", "3 as score", "'x' as range")


def brute_runs(w, least):
    """All maximal runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(w[i + r:i + length] == w[i:i + length - r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out)


@pytest.mark.parametrize("few", [0, 3, 96])
def test_runs_of_random_words(few, monkeypatch):
    monkeypatch.setattr(periodic_runs, "FEW", few)
    rng = random.Random(few)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 2, 5, 20, 60]), rng.choice([1, 2, 3, 5])
            t = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.4 and n > 6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                t = t[:a] + [t[a + (i - a) % p] for i in range(a, n)]
            texts.append(t)
        least = rng.choice([1, 2, 12])
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least)
        assert list(zip(*(x.tolist() for x in got))) == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, least)]


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    got = periodic_runs.runs_of(np.array(b), np.array([len(b)]), 1)
    assert list(zip(*(x.tolist() for x in got[1:]))) == brute_runs(b, 1)


def expected_runs(doc_id, text, tails):
    w = BLANK.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 12) if n <= 1500 else sparse_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def sparse_runs(words):
    """Long texts: numpy comparison at every distance."""
    codes = np.unique(words, return_inverse=True)[1]
    found = []
    for q in range(1, len(codes) // 2 + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]]).astype(np.int8)
        step = np.diff(same)
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            m = e - s + q
            if m >= max(12, 2 * q) and not any((codes[s + r:s + m] == codes[s:s + m - r]).all() for r in range(1, q)):
                found.append((s, m, q))
    return sorted(found)


def test_periodic_runs_of_documents(spark, data, docs):
    got = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, data).collect()))
    assert got == sorted(expected_runs(r["doc_id"], r["text"], True) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) >= len(got) // 12


def test_periodic_runs_odd(spark, odd, none_docs, monkeypatch):
    want = sorted((expected_runs(r["doc_id"], r["text"], False) for r in odd.collect()), key=repr)
    assert sorted(map(tuple, periodic_runs.periodic_runs(odd).collect()), key=repr) == want
    assert any(r[0] == 9 and r[4] == 6000 for r in want)
    assert periodic_runs.periodic_runs(none_docs).count() == 0


@pytest.fixture(scope="session")
def none_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score double")


def brute_quality(text):
    text = text or ""
    words = BLANK.findall(text)
    grams = collections.defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i:i + 3])].append(i)
    repeat = len({i + s for at in grams.values() if len(at) > 1 for i in at for s in range(3)})
    seen, dup, failed, chars, left, n_lines = set(), 0, 0, 0, 0, 0
    for line in text.split("\n"):
        w = BLANK.findall(line)
        if not w:
            continue
        n_lines += 1
        chars += len(line)
        again = line in seen
        seen.add(line)
        dup += again
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        seps = len(re.findall(quality_rules.SEPARATOR, line))
        marked = sum(bool(re.search(r"[#*$%&|<>]{2}", x)) for x in w)
        shouted = sum("!!" in x for x in w)
        bad = (len(w) < 8 and not re.search(r"""[.!?:;…。！？؟]["'”’»)\]]*[ \x09-\x0D]*\Z""", line)) or (seps > 1 and seps * 4 >= len(w)) or (marked > 0 and marked * 4 >= len(w)) or (shouted > 0 and shouted * 4 >= len(w)) or any(p in low for p in quality_rules.BOILERPLATE)
        if again or bad:
            failed += 1
        else:
            left += len(line)
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, base, not base and 2 * left >= chars, n_lines, failed, chars, left


def test_quality_rules(spark, data, docs):
    got = sorted(map(tuple, queries.QUERIES["op12_quality_rules"](spark, data).collect()))
    assert got == sorted((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    cur = con.execute(queries.ORACLE["op12_quality_rules"])
    assert [c[0] for c in cur.description] == queries.QUERIES["op12_quality_rules"](spark, data).columns
    assert got == sorted(cur.fetchall())


def test_quality_verdict_follows_the_labels(spark, data):
    """Documents labelled good are kept unless the counts reject them, the others go."""
    quality = {r["doc_id"]: r["quality"] for r in table(spark, data, "labels").collect()}
    rows = [r for r in queries.QUERIES["op12_quality_rules"](spark, data).collect() if r["doc_id"] in quality and not r["base_failed"]]
    assert rows and all(r["kept"] == bool(quality[r["doc_id"]]) for r in rows)


def test_quality_odd(spark, odd, none_docs):
    got = sorted(map(tuple, quality_rules.quality(odd).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *brute_quality(r["text"])) for r in odd.collect()), key=repr)
    assert quality_rules.quality(none_docs).count() == 0
    cleaned = {r["doc_id"]: r for r in quality_rules.clean_lines(odd.select("doc_id", "text")).collect()}
    assert cleaned[7]["cleaned"] == "İstanbul T̈ 中文 ﬁ ends here." and cleaned[7]["removed"] == {"navigation": 2, "repeated": 1, "unfinished": 3, "boilerplate": 1}
    assert cleaned[1]["cleaned"] == "" and cleaned[1]["removed"] == {}


def test_checksums_of_joined_parts():
    crc, rng = importance_resampling.Crc32(), random.Random(0)
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + [b"", "é 中文 x".encode(), b"y" * 5000 + b" z y"]
    owner, bucket, sizes = importance_resampling.features(texts + [b" ".join(texts)], crc)
    got = collections.Counter(zip(owner.tolist(), bucket.tolist()))
    assert got == collections.Counter((k, b) for k, t in enumerate(texts + [b" ".join(texts)]) for b in brute_buckets(t))


def brute_buckets(raw):
    w = ALNUM.findall(raw.lower())
    return [zlib.crc32(b" ".join(w[i:i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, items):
    s, t = (collections.Counter(b for x in side for b in brute_buckets((x or "").encode())) for side in ([x for _, x in rows], items))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for doc_id, x in rows:
        b = brute_buckets((x or "").encode())
        w = sum(map(gain, b))
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r, (_, x) in zip(out, rows) if len(ALNUM.findall((x or "").encode().lower())) >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("range_rows", [200_000, 7])
def test_importance_resampling(spark, data, docs, range_rows, monkeypatch):
    real = importance_resampling.drawn_rows
    monkeypatch.setattr(importance_resampling, "drawn_rows", lambda rows, want: real(rows, want, range_rows))
    monkeypatch.setattr(importance_resampling, "RUN_ROWS", 50 if range_rows == 7 else 1 << 20)
    items = [r["text"] for r in table(spark, data, "benchmark").collect()]
    got = importance_resampling.resample(docs.repartition(5), table(spark, data, "benchmark"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_importance_resampling_odd(spark, odd, none_docs):
    many = odd.unionByName(odd.where("doc_id is null or doc_id = 9")).repartition(3)
    got = sorted(map(tuple, importance_resampling.resample(many, odd.select("text")).collect()), key=repr)
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in many.collect()], [r["text"] for r in odd.collect()])
    assert importance_resampling.resample(none_docs, odd).count() == 0
    assert all(r["weight"] is not None for r in importance_resampling.resample(odd, none_docs).collect())


def test_draws_part_ties(spark):
    """A third of the rows share one score, half of these one id too: ranges part them and ranks go on."""
    rows = [(k % 50, 0, k, k) for k in range(400)] + [(7, 0, 1000 + k, 400 + k) for k in range(100)] + [(7, 1, 0, 500 + k) for k in range(100)]
    df = spark.createDataFrame(rows, "down long, none long, doc_id long, row long").repartition(4)
    cuts = importance_resampling.cut_points(df, 600 // 20)
    assert cuts == sorted(cuts, key=lambda c: c + (math.inf,)) and any(len(c) > 3 for c in cuts)
    got = importance_resampling.drawn_rows(df, 250, 20).collect()
    assert [r["row"] for r in sorted(got)] == [r[3] for r in sorted(rows)[:250]]
    assert importance_resampling.drawn_rows(df, 0, 20).count() == 0


def test_tournament_of_runs():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted((rng.randrange(20), j, i) for i in range(rng.randrange(7))) for j in range(k)]
        assert list(importance_resampling.Tournament([iter(r) for r in runs])) == sorted(itertools.chain(*runs))


def test_license_families_and_broken_expressions():
    from evigrid.llm.license_scan import evaluate

    assert evaluate("Apache-2.0") == ({"apache-2"}, True) and evaluate("Apache-1.1 OR Apache-1.0") == ({"apache-1"}, True)
    assert evaluate("MIT AND (") == ({"mit"}, None) and evaluate("MIT OR") == ({"mit"}, None) and evaluate("(MIT AND GPL-2.0-only") == ({"mit", "gpl"}, None)
    assert evaluate("MIT AND (GPL-2.0-only OR BSD-2-Clause)") == ({"mit", "gpl", "bsd"}, True) and evaluate("") == (set(), None) and evaluate("MIT for this file") == ({"mit"}, True)
