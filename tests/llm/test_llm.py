"""Each operator against a brute-force version on whole small tables, and odd inputs."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evigrid.llm import (chat, components, decontamination, elias_fano, license_scan, lm_scoring, minhash, queries, sentencepiece_codec, sharding, token_counts, toxicity,
                         vector_dedup)
from evigrid.llm.common import table, tokenizer_path

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").encode().lower()


@pytest.fixture(scope="session")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, a clashing column, a special string, a long word and a long text."""
    rows = [(1, None, "en", 9), (2, "", "en", 9), (3, "   \n", None, 9), (None, "no id at all here", "en", 9), (4, "same words in both of these rows", "en", 9), (5, "same words in both of these rows", "en", 9), (5, "same words in both of these rows", "en", 9),
            (6, "x" * 3000, "en", 9), (7, "a<|endoftext|>b İstanbul T̈ 中文 ﬁ", "en", 9), (8, "one", "en", 9), (9, " ".join(f"w{i % 700}" for i in range(20_000)), "en", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_elias_fano_and_successors():
    rng = np.random.default_rng(0)
    for n, top in [(0, 1), (1, 5), (10, 3), (1000, 10**6), (5000, 2**60)]:
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = elias_fano.EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        if n:
            q = np.concatenate([v, rng.integers(0, top + 5, 300).astype(np.uint64)])
            assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie_sums_to_one():
    rng = np.random.default_rng(1)
    c, b, w = (rng.zipf(1.4, 5000) % k for k in (20, 30, 60))
    h = lambda x: np.uint64(0x9E3779B97F4A7C15) * (np.asarray(x).astype(np.uint64) + np.uint64(7))
    t = elias_fano.NGramTrie(elias_fano.NGramTrie.build(h(c), h(b), h(w)))
    for ctx, before in [(1, 1), (3, 29), (77, 2)]:
        total = t.probabilities(h(np.full(60, ctx)), h(np.full(60, before)), h(np.arange(60)), np.full(60, 1 / 60)).sum()
        assert 0.99 < total <= 1.0001


@pytest.mark.parametrize("head", [65_536, 300])
def test_lm_base_and_gain(docs, texts, head, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    toks = {i: BLANK.findall(low(t)) + [b" "] for i, t in texts.items()}
    train = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    rows = lm_scoring.score_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * (1.0 if head > 1000 else 1.2)


def test_lm_scores_do_not_depend_on_the_head(docs, monkeypatch):
    """A tail word has its own unigram probability, so a broadcast head is only a way to reach it."""
    got = []
    for head in (65_536, 300):
        monkeypatch.setattr(lm_scoring, "HEAD", head)
        got.append(sorted((r["doc_id"], round(r["score"], 6)) for r in lm_scoring.score_documents(docs).collect()))
    assert got[0] == got[1]


def brute_lm(texts, split_at):
    """Scores by plain counting of words, pairs and threes over all texts of the training folds."""
    toks = {i: BLANK.findall(low(t)) + [b" "] for i, t in texts.items()}
    train = {i: t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    uni = collections.Counter(w for t in train.values() for w in t)
    n, n_docs = sum(uni.values()), len(train)
    once = sum(c == 1 for c in uni.values())
    spelling = np.zeros(lm_scoring.CONTEXTS * lm_scoring.SYMBOLS, np.int64)
    steps, _ = lm_scoring._spelling_steps(list(uni))
    np.add.at(spelling, steps, 1)
    floor = lm_scoring.Floor([(b" ", n_docs)], spelling, n, len(uni), once)
    unseen = sorted({w for t in toks.values() for w in t if w not in uni})
    spelt = dict(zip(unseen, floor.spelt(unseen).tolist()))
    q = lambda w: min(255, round(-math.log10(uni[w] * floor.scale) * 16)) if w in uni else spelt[w]
    hash_ = lm_scoring.xxhash.xxh3_64_intdigest

    def places(t):
        for k, w in enumerate(t):
            v, u = (t[k - 1] if k else None), (t[k - 2] if k > 1 else None)
            klass = (hash_(u if u is not None else b"  ") >> 20) % max(1, -(-uni[v] // split_at)) if v is not None else None
            yield u, (v, klass), w

    two, three, c2, c3, k2, k3 = (collections.Counter() for _ in range(6))
    for t in train.values():
        for u, v, w in places(t):
            k2[v] += not two[v, w]
            k3[u, v] += not three[u, v, w]
            two[v, w] += 1
            three[u, v, w] += 1
            c2[v] += 1
            c3[u, v] += 1
    out = {}
    for i, t in toks.items():
        total = 0.0
        for u, v, w in places(t):
            p = 10 ** (-q(w) / 16)
            if v[0] is None:
                p = (two[v, w] + 100 * p) / (n_docs + 100)
            elif c2[v]:
                p = (max(two[v, w] - 0.75, 0) + 0.75 * k2[v] * p) / c2[v]
                if c3[u, v]:
                    p = (max(three[u, v, w] - 0.75, 0) + 0.75 * k3[u, v] * p) / c3[u, v]
            total += math.log10(p)
        out[i] = total
    return out, toks


@pytest.mark.parametrize("split_at", [100_000, 300])
def test_lm_score_equals_counting(docs, texts, split_at):
    want, toks = brute_lm(texts, split_at)
    for r in lm_scoring.score_documents(docs, split_at).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 0.001 * len(toks[r["doc_id"]]) + 1e-6  # the codes' steps


def test_lm_scores_do_not_depend_on_partitions_or_rows(spark, docs):
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, dealt in ((4, docs), (64, docs.orderBy("doc_id")), (150, docs.repartition(7, "text"))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted((r["doc_id"], round(r["score"], 6)) for r in lm_scoring.score_documents(dealt).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_lm_equal_texts_score_alike_when_the_start_is_split(spark):
    rng = random.Random(6)
    rows = [(i, f"first{rng.randrange(30)} then") for i in range(3000)]
    scores, texts = collections.defaultdict(set), dict(rows)
    for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 40).collect():
        scores[texts[r["doc_id"]]].add(round(r["score"], 6))
    assert all(len(s) == 1 for s in scores.values())


def test_trie_parts_are_shares_of_the_whole():
    h = lambda x: np.uint64(0x9E3779B97F4A7C15) * (np.asarray(x).astype(np.uint64) + np.uint64(7))
    word, total = np.arange(4000) % 40, 0.0
    for part in (0, 1):  # even words in one part, odd words in the other
        mine = word % 2 == part
        ctx = lambda n: h(np.full(n, 100 + part))  # noqa: B023, E731
        t = elias_fano.NGramTrie(elias_fano.NGramTrie.build(ctx(2000), h(np.full(2000, 90)), h(word[mine]), h([100, 101]), 4000))
        total += t.probabilities(ctx(20), h(np.full(20, 90)), h(np.arange(part, 40, 2)), np.full(20, 1 / 40)).sum()
    assert 0.99 < total <= 1.0001


def test_lm_odd_rows(odd, none):
    rows = lm_scoring.score_documents(odd).collect()
    assert len(rows) == 11 and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 1
    assert lm_scoring.score_documents(none).count() == 0


def brute_hits(texts, items):
    win = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            win[tuple(w[s:s + k])].add(str(i))
    out = {}
    for d, t in texts:
        w, hit, got = ALNUM.findall(low(t)), set(), set()
        for k in {len(x) for x in win}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in win:
                    hit |= set(range(s, s + k))
                    got |= win[tuple(w[s:s + k])]
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, data, docs, texts):
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    want = brute_hits(texts.items(), items)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.decontaminate(docs, table(spark, data, "benchmark")).collect()}
    assert got == want and any(x[4] for x in want.values())


def test_decontamination_of_repeated_and_shared_words(spark):
    """Windows whose rarest words repeat within an item, stand at several places, or are one word."""
    rng = random.Random(12)
    texts = {i: " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(0, 60))) for i in range(150)}
    items = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 12, 14, 30])] + [(20 + i, texts[i * 7][:40]) for i in range(10)]
    want = brute_hits(texts.items(), items)
    d, q = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in decontamination.decontaminate(d, q).collect()} == want


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "both of these"), (3, None), (4, ""), (2, "both of these"), (None, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(odd, items).collect()}
    assert got[5]["n_hit"] == 3 and got[5]["n_items"] == 1 and got[8]["n_hit"] == 1 and got[8]["n_items"] == 0 and got[1]["n_words"] == 0
    assert got[9]["n_hit"] == sum(1 for i in range(20_000) if 1 <= i % 700 <= 11)
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(odd, items.where("item_id > 99")).where("contaminated").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta"), (3, "gamma " + "z " * 40 + "alpha beta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "beta gamma alpha")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.proximity_hits(d, q, 2).collect()} == {1}


def test_toxicity_learns(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        t = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            t[rng.randrange(60)] = rng.choice(["nasty", "vile", "awful"])
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(bad), 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.score_toxicity(d, lab).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1600 and held
    wrong = sum(r["predicted"] != int(r["doc_id"] % 6 == 0) for r in held)
    assert wrong <= 0.02 * len(held)


def test_toxicity_risk_and_gradient():
    """The risk against plain sums, its gradient against differences, the bias against the prior."""
    rng = np.random.default_rng(5)
    pos, unl = ([rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(n)] for n in (7, 11))
    xp, xu = (toxicity.Rows(d, np.arange(6)) for d in (pos, unl))
    w = rng.normal(size=7)
    f = lambda d, w: sum(w[i] for i in d) + w[6]
    loss = lambda z: math.log(1 + math.exp(-z))
    plus, minus, up, down = toxicity.risk(w, xp, xu, 0.2)
    assert plus == pytest.approx(0.2 * sum(loss(f(d, w)) for d in pos) / 7)
    assert minus == pytest.approx(sum(loss(-f(d, w)) for d in unl) / 11 - 0.2 * sum(loss(-f(d, w)) for d in pos) / 7)
    for i in range(7):
        e = np.eye(7)[i] * 1e-6
        a, b = toxicity.risk(w + e, xp, xu, 0.2), toxicity.risk(w - e, xp, xu, 0.2)
        assert up[i] == pytest.approx((a[0] - b[0]) / 2e-6, abs=1e-6) and down[i] == pytest.approx((a[1] - b[1]) / 2e-6, abs=1e-6)
    scores = rng.normal(size=500) * 4
    assert (1 / (1 + np.exp(-scores - toxicity.settled_bias(scores, 0.07))) >= 0.3).mean() == pytest.approx(0.07)
    tied = np.repeat([0.0, 3.0], [90, 10])  # no bias parts equal scores
    assert (1 / (1 + np.exp(-tied - toxicity.settled_bias(tied, 0.12))) >= 0.3).mean() == 0.1
    assert (1 / (1 + np.exp(-toxicity.settled_bias(np.zeros(5), 0.1)))) < 0.3


def test_toxicity_weighs_every_selected_feature():
    rng = np.random.default_rng(3)
    marks = np.arange(100_000, 104_000)
    pos = [np.sort(f) for _ in range(30) for f in np.array_split(rng.permutation(marks), 67)]
    unl = [np.sort(rng.choice(5000, 60, replace=False)) for _ in pos]
    kept = toxicity.select_features(pos, unl)
    weights, _ = toxicity.fit_nnpu(pos, unl, 0.3)
    assert len(kept) > 3900 and (weights[kept] > 0).all()


def test_toxicity_odd(spark, odd, none):
    lab = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, lab).count() == 11
    assert toxicity.score_toxicity(odd, lab.where("toxic = 7")).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, lab).count() == 0


def test_codec_equals_the_library(docs, texts, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for df in (docs, odd):
        want = collections.Counter((r["doc_id"], tuple(lib.encode(r["text"] or ""))) for r in df.collect())
        got = sentencepiece_codec.encode_documents(df)
        assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == want
        back = collections.Counter((r["doc_id"], r["text"]) for r in sentencepiece_codec.decode_documents(got).collect())
        assert back == collections.Counter({(d, lib.decode(list(ids))): n for (d, ids), n in want.items()})
    assert sentencepiece_codec.encode_documents(none).count() == 0


def test_unigram_viterbi_is_the_best_sum():
    m = sentencepiece_codec.Model(tokenizer_path("piece_bpe_32k.model"))
    m.unigram = True
    word = "▁there"
    ids = dict(sentencepiece_codec.encode_sorted(m, [word]))[word]
    best = {0: 0.0}
    for e in range(1, len(word) + 1):
        best[e] = max(best[s] + m.scores[m.ids[word[s:e]]] for s in range(e) if word[s:e] in m.ids and s in best)
    assert sum(m.scores[i] for i in ids) == pytest.approx(best[len(word)])


def test_license_places(docs, texts, odd, none):
    base = {k.encode(): v for k, v in license_scan.BASE.items()}
    for r in license_scan.scan_licenses(docs).collect():
        w = ALNUM.findall(low(texts[r["doc_id"]]))
        at = [(i, v) for p, v in base.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in at})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan_licenses(odd).count() == 11 and license_scan.scan_licenses(none).count() == 0


def test_license_expressions():
    assert license_scan.postfix("MIT OR Apache-2.0 AND (GPL-2.0 WITH Classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert license_scan.evaluate("GPL-3.0-only OR MIT") == ({"gpl", "mit"}, True)
    assert license_scan.evaluate("GPL-3.0-only AND MIT") == ({"gpl", "mit"}, False)
    for bad in ("", "AND", "( MIT", ")", "MIT MIT", "OR MIT", "MIT AND"):
        license_scan.evaluate(bad)
    a = license_scan.automaton()
    n, k, first, last, base, labels, score, found, free = license_scan.scan_text(a, b"Under the MIT License\nSPDX-License-Identifier: (MIT OR Apache-2.0)\nunder the mit license")
    assert (k, first, last, base, labels, free) == (2, 0, 12, "mit", "apache-2,mit", True)


def test_license_families_and_brute_labels():
    """Identifiers by family; labels and scores of texts against looking for every phrase at every word."""
    for name, label in (("gpl-2.0+", "gpl"), ("bsd-3-clause-clear", "bsd"), ("cc-by-nc-sa-4.0", "cc-by-nc"), ("cc-by-sa-3.0", "cc-by-sa"), ("eupl-1.2", "eupl"), ("gpl-9.9", None), ("mitt", None)):
        assert license_scan.label_of(name) == label
    a, rng = license_scan.automaton(), random.Random(3)
    phrases = {**license_scan.BASE, **license_scan.NOTICES}
    pool = sorted({w for p in phrases for w in p.split()})
    for _ in range(200):
        parts = [rng.choice([rng.choice(list(phrases)), rng.choice(pool), rng.choice(pool)]) for _ in range(12)]
        words = " ".join(parts).split()
        want = {v for p, v in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()}
        *_, labels, score, _, _ = license_scan.scan_text(a, " ".join(words).upper().encode())
        assert set(filter(None, labels.split(","))) == want and 0 <= score <= 1 and (score > 0) == bool(want)


def test_license_expressions_are_read_whole():
    a = license_scan.automaton()
    text = "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 60 + ["GPL-3.0-only"])
    *_, labels, _, found, free = license_scan.scan_text(a, text.encode())
    assert (labels, found, free) == ("gpl,mit", [text.partition(": ")[2]], False)
    *_, labels, _, found, free = license_scan.scan_text(a, b"Licence-Identifier: ISC")
    assert (labels, found, free) == ("isc", ["ISC"], True)


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(20):
        supply = [rng.randrange(30) for _ in range(4)]
        cap = [rng.randrange(10, 30) for _ in range(5)]
        if sum(supply) > sum(cap):
            continue
        f = sharding.min_cost_flow(supply, cap, lambda i, j: int(i != j))
        assert [sum(f.get((i, j), 0) for j in range(5)) for i in range(4)] == supply
        assert all(sum(f.get((i, j), 0) for i in range(4)) <= c for j, c in enumerate(cap))
        assert sum(x for (i, j), x in f.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, cap))


def test_resharding(docs, texts, odd, none):
    rows = sharding.reshard(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    assert len(sharding.reshard(odd).collect()) == 11 and sharding.reshard(none).count() == 0


def test_rewrite_touches_moved_shards_only(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    plan = spark.createDataFrame([(i, i % 3, 1 if i == 0 else i % 3) for i in range(6)], "doc_id long, old_shard int, shard int")
    touched = {r[0] for r in sharding.rewrite_affected(d, plan, ["doc_id"], str(tmp_path / "out")).collect()}
    assert touched == {0, 1} and spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_rewrite_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, f"n{i % 3}") for i in range(9)] + [(7, f"r{i % 4}") for i in range(40)] + [(i, f"t{i}") for i in range(100, 160)] + [(8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plan = sharding.reshard(d, 5, 4)
    touched = {r[0] for r in sharding.rewrite_affected(d, plan, ["doc_id"], str(tmp_path / "out")).collect()}
    want = collections.Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in plan.collect() if r["shard"] in touched)
    got = collections.Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(touched) > 1


def test_vectors(spark, data):
    e = table(spark, data, "embeddings").collect()
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in e]
    base = np.array(rows[0][1])
    rows += [(10_000 + i, (base + rng.normal(scale=0.02, size=len(base)) * np.linalg.norm(base) / 8).tolist(), 3) for i in range(600)]
    rows += [(20_000, rows[1][1], rows[1][2]), (20_001, None, 1), (20_002, [0.0] * 64, 1), (20_003, [float("nan")] + [1.0] * 63, 1), (20_004, rows[1][1], None), (20_005, [1.0, 2.0], 1), (20_006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 64 and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([np.float32(r[1]) for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[r[0]]["n_links"] != n for r, n in zip(good, link.sum(1)))
    assert wrong <= 0.01 * len(good)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (20_001, 20_002, 20_003, 20_004, 20_005, 20_006))
    assert got[20_000]["component_id"] == min(20_000, rows[1][0])


def test_vectors_recall_and_repeats(spark):
    """Links found against all pairs where a label needs bits and passes; repeated ids keep their own links."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 24))
    x = np.concatenate([base[rng.integers(0, 500, 5000)] + rng.normal(scale=0.07, size=(5000, 24)), rng.normal(size=(1500, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = link.sum(1)
    assert want.sum() > 4000 and all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.999 * want.sum()
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    more = [(5, a, 1, "x"), (6, [1.0, 0.01, 0.0], 1, "x"), (7, a, 1, "x"), (5, b, 1, "x"), (5, c, 1, "x"), (3, [0.0, 0.01, 1.0], 1, "x"), (None, a, 1, "x")]
    df = spark.createDataFrame(more, "vec_id long, embedding array<double>, label int, code string")
    assert sorted(map(tuple, vector_dedup.near_vectors(df).where("vec_id is not null").collect())) == [(3, 1, 3, True), (5, 0, 5, True), (5, 1, 3, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False)]
    assert vector_dedup.near_vectors(df.where("vec_id > 99")).count() == 0


def test_token_counts(docs, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for df in (docs, odd):
        rows = df.collect()
        n = [len(x.ids) for x in lib.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), k, k > 2048) for r, k in zip(rows, n))
        assert collections.Counter(map(tuple, token_counts.count_tokens(df).collect())) == want
    assert token_counts.count_tokens(none).count() == 0


def test_chat_round_trip(spark, data):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, data, "conversations").collect()]
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST\\]", "<s>[INST]a\nb", None, "", "[/INST]</s>\\"]
    rows += [(-7, i, role, t) for i, t in enumerate(nasty) for role in ("user", "assistant")] + [(-8, None, None, "x"), (-8, 0, "a\nb\\", "y"), (-8, 0, "a\nb\\", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collections.defaultdict(list)
    for c, t, role, x in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", x or ""))
    for r in chat.digests(chat.render(chat.message_events(df))).collect():
        w = want.pop(r["conv_id"])
        loss = "".join(t for role, t in w if role == "assistant")
        assert r["n_turns"] == len(w) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in w).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not want


def test_chat_log_is_edited_regenerated_and_unordered(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day")], "conv_id long, turn long, role string, text string")
    log = chat.message_events(df).orderBy("message").collect()
    assert {r["kind"] for r in log} == {"start", "delta", "edit"} and {r["version"] for r in log if r["message"] == 1} == {0, 1} and [r["seq"] for r in log if r["message"] == 0] != [0, 1, 2, 3]
    assert [chat.read_turn(r["segment"]) for r in chat.render(chat.message_events(df)).orderBy("turn").collect()] == [("user", "hello there"), ("assistant", "good day")]
    none = df.where("conv_id > 9")
    assert chat.digests(chat.render(chat.message_events(none))).count() == 0


def test_chat_edits_and_regenerations(spark):
    ev = [(1, 0, 0, 0, "start", "user"), (1, 0, 0, 1, "delta", "hel"), (1, 0, 0, 2, "delta", "lo"), (1, 1, 0, 0, "start", "assistant"), (1, 1, 0, 1, "delta", "bad"), (1, 1, 1, 2, "delta", "go"), (1, 1, 1, 3, "delta", "od"), (1, 2, 0, 0, "start", "user"), (1, 2, 0, 1, "delta", "x"), (1, 2, 0, 2, "edit", "new"), (1, 2, 0, 3, "delta", "!")]
    df = spark.createDataFrame(ev, "conv_id long, message long, version long, seq long, kind string, body string")
    got = [chat.read_turn(r["segment"]) for r in chat.render(df).orderBy("turn").collect()]
    assert got == [("user", "hello"), ("assistant", "good"), ("user", "new!")]


def brute_components(texts, size, part):
    sets = {}
    for i, t in texts.items():
        w = BLANK.findall(low(t))
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inv = collections.defaultdict(list)
    for i, s in sets.items():
        for y in s:
            inv[y].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for y in s for j in inv[y] if j < i).items():
            if 100 * n >= part * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,part", [(3, 85), (5, 80)])
def test_minhash(spark, texts, size, part):
    rng = random.Random(size)
    all_texts = dict(texts)
    source = " ".join(f"q{rng.randrange(900)}" for _ in range(160)).split()
    for i in range(400):  # a large group of copies with a few edits each
        w = list(source)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
        all_texts[100_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(all_texts.items()), "doc_id long, text string")
    want = brute_components(all_texts, size, part)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size, part).collect()}
    assert got == want


def test_minhash_odd(odd, none):
    rows = minhash.near_duplicates(odd, 3, 85).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and got[5]["component_id"] == 4 and got[1]["component_id"] == 1 and got[1]["n_shingles"] == 0 and got[None]["component_id"] is None
    assert minhash.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(9)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1, 1), (None, 3)] + [(i, i + 1) for i in range(400, 440)]
    up = {x: x for p in e for x in p if x is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    linked = {x for a, b in e if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_pipeline(spark, data, docs, texts):
    import corpus_pipeline as p

    d = docs
    for name, stage in p.STAGES[:-1]:
        before = d.count()
        d = stage(spark, d, data)
        assert d.columns == docs.columns and 0 < d.count() <= before
    assert d.join(p.drop_near_duplicates(spark, d, data), "doc_id", "left_anti").count() == 0
    kept = {r["doc_id"]: r["text"] for r in d.collect()}
    assert not any(x[4] for x in brute_hits(kept.items(), [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]).values())
    out = p.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == set(kept) and all(len(r["ids"]) == r["n_pieces"] for r in out)


def test_minhash_ties_classes_of_one_id(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (3, text), (5, "another text of quite other words altogether"), (6, "another text of quite other words altogether"), (9, "z y x w v")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (6, 3, False), (9, 9, True)]


def test_pipeline_stages_on_odd_rows(spark, data, odd, none):
    import corpus_pipeline as p

    wide = odd.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(1 as bigint) as n_chars", "'clash' as k", "1 as score", "2 as kept")
    toxic = p.drop_toxic(spark, wide, data)
    assert toxic.columns == p.COLUMNS and toxic.count() == 11
    near = p.drop_near_duplicates(spark, wide, data)
    assert near.columns == p.COLUMNS and sorted(r["doc_id"] or -1 for r in near.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9]
    twice = wide.unionByName(wide)
    assert sorted(r["doc_id"] or -1 for r in p.drop_near_duplicates(spark, twice, data).collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert p.drop_contaminated(spark, wide, data).count() == 11 and p.encode(spark, wide, data).count() == 11
    for _, stage in p.STAGES:
        assert stage(spark, none, data).count() == 0


def test_all_are_registered():
    assert sorted({n.split("_")[0] for n in queries.QUERIES}) == sorted(f"op{i}" for i in range(1, 14))
