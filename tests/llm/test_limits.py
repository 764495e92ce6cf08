"""What operators send to the driver and carry between tasks stays bounded, and results stay whole."""
import collections
import math
import random

import numpy as np
import pytest
import zstandard

from evigrid.llm import elias_fano, lm_scoring, sentencepiece_codec
from evigrid.llm.common import table, tokenizer_path


def test_lm_head_does_not_pass_the_vocabulary_through_the_driver(spark):
    """120,000 words seen once are more than the result limit, in fewer rows a task than HEAD."""
    rng = random.Random(4)
    common = [f"common{i}" for i in range(500)]
    texts = {i: " ".join([*rng.choices(common, k=300), *(f"seenonce{i}x{k}" for k in range(1000))]) for i in range(140)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "3m")
    try:
        rows = lm_scoring.score_documents(docs).collect()
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert len(rows) == 140
    train = collections.Counter(w for r in rows if not r["held_out"] for w in [*texts[r["doc_id"]].split(), " "])
    n, v = sum(train.values()), len(train)
    for r in rows:
        words = [*texts[r["doc_id"]].split(), " "]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (1301, n, sum(w in train for w in words))
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)


@pytest.mark.parametrize("most", [0, 2, 5, 6, 100])
def test_lm_head_is_the_highest_counts(spark, most, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", most)
    rows = [(b"a", 10**10), (b"b", 5000), (b"c", 5000), (b"d", 4999), (b"e", 1), (b"f", 1), (b" ", 7)]
    got = lm_scoring._head(spark.createDataFrame(rows, "word binary, n bigint"))
    want = {0: 0, 2: 1, 5: 4, 6: 6, 100: 6}[most]  # 4,999 has a class of its own or that of 5,000
    assert len(got) == want or most == 2 and len(got) <= 2
    assert got == rows[:len(got)] and all(n > rows[len(got)][1] for _, n in got if len(got) < 6)


def test_lm_sums_come_back_from_their_bytes():
    press = zstandard.ZstdCompressor(level=1)
    for k in (0, 1, 700):
        place = np.sort(np.random.default_rng(k).choice(32_000, k, replace=False))
        one, two = np.arange(k) * 10**11, -np.arange(k)
        for got, want in zip(lm_scoring._unsqueeze(lm_scoring._squeeze(press, place, one, two), 2), (place, one, two), strict=True):
            assert (got == want).all() and len(got) == k


def test_elias_fano_finds_alike_by_few_and_many_queries():
    rng = np.random.default_rng(5)
    for n, top in [(1, 5), (1000, 10**6), (5000, 2**60)]:
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        e = elias_fano.EliasFano.build(v)
        assert (e.whole() == v).all()
        q = rng.permutation(np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 5, 300).astype(np.uint64)]))
        at = np.searchsorted(v, q)
        want = np.where(v[np.minimum(at, len(v) - 1)] == q, at, -1)
        assert (e.find(q) == want).all() and all((e.find(q[i:i + 1]) == want[i:i + 1]).all() for i in range(0, len(q), 97))


ODD = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", " a   b  ", "a\nb c\n", "▁", "a▁ b", "▁▁a", "日本 語́ 😀", "x\ty \x00z", "<0x41> <s> ⁇ </s>"]


def test_codec_words_and_rows():
    model = sentencepiece_codec.Model(tokenizer_path("piece_bpe_32k.model"))
    for prefix in (True, False):
        model.prefix = prefix
        for t in ODD:
            assert [("▁" if prefix else "") + w for w in sentencepiece_codec.word_keys(model, t)] == sentencepiece_codec.marked_words(model, t)
        rng = random.Random(7)
        some = [*model.byte.values(), *range(40), *(model.id_list("▁") * 20)]
        rows = [[], *([rng.choice(some) for _ in range(rng.randrange(1, 6))] for _ in range(3000)), [model.byte[b] for b in "▁é😀".encode()]]
        flat, ends = np.array([9, *(i for r in rows for i in r), 9], np.int32), np.cumsum([1, *map(len, rows)]).astype(np.int32)
        assert sentencepiece_codec.decode_rows(model, flat, ends) == [sentencepiece_codec.decode(model, r).encode() for r in rows]


def test_codec_work_is_by_new_words_and_whole_batches(spark, data, monkeypatch):
    """Byte pieces (line ends) are decoded with their batch; pairs of pieces are merged once."""
    import pyarrow as pa

    texts = [r["text"] or "" for r in table(spark, data, "documents").select("text").limit(300).collect()]
    assert any("\n" in t for t in texts)
    path = tokenizer_path("piece_bpe_32k.model")
    sentencepiece_codec._MODELS.pop(path, None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(texts)], ["doc_id", "text", "_text"])
    done = list(sentencepiece_codec._encode(path, ["doc_id", "text"])(iter([batch])))
    merges, merge = [], sentencepiece_codec.Model.merge
    monkeypatch.setattr(sentencepiece_codec.Model, "merge", lambda self, s: merges.append(s) or merge(self, s))
    monkeypatch.setattr(sentencepiece_codec, "decode", lambda *_: pytest.fail("a row was decoded piece by piece"))
    again = list(sentencepiece_codec._encode(path, ["doc_id", "text"])(iter([batch])))
    assert not merges and again[0].column("ids").equals(done[0].column("ids"))
    assert all(r for b in sentencepiece_codec._digest(path)(iter(done)) for r in b.column("round_trip").to_pylist())
