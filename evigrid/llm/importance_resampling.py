"""Target-distribution importance resampling: hashed runs of words, array-scored weights, exact draws.

Two passes over the texts: one counts the features of both sides by bucket, the other sums each document's
gains from an array of all buckets. A score is a weight plus noise that is fixed by the document's id, so
the highest scores are a draw without replacement. Each task sorts its eligible rows to runs; ranges of
scores, bounded in rows, are dealt to tasks with a slice of every run each, and a tournament tree merges a
range's slices. Ranges below the draw's last row are not merged, and its own merge stops there.
"""
import bisect
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Numbers, as_bytes, small_batches, stored

BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
#: Rows that a range of scores has on average; a range's task holds its slices of runs in memory.
RANGE_ROWS = 200_000
#: Rows that a task sorts at once.
RUN_ROWS = 1 << 20
#: Words whose features are hashed together.
BLOCK_WORDS = 200_000
WORD = re.compile(ALNUM)
SPACE = zlib.crc32(b" ")


class Crc32:
    """CRC-32 of joined strings from those of their parts, for whole arrays.

    crc(x + y) = shift(crc(x), len(y)) xor crc(y), where shift carries a checksum over len(y) zero bytes;
    it is linear, so four look-ups by byte do it. The table of a length is made once a task.
    """

    def __init__(self):
        self.tables = {}

    def table(self, n: int) -> np.ndarray:
        """4 x 256: what each byte of a checksum becomes after n zero bytes."""
        if n not in self.tables:
            base = zlib.crc32(bytes(n))
            bits = np.array([zlib.crc32(bytes(n), 1 << k) ^ base for k in range(32)], np.uint32)
            t = np.zeros((4, 256), np.uint32)
            for k in range(32):
                t[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, bits[k], np.uint32(0)).astype(np.uint32)
            self.tables[n] = t
        return self.tables[n]

    def joined(self, x: np.ndarray, y: np.ndarray, y_size: np.ndarray, of: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The checksum of what has x followed by what has y; of: each y's length as a row of tables."""
        out = y.copy()
        for k in range(4):
            out ^= tables[of, k, x >> np.uint32(8 * k) & np.uint32(255)]
        return out


def features(texts: list, crc: Crc32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, bucket of every feature (runs of one to three words, joined by a space), and each text's number of words."""
    seen, parts = Numbers(), []
    for t in texts:
        parts.append(seen.of(WORD.findall(t.lower())))
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    vocabulary = list(seen)
    one = np.array([zlib.crc32(w) for w in vocabulary], np.uint32)
    led = np.array([zlib.crc32(w, SPACE) for w in vocabulary], np.uint32)  # a space before it
    lengths, of = np.unique(np.array([len(w) + 1 for w in vocabulary], np.int64), return_inverse=True)
    tables = np.stack([crc.table(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
    text = np.repeat(np.arange(len(texts)), sizes)
    out, owner, last = [one[words]], [text], one[words]
    for n in (1, 2):  # one word more
        inside = text[n:] == text[:-n] if len(text) > n else np.zeros(0, bool)
        tail = words[n:]
        last = crc.joined(last[:-1], led[tail], lengths, of[tail], tables) if len(tail) else last[:0]
        out.append(last[inside])
        owner.append(text[n:][inside])
    return np.concatenate(owner), (np.concatenate(out) % np.uint32(BUCKETS)).astype(np.int64), sizes


def _blocks(batches, n_columns: int):
    """Lists of leading columns and texts, of bounded size; the text is the last column."""
    held, texts, size = [[] for _ in range(n_columns)], [], 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(n_columns)]
        for k, text in enumerate(as_bytes(batch.column(n_columns))):
            for h, c in zip(held, columns):
                h.append(c[k])
            texts.append(text)
            size += len(text)
            if size > 6 * BLOCK_WORDS:
                yield held, texts
                held, texts, size = [[] for _ in range(n_columns)], [], 0
    if texts:
        yield held, texts


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: features of all texts by bucket; buckets without any have no row.

    Each task adds up an array of all buckets, so at most that many rows a task are shuffled.
    """

    def count(batches):
        crc, n = Crc32(), np.zeros(BUCKETS, np.int64)
        for _, texts in _blocks(batches, 0):
            n += np.bincount(features(texts, crc)[1], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain in thousandths, from two tables of bucket and n (at most BUCKETS rows each)."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for side, rows in ((s, source), (t, target)):
        for r in rows.collect():
            side[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id) -> int:
    """The document's own Gumbel noise in thousandths."""
    h = int(hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of docs."""

    def weigh(batches):
        crc = Crc32()
        for (ids,), texts in _blocks(batches, 1):
            text, bucket, sizes = features(texts, crc)
            weight = np.zeros(len(texts), np.int64)
            np.add.at(weight, text, gain[bucket])
            score = weight + np.array([noise(i) for i in ids], np.int64)
            n = np.maximum(sizes, 0) + np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


class Tournament:
    """A tree of losers over sorted runs: what comes first of all, with one comparison a level."""

    def __init__(self, runs: list):
        """runs: iterators over comparable keys, each in ascending order."""
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.loser = [0] * self.k
        self.winner = self._play(1)

    def _beats(self, x: int, y: int) -> bool:
        a, b = self.head[x], self.head[y]
        return b is None or (a is not None and (a, x) <= (b, y))

    def _play(self, node: int) -> int:
        """Winner below node, from the bottom; nodes from k on are the runs. Losers stay in their node."""
        won = [0] * self.k + list(range(self.k))
        for at in range(self.k - 1, node - 1, -1):
            x, y = won[2 * at], won[2 * at + 1]
            if not self._beats(x, y):
                x, y = y, x
            won[at], self.loser[at] = x, y
        return won[node] if self.k > 1 else 0

    def __iter__(self):
        while self.head[self.winner] is not None:
            first = self.winner
            yield self.head[first]
            self.head[first] = next(self.runs[first], None)
            at = (first + self.k) // 2
            while at >= 1:
                if not self._beats(first, self.loser[at]):
                    first, self.loser[at] = self.loser[at], first
                at //= 2
            self.winner = first


KEYS = ["down", "none", "doc_id", "row"]


def cut_points(rows: DataFrame, n: int, columns: tuple = tuple(KEYS)) -> list[tuple]:
    """Up to n - 1 ascending keys that part rows to shares of about the same size, from sketches.

    A value that several shares begin with is parted by the columns after it, so that ties are parted too.
    """
    if n < 2 or not columns:
        return []
    found = rows.agg(F.percentile_approx(columns[0], [k / n for k in range(1, n)], 10 * n)).collect()[0][0] or []
    out = []
    for value in sorted(set(found)):
        times = found.count(value)
        inner = cut_points(rows.where(F.col(columns[0]) == value), times + 1, columns[1:]) if times > 1 else []
        out += [(value, *rest) for rest in inner] + [(value,)]
    return out


def sorted_runs(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """range, n, run: each task's rows sorted, RUN_ROWS at a time, cut where ranges end, packed."""
    ends = [c + (math.inf,) for c in cuts]  # a cut's own rows belong before it

    def cut(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def pack(held):
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in range(4)]
        packed = np.stack(columns)[:, np.lexsort(columns[::-1])].astype("<i8")
        key = lambda k: tuple(packed[:, k].tolist())
        at = [0, *(bisect.bisect_right(range(packed.shape[1]), e, key=key) for e in ends), packed.shape[1]]
        some = [k for k in range(len(at) - 1) if at[k] < at[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([at[k + 1] - at[k] for k in some], pa.int64()), pa.array([packed[:, at[k]:at[k + 1]].tobytes() for k in some], pa.binary())], ["range", "n", "run"])

    return rows.select(*KEYS).mapInArrow(cut, "range int, n bigint, run binary")


def drawn_rows(rows: DataFrame, want: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rank, row of the `want` first rows(down, none, doc_id, row) in the order of these columns.

    rows is stored. Its sorted runs are stored too; ranges before the draw's last row are merged, a task
    each, and their ranks begin after the rows of the ranges before them. No rows, or want 0, give none.
    """
    cuts = cut_points(rows, min(10_000, rows.count() // range_rows))
    runs = stored(sorted_runs(rows, cuts), "runs")
    counts = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most a row a range
    before, at = {}, 0
    for k in range(len(cuts) + 1):
        if at < want:
            before[k] = at
        at += counts.get(k, 0)

    def merge(key, held):
        first = before[key[0].as_py()]
        slices = [zip(*np.frombuffer(r, "<i8").reshape(4, -1).tolist()) for r in held.column("run").to_pylist()]
        drawn = [row for *_, row in itertools.islice(Tournament(slices), want - first)]
        return pa.table({"rank": pa.array(range(first + 1, first + 1 + len(drawn)), pa.int64()), "row": pa.array(drawn, pa.int64())})

    needed = runs.where(F.col("range") <= max(before, default=-1))
    return needed.groupBy("range").applyInArrow(merge, "rank bigint, row bigint")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where it is not drawn.

    Drawn are per_cent of the rows of at least least_words words, rounded down, of highest score; ties go
    to the smaller doc_id, a null one last (its noise is that of the word null), then to one of the rows
    that are alike. Null and empty texts have no features and weight 0. Repeated rows count each, in the
    corpus and in the draw. An empty target or corpus has no features. Texts are taken whole: a long one
    is hashed at once, at some 60 bytes a word. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = stored(weighed(docs, gain).withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("bigint").alias("none"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("doc_id"), "row")
    ranks = drawn_rows(eligible, eligible.count() * per_cent // 100)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
