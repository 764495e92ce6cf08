"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that labels marks toxic, unlabelled are the fold's documents at large.
Numpy models over hashed words minimise prior * loss+(positives) + max(0, loss-(unlabelled) -
prior * loss-(positives)); several members, each on its own bounded sample, are averaged.
"""
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, small_batches

BITS = 18
#: Bound of a member's sample: so many positive documents, the same for all members, and so many
#: unlabelled ones of its own, on average.
POSITIVES, UNLABELLED, MEMBERS = 6000, 6000, 3
THRESHOLD = 0.3
_WORD = re.compile(ALNUM)


class Features(dict):
    """Word bytes to a hashed feature number, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word) >> (32 - BITS)
        return h

    def of(self, raw: bytes) -> list:
        return list({self[w] for w in set(_WORD.findall(raw.lower()))})


def _features(batches):
    seen = Features()
    for batch in batches:
        feats = [seen.of(raw or b"") for raw in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("member"), batch.column("positive"), pa.array(feats, pa.list_(pa.int32()))], ["member", "positive", "features"])


def select_features(pos: list, unl: list, least: int = 5, z_least: float = 5.0, lift: float = 3.0) -> np.ndarray:
    """Features that stand in `lift` times the share of positives as of unlabelled documents, by
    z_least deviations; what most texts share, or a group of copies brings along, stays out."""
    size = 1 << BITS
    p = np.bincount(np.concatenate(pos), minlength=size) if len(pos) else np.zeros(size)
    u = np.bincount(np.concatenate(unl), minlength=size) if len(unl) else np.zeros(size)
    n, m = max(1, len(pos)), max(1, len(unl))
    mid = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(mid * (1 - mid) * (1 / n + 1 / m))
    return np.flatnonzero((z >= z_least) & (p / n >= lift * u / m) & (p >= least))


def apart(docs: list) -> list:
    """One document of each group whose three least hashes agree: copies in a sample would count their
    common words as marks of the label."""
    seen: dict = {}
    for f in docs:
        x = f.astype(np.uint64) + np.uint64(1)
        key = tuple(int(((x * np.uint64(a)) & np.uint64(0xFFFFFFFF)).min()) for a in (2654435761, 2246822519, 3266489917)) if len(f) else ()
        seen.setdefault(key, f)
    return list(seen.values())


class Rows:
    """Documents as sparse rows of selected features and a last column of ones."""

    def __init__(self, docs: list, column: np.ndarray):
        found = [c[c >= 0] for c in (column[f] for f in docs)]
        self.n = len(docs)
        self.row = np.repeat(np.arange(self.n), [len(c) for c in found])
        self.col = np.concatenate([np.zeros(0, np.int64), *found])

    def __len__(self) -> int:
        return self.n

    def take(self, at: np.ndarray) -> "Rows":
        if len(at) == self.n:  # all of them; their order does not matter
            return self
        out, place = object.__new__(Rows), np.full(self.n, -1)
        place[at] = np.arange(len(at))
        row = place[self.row]
        out.n, out.row, out.col = len(at), row[row >= 0], self.col[row >= 0]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + w[-1]

    def back(self, s: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.col, s[self.row], size)
        out[-1] = s.sum()
        return out


def risk(w: np.ndarray, pos: Rows, unl: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part of the risk, its negative part as estimated, and the gradients of both.

    With the loss log(1 + exp(-y f)): prior * loss+(positives), and loss-(unlabelled) - prior *
    loss-(positives), which estimates (1 - prior) * loss-(negatives) and may fall below 0.
    """
    fp, fu = pos.dot(w), unl.dot(w)
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    plus = prior * np.logaddexp(0, -fp).mean()
    minus = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return plus, minus, prior * pos.back(sp - 1, len(w)) / len(pos), unl.back(su, len(w)) / len(unl) - prior * pos.back(sp, len(w)) / len(pos)


def settled_bias(scores: np.ndarray, prior: float, threshold: float = THRESHOLD) -> float:
    """The bias at which the share of scores (without a bias) that reach the threshold comes nearest
    to the prior: halfway between two scores, so that equal scores stay on one side."""
    values, count = np.unique(-scores, return_counts=True)  # best first
    share = np.cumsum(count) / len(scores)
    cut = int(np.argmin(np.abs(share - prior)))
    edge = -(values[cut] + values[min(cut + 1, len(values) - 1)]) / 2
    return float(np.log(threshold / (1 - threshold)) - edge + (0 if cut + 1 < len(values) else -1e-6))


def fit_nnpu(pos: list, unl: list, prior: float, epochs: int = 120, batch: int = 1500, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights by feature (zero where not selected) and the bias, by Adam on the non-negative risk.

    Mini-batches of `batch` unlabelled documents, with their share of the positives; where a batch's
    negative part is below 0, the step takes it up again. The weights of the epoch with the least
    non-negative risk over the whole sample are kept, and the bias is set so that the share of
    unlabelled documents at THRESHOLD is the prior. With no positives the weights are zero
    and the bias gives the prior.
    """
    weights = np.zeros(1 << BITS, np.float32)
    rest = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not pos or not unl:
        return weights, rest
    pos, unl = apart(pos), apart(unl)
    kept = select_features(pos, unl)
    if not len(kept):
        return weights, rest
    column = np.full(1 << BITS, -1)
    column[kept] = np.arange(len(kept))

    xp, xu = Rows(pos, column), Rows(unl, column)
    w = np.zeros(len(kept) + 1)
    w[-1] = rest
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    steps = max(1, min(len(xu) // batch, len(xp)))
    best, least = w.copy(), np.inf
    for epoch in range(epochs):
        op, ou = (np.array_split(rng.permutation(len(x)), steps) for x in (xp, xu))
        for s in range(steps):
            _, minus, up, down = risk(w, xp.take(op[s]), xu.take(ou[s]), prior)
            g = up + down if minus >= 0 else -down
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (0.5 ** (4 * epoch // epochs)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        plus, minus, _, _ = risk(w, xp, xu, prior)
        if plus + max(0.0, minus) < least:
            best, least = w, plus + max(0.0, minus)
    weights[kept] = best[:-1]
    return weights, settled_bias(xu.dot(best) - best[-1], min(max(prior, 1e-6), 1 - 1e-6))


def _fit(prior: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        feats = [np.array(f or [], np.int64) for f in group.column("features").to_pylist()]
        is_pos = group.column("positive").to_pylist()
        w, b = fit_nnpu([f for f, p in zip(feats, is_pos) if p], [f for f, p in zip(feats, is_pos) if not p], prior, seed=key[0].as_py())
        at = np.flatnonzero(w)
        return pa.table({"feature": pa.array(np.append(at, -1), pa.int32()), "weight": pa.array(np.append(w[at], b), pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Averaged weights and bias. Labels of documents whose crc32(doc_id) mod 4 is 2 are not used.

    A document is a confirmed positive if any row of labels says toxic = 1; a null label says
    nothing. The class prior is the share of positives among the labelled documents of the folds
    used. Samples are taken at rates that hold each member near POSITIVES and UNLABELLED documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    used = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    marks = labels.where(used & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).collect()[0]
    if not n or not n_pos:
        return np.zeros(1 << BITS, np.float32), -4.0
    prior = n_pos / n
    n_docs = docs.where(used).count()
    member = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(MEMBERS)).cast("int").alias("member")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    p_rate, u_rate = min(1.0, POSITIVES / n_pos), min(1.0, MEMBERS * UNLABELLED / max(1, n_docs))
    keyed = docs.where(used).select("doc_id", "text")
    # ids of the sample, near POSITIVES at any size of the corpus; texts stay where they lie
    chosen = F.broadcast(marks.where("toxic = 1").select("doc_id").where(unit < p_rate))
    pos = keyed.join(chosen, "doc_id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))).alias("member"), F.lit(True).alias("positive"), "text")
    unl = keyed.where(unit < u_rate).select(member, F.lit(False).alias("positive"), "text")
    feats = pos.unionAll(unl).mapInArrow(_features, "member int, positive boolean, features array<int>")
    found = feats.groupBy("member").applyInArrow(_fit(prior), "feature int, weight double").groupBy("feature").agg((F.sum("weight") / MEMBERS).alias("weight")).collect()  # at most (1 << BITS) + 1 rows
    weights = np.zeros(1 << BITS, np.float32)
    bias = -4.0
    for r in found:
        if r["feature"] < 0:
            bias = r["weight"]
        else:
            weights[r["feature"]] = r["weight"]
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score, for every row; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col("text").alias("_scored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", score double"
    return chosen.mapInArrow(_score(*model), schema)


def _score(weights: np.ndarray, bias: float):
    at = np.flatnonzero(weights)
    table = dict(zip(at.tolist(), weights[at].tolist()))

    def run(batches):
        seen = Features()
        for batch in batches:
            scores = [bias + sum(table[f] for f in seen.of(raw or b"") if f in table) for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -50, 50))), pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts get the bias's score; a null doc_id is held out of nothing and scored.
    Repeated rows each give a row. Other columns of docs are not looked at.
    """
    out = score(docs.select("doc_id", "text"), train(docs.select("doc_id", "text"), labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
