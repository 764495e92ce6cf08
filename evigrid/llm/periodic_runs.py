"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are kept in classes of equal factors, of one word at first and of one word more at
each level. A class splits by the classes of the positions that follow; only the smaller parts of what
split before are looked at (all but the largest), so a position is touched at most log2(n) times. Members
of a class are linked in order of position; neighbours whose distance is the level's length are the two
halves of a square that is no power of a shorter one. Squares of one period at consecutive starts are one
maximal run.

The texts of a block are refined together, as their positions never share a class. Each text ends in a
word of its own, so that factors that reach over its end are all different.
"""
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Numbers, as_bytes, small_batches

#: Runs are at least so many words long, and at least twice their period.
LEAST = 12
#: Texts are refined together up to so many words; a longer text is a block of its own.
BLOCK_WORDS = 400_000
#: Up to so many touched positions are gone through one by one.
FEW = 96
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
WORD = re.compile(BLANK)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[k] .. starts[k] + sizes[k] - 1 for each k in turn."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Partition:
    """The classes of equal factors of a block of texts, and the squares that their links have shown."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: a number for each word, text after text; sizes: the words of each text."""
        n_texts, n = len(sizes), int(sizes.sum()) + len(sizes)
        stop = np.cumsum(sizes + 1) - 1  # where a text's closing word stands
        text = np.repeat(np.arange(n_texts), sizes + 1)
        self.first = np.zeros(n, bool)
        self.first[stop - sizes] = True
        self.most = np.repeat(sizes // 2, sizes + 1)  # no square of the text has a longer half
        top = int(words.max()) + 1 if len(words) else 1
        key = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[stop] = False
        key[inside] = words
        key[stop] = top
        key += text * (top + 1)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) > 0]) if n else np.zeros(0, bool)
        self.cls = np.empty(n, np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.n_classes = int(new.sum())
        self.lo = np.zeros(n + 1, np.int64)  # the members of class c are member[lo[c]:lo[c] + size[c]]
        self.lo[:self.n_classes] = np.flatnonzero(new)
        self.size = np.zeros(n + 1, np.int64)
        self.size[:self.n_classes] = np.diff(np.append(np.flatnonzero(new), n))
        self.member, self.at = order, np.empty(n, np.int64)
        self.at[order] = np.arange(n)
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        linked = ~new[1:]
        self.next[order[:-1][linked]] = order[1:][linked]
        self.prev[order[1:][linked]] = order[:-1][linked]
        self.born = np.ones(n, np.int64)  # the level from which a position has its next
        self.level = 1
        self.squares, self.few = [], []
        self.views = [memoryview(a) for a in (self.cls, self.size, self.lo, self.member, self.at, self.next, self.prev, self.born)]
        self.first_view, self.most_view = memoryview(self.first), memoryview(self.most)
        # the largest class of each text is left out, the others are what is looked at first
        owner = text[order[self.lo[:self.n_classes]]] if n else np.zeros(0, np.int64)
        by = np.lexsort((self.size[:self.n_classes], owner))
        largest = by[np.append(np.diff(owner[by]) > 0, True)] if len(by) else by
        look = np.ones(self.n_classes, bool)
        look[largest] = False
        self.touched = np.flatnonzero(look[self.cls]) if n else np.zeros(0, np.int64)

    def _show(self, x: np.ndarray) -> None:
        """Squares between positions and their next, before these part."""
        x = x[self.next[x] >= 0]
        gap = self.next[x] - x
        is_square = (self.born[x] <= gap) & (gap <= self.level)
        if is_square.any():
            self.squares.append((x[is_square], gap[is_square]))

    def refine(self) -> None:
        """From factors of `level` words to factors of one word more."""
        j = self.touched
        j = j[~self.first[j] & (self.most[j] > self.level)]
        mark, i = self.cls[j], j - 1
        some = self.size[self.cls[i]] > 1
        mark, i = mark[some], i[some]
        home = self.cls[i]
        key = home * (self.n_classes + 1) + mark
        order = np.argsort(key, kind="stable")  # positions stay in order within a part
        i, home, key = i[order], home[order], key[order]
        self.touched = i[:0]
        if not len(i):
            self.level += 1
            return
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(begin, len(i)))
        part_home = home[begin]
        opens = np.concatenate([[True], part_home[1:] != part_home[:-1]])
        homes = part_home[opens]
        of = np.cumsum(opens) - 1  # each part's place among homes
        touched = np.bincount(of, count).astype(np.int64)
        rest = self.size[homes] - touched
        ranked = np.lexsort((count, of))
        biggest = ranked[np.append(np.diff(of[ranked]) > 0, True)]
        stays = np.zeros(len(count), bool)  # a class that falls apart whole leaves its number to its largest part
        stays[biggest[rest == 0]] = True
        looked = np.ones(len(count), bool)  # parts that are looked at next
        whole = rest < count[biggest]
        looked[biggest[whole]] = False
        moves = ~stays
        if not moves.any():
            self.level += 1
            return
        # members: what is touched goes to the back of the class, part after part
        back = _ranges(self.lo[homes] + rest, touched)
        in_front = self.at[i] < np.repeat(self.lo[homes] + rest, touched)
        is_touched = np.zeros(len(back), bool)
        behind = ~in_front
        is_touched[(self.at[i[behind]] - np.repeat(self.lo[homes] + rest, touched)[behind]) + np.repeat(np.cumsum(touched) - touched, touched)[behind]] = True
        displaced, free = self.member[back[~is_touched]], self.at[i[in_front]]
        self.member[free], self.at[displaced] = displaced, free
        self.member[back], self.at[i] = i, back
        # links: stretches of neighbours that go are cut out
        going = i[np.repeat(moves, count)]
        gone_home = home[np.repeat(moves, count)]
        by_place = np.lexsort((going, gone_home))
        cut = going[by_place]
        joined = self.next[cut[:-1]] == cut[1:]
        left = self.prev[cut[np.concatenate([[True], ~joined])]]
        right = self.next[cut[np.concatenate([~joined, [True]])]]
        lefts = left >= 0
        self._show(cut)
        self._show(left[lefts])
        self.next[left[lefts]] = right[lefts]
        self.born[left[lefts]] = self.level + 1
        self.prev[right[right >= 0]] = left[right >= 0]
        starts = np.zeros(len(i), bool)
        starts[begin] = True
        starts = starts[np.repeat(moves, count)]
        self.next[going] = np.append(np.where(starts[1:], -1, going[1:]), -1)
        self.prev[going] = np.concatenate([[-1], np.where(starts[1:], -1, going[:-1])])
        self.born[going] = self.level + 1
        # numbers
        ids = np.where(stays, part_home, self.n_classes - 1 + np.cumsum(moves))
        self.n_classes += int(moves.sum())
        self.size[homes] = rest
        self.size[ids] = count
        self.lo[ids] = back[begin]
        self.cls[i] = np.repeat(ids, count)
        rests = homes[whole & (rest > 0)]
        self.touched = np.sort(np.concatenate([i[np.repeat(looked, count)], self.member[_ranges(self.lo[rests], self.size[rests])]]))
        self.level += 1

    def refine_few(self) -> None:
        """The same step where few positions are touched, one by one: whole-column calls would cost more."""
        cls, size, lo, member, at, after, before, born = self.views
        level, old, looked = self.level, {}, []
        for j in self.touched:
            if not self.first_view[j] and self.most_view[j] > level:
                home = cls[j - 1]
                if size[home] > 1:
                    old.setdefault(home, {}).setdefault(cls[j], []).append(j - 1)
        for home, parts in old.items():
            parts = list(parts.values())
            rest = size[home] - sum(map(len, parts))
            biggest = max(parts, key=len)
            if not rest and len(parts) == 1:
                continue
            whole = rest < len(biggest)
            for part in parts:
                if not (whole and part is biggest):
                    looked.extend(part)
                if not rest and part is biggest:
                    continue
                new, end = self.n_classes, lo[home] + size[home]
                last = -1
                for i in part:
                    end -= 1
                    spot, other = at[i], member[end]
                    member[spot], at[other], member[end], at[i] = other, spot, i, end
                    left, right = before[i], after[i]
                    if right >= 0:
                        if born[i] <= right - i <= level:
                            self.few.append((i, right - i))
                        before[right] = left
                    if left >= 0:
                        if born[left] <= i - left <= level:
                            self.few.append((left, i - left))
                        after[left], born[left] = right, level + 1
                for i in part:
                    before[i], after[i], born[i], cls[i] = last, -1, level + 1, new
                    if last >= 0:
                        after[last] = i
                    last = i
                lo[new], size[new] = end, len(part)
                size[home] -= len(part)
                self.n_classes += 1
            if whole:
                looked.extend(member[lo[home]:lo[home] + rest] if rest else ())
        self.touched = sorted(looked)
        self.level += 1

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """start, period of every square that is no power, sorted by period and start."""
        while len(self.touched):
            if len(self.touched) > FEW:
                self.touched = np.asarray(self.touched, np.int64)
                self.refine()
            else:
                self.touched = list(map(int, self.touched))
                self.refine_few()
        if self.few:
            self.squares.append(tuple(np.array(self.few, np.int64).T))
        self.level = int(self.most.max()) if len(self.most) else 0
        x = np.flatnonzero(self.next >= 0)
        self._show(x[self.next[x] - x <= self.most[x]])
        x, gap = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (list(zip(*self.squares)) or ((), ())))
        order = np.lexsort((x, gap))
        return x[order], gap[order]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in the text), length and period of the maximal runs of at least `least` words and two
    periods, by text, start and period. words are the words' numbers, text after text; sizes each text's count."""
    x, period = Partition(words, sizes).all_squares()
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(period) != 0)])) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(x)))
    start, period = x[begin], period[begin]
    length = n - 1 + 2 * period
    opens = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(opens, start, "right") - 1
    long_ = length >= least
    order = np.lexsort((period[long_], start[long_], text[long_]))
    return text[long_][order], (start - opens[text])[long_][order], length[long_][order], period[long_][order]


def repeated_tail(n: int, doc_id: int) -> tuple[int, int]:
    """Where the words of one document of ten begin to repeat, and after how many; (n, 1): nowhere."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _block(ids: list, texts: list, vocabulary: list, tails: bool) -> pa.RecordBatch:
    """Result rows of a block of texts, each the array of its words' numbers."""
    if tails:
        for k, (doc_id, t) in enumerate(zip(ids, texts)):
            a, p = repeated_tail(len(t), doc_id) if doc_id is not None else (len(t), 1)
            if a < len(t):
                texts[k] = np.concatenate([t[:a], t[a + np.arange(len(t) - a) % p]])
    sizes = np.array([len(t) for t in texts], np.int64)
    text, start, length, period = runs_of(np.concatenate(texts) if texts else np.zeros(0, np.int64), sizes)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    rows = []
    for k, (doc_id, t) in enumerate(zip(ids, texts)):
        s, m, p = (x[begin[k]:begin[k + 1]] for x in (start, length, period))
        best = [None] * 4
        kept = t
        if len(s):
            at = np.lexsort((p, s, -m))[0]
            best = [int(s[at]), int(m[at]), int(p[at]), int(m[at]) * 1000 // int(p[at])]
            change = np.bincount(s + p, minlength=len(t) + 1) - np.bincount(s + m, minlength=len(t) + 1)
            kept = t[np.cumsum(change)[:len(t)] == 0]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), m.tolist(), p.tolist()))
        rows.append((doc_id, len(s), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join([vocabulary[w] for w in kept.tolist()])).hexdigest()))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run, digests of all runs and of the words left, for every row of docs.

    A run of a text's blank-separated words has a least period q, at least two periods and LEAST words, and
    cannot be extended. Of runs of one length the first counts, then the one of least period; without runs
    start, length, period and exponent_milli are null. Words of a run after its first q ones are dropped.
    tails: one document of ten, told by the checksum of its id, has its last words replaced by repeats of
    a stretch of them first; a null doc_id has none. Null, empty and blank texts have no words, no runs and
    the digest of nothing. Repeated rows give their row each, an empty table none; other columns are not
    looked at. A text is taken whole, however long: memory is some 100 bytes a word.
    """
    small_batches(docs.sparkSession)

    def find(batches):
        ids, texts, seen, held = [], [], Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = seen.of(WORD.findall(text)).astype(np.int64)
                if held and held + len(words) > BLOCK_WORDS:
                    # numbers of words that are only in this text go on, which does no harm
                    yield _block(ids, texts, list(seen), tails)
                    again = list(seen)
                    ids, texts, held, seen = [], [], 0, Numbers()
                    words = seen.of([again[w] for w in words.tolist()]).astype(np.int64)
                ids.append(doc_id)
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield _block(ids, texts, list(seen), tails)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(find, SCHEMA)
