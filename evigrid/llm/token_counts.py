"""Token counts: every distinct pre-token is encoded once, documents only carry frequencies.

One shuffle brings the frequencies together by pre-token. Its rows are packed: one for each
pre-token and block of documents, holding the documents' places in the block and the counts.
So a pre-token that stands in every document still has only one short row for each block.
"""
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, small_batches, tokenizer_path

#: A block ends at so many characters, documents or distinct pre-tokens, whichever comes first.
BLOCK_CHARS = 8_000_000
BLOCK_DOCS = 60_000
BLOCK_WORDS = 250_000
#: Pre-tokens encoded at a time.
ENCODE = 2_000
PACKED = "token string, block string, places binary, counts binary, ids array<bigint>, n_bytes array<bigint>"
#: Letters, digits and blanks among U+0000 to U+00FF, as the file's pattern classes them (fixed values).
L1 = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
N1 = "0-9²³¹¼-¾"
S1 = "\t-\r \u0085 "
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L1}]+|[{N1}]|[^{S1}{L1}{N1}]+")


class PreTokenizer:
    """Splits texts as the tokenizer file does, up to the point where pieces are looked up."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already; threads only cost memory
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = spec["pre_tokenizer"]
        steps = steps["pretokenizers"] if steps["type"] == "Sequence" else [steps]
        plain = spec | {"added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [s for s in steps if s["type"] != "ByteLevel"]}}
        self.whole = Tokenizer.from_str(json.dumps(plain | {"model": {"type": "BPE", "vocab": {}, "merges": []}}))
        bare = dict(spec)
        bare["normalizer"] = None
        self.pieces = Tokenizer.from_str(json.dumps(bare))
        self.pieces.model._resize_cache(0)  # every pre-token comes once
        split, norm = steps[0], (spec["normalizer"] or {}).get("normalizers", [])
        known = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
        self.fast = known and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def words(self, text: str) -> tuple[list, int]:
        """Pre-tokens of a text and the number of special strings in it."""
        parts, n = [text], 0
        if self.cut is not None and "<|" in text:
            parts = self.cut.split(text)
            n = len(parts) - 1
        out: list = []
        for part in parts:
            try:
                if not self.fast:
                    raise UnicodeError
                part.encode("latin-1")
                # U+00B5 and the like stay; lower() of this range never leaves it
                out += LATIN.findall(part.lower())
            except UnicodeError:
                out += [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part))]
        return out, n

    def counts(self, words: list) -> np.ndarray:
        """Number of pieces of each pre-token; only lengths leave the encoder."""
        out = np.empty(len(words), np.int64)
        for lo in range(0, len(words), ENCODE):
            out[lo:lo + ENCODE] = [len(e) for e in self.pieces.encode_batch_fast(words[lo:lo + ENCODE], add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    """One for each worker process, whichever tasks it runs."""
    return PreTokenizer(path)


def _pack(path: str):
    def run(batches):
        from pyspark import TaskContext

        pre = pre_tokenizer(path)
        part, n_block = TaskContext.get().partitionId(), 0
        vocab = Numbers()
        terms, places, ids, sizes, specials, chars = [], [], [], [], [], 0

        def flush():
            nonlocal vocab, terms, places, ids, sizes, specials, chars, n_block
            if not ids:
                return
            block = f"{part}:{n_block}:{len(ids)}"
            n_block += 1
            term = np.concatenate(terms) if terms else np.empty(0, np.int64)
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            terms, places = [], []
            key, count = np.unique(term.astype(np.int64) * BLOCK_DOCS + place, return_counts=True)
            while (big := count > 255).any():  # a long run becomes several entries
                key = np.concatenate([key, key[big]])
                count = np.concatenate([np.where(big, 255, count), count[big] - 255])
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            term, place = key // BLOCK_DOCS, (key % BLOCK_DOCS).astype("<u2")
            at = np.searchsorted(term, np.arange(len(vocab) + 1))
            packed, counted = place.tobytes(), count.astype("u1").tobytes()
            names = list(vocab)
            vocab = Numbers()
            step = 20_000
            for lo in range(0, len(names), step):
                hi = min(lo + step, len(names))
                n = hi - lo
                nothing = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[lo:hi], pa.string()), pa.array([block] * n, pa.string()),
                    pa.array([packed[2 * at[i]:2 * at[i + 1]] for i in range(lo, hi)], pa.binary()),
                    pa.array([counted[at[i]:at[i + 1]] for i in range(lo, hi)], pa.binary()), nothing, nothing],
                    ["token", "block", "places", "counts", "ids", "n_bytes"])
            yield pa.RecordBatch.from_arrays([
                pa.array(["\0" + block], pa.string()), pa.array([block], pa.string()), pa.array([np.array(specials, "<u4").tobytes()], pa.binary()), pa.array([None], pa.binary()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))],
                ["token", "block", "places", "counts", "ids", "n_bytes"])
            ids, sizes, specials, chars = [], [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                words, n = pre.words(text)
                if words:
                    found = vocab.of(words)
                    terms.append(found)
                    places.append(np.full(len(found), len(ids), np.int32))
                ids.append(doc)
                sizes.append(len(text.encode()))
                specials.append(n)
                chars += len(text)
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS or len(vocab) >= BLOCK_WORDS:
                    yield from flush()
        yield from flush()

    return run


def ragged(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column end to end, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    flat = np.frombuffer(column.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, kind)
    return flat, np.diff(ends) // np.dtype(kind).itemsize


def runs(column) -> tuple[list, np.ndarray]:
    """The values of neighbouring equal rows, and how many rows each has."""
    import pyarrow.compute as pc

    found = pc.run_end_encode(column)
    ends = found.run_ends.to_numpy(zero_copy_only=False)
    return found.values.to_pylist(), np.diff(np.concatenate([[0], ends]))


class Sums:
    """Sums by block and place of a bounded number of blocks; a block's name ends in its size."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.start, self.flat = most, {}, np.zeros(0, np.int64)

    def add(self, blocks: list, rows: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        """rows gives for each place the index into blocks."""
        first = np.zeros(len(blocks), np.int64)
        top = len(self.flat) if not self.start else self.end
        for i, b in enumerate(blocks):
            if b not in self.start:
                self.start[b] = top
                top += int(b.rpartition(":")[2])
            first[i] = self.start[b]
        self.end = top
        if top > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(top * 2 - len(self.flat), np.int64)])
        np.add.at(self.flat, first[rows] + place, n)

    @property
    def full(self) -> bool:
        return bool(self.start) and self.end > self.most

    def take(self):
        """(block, places, sums) of what has come together, which is then forgotten."""
        for block, at in self.start.items():
            got = self.flat[at:at + int(block.rpartition(":")[2])]
            some = np.flatnonzero(got)
            if len(some):
                yield block, some.astype("<u2"), got[some]
        self.start, self.flat = {}, np.zeros(0, np.int64)


def _sum(path: str):
    """Rows come sorted by token: each token is encoded once, its counts go to the documents' sums."""

    def run(batches):
        pre = pre_tokenizer(path)
        sums = Sums()
        names = ["block", "places", "sums", "ids", "n_bytes"]
        nothing = pa.nulls(1, pa.list_(pa.int64()))

        def out():
            for block, place, n in sums.take():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([place.tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary()), nothing, nothing], names)

        for batch in batches:
            special = batch.column("ids").is_valid()
            for row in batch.filter(special).to_pylist():
                n = np.frombuffer(row["places"], "<u4").astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([np.arange(len(n), dtype="<u2").tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["n_bytes"]], pa.list_(pa.int64()))], names)
            rest = batch.filter(pa.array(~special.to_numpy(zero_copy_only=False)))
            if not rest.num_rows:
                continue
            tokens, times = runs(rest.column("token"))
            n = np.repeat(pre.counts(tokens), times)
            place, k = ragged(rest.column("places"), "<u2")
            count, _ = ragged(rest.column("counts"), "u1")
            coded = rest.column("block").dictionary_encode()
            rows = np.repeat(coded.indices.to_numpy(), k)
            sums.add(coded.dictionary.to_pylist(), rows, place.astype(np.int64), count * np.repeat(n, k))
            if sums.full:
                yield from out()
        yield from out()

    return run


def _whole(batches):
    """Rows come sorted by block: its packed sums become a row for each document."""
    block, ids, sizes, total = None, None, None, None
    names = ["doc_id", "n_bytes", "n_tokens"]

    def out():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield out()
                block, total = row["block"], np.zeros(int(row["block"].rpartition(":")[2]), np.int64)
            total[np.frombuffer(row["places"], "<u2")] += np.frombuffer(row["sums"], "<i8")
            if row["ids"] is not None:
                ids, sizes = row["ids"], row["n_bytes"]
    if block is not None:
        yield out()


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens). Rows that repeat a doc_id each give a row of
    their own, and a null doc_id stays null. Further columns of docs are not looked at, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pack(path), PACKED)
    together = packed.repartition("token").sortWithinPartitions("token")
    parts = together.mapInArrow(_sum(path), "block string, places binary, sums binary, ids array<bigint>, n_bytes array<bigint>")
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_whole, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
