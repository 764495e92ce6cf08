"""Helpers that several operators of this folder share: shared folders, words, hashes."""
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of the alphanumeric kind: digits, letters a-z and everything beyond ASCII.
ALNUM_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the blank-separated kind.
BLANK_SQL = r"[^\x20\x09-\x0D]+"
BLANK = rb"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a session without that setting (a local test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.evigrid.tmp", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.evigrid.tmp", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, since a document may hold a hundred thousand characters."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z become a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def as_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string or binary column; null becomes empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    raw = memoryview(column.buffers()[2] or b"")[ends[0]:ends[-1]].tobytes()
    ends = (ends - ends[0]).tolist()
    return [raw[i:j] for i, j in zip(ends, ends[1:])]


def blank_words(column) -> tuple[list, np.ndarray, np.ndarray]:
    """The blank-separated words of an Arrow string column, A-Z lower-cased; null is empty.

    Distinct words as bytes, the number of each word in turn, and how many words each text has.
    Splitting and telling apart is done on whole columns, so Python sees distinct words only.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))  # blanks: U+0020, U+0009 to U+000D
    ends = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, at = as_bytes(coded.dictionary), coded.indices.to_numpy()
    sizes = np.diff(ends).astype(np.int64)
    if b"" in words:  # before a leading blank, after a trailing one
        empty = words.index(b"")
        some = sizes > 0
        first, last = ends[:-1][some] - ends[0], ends[1:][some] - 1 - ends[0]
        sizes[some] -= (at[first] == empty).astype(np.int64) + ((at[last] == empty) & (last > first))
        at = at[at != empty]
        words[empty:empty + 1] = []
        at = at - (at > empty)
    return words, at, sizes


class WordHash(dict):
    """Word bytes to a 64-bit hash, remembered up to a bound of entries."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Numbers(dict):
    """Things to numbers in the order of their first sight."""

    def __missing__(self, thing) -> int:
        n = self[thing] = len(self)
        return n

    def of(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), np.int32, len(things))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def is_file(path: str) -> bool:
    return os.path.isfile(path)
