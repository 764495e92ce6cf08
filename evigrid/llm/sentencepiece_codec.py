"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut to marked words (blanks as the block character that opens a word). The distinct
words of a batch are sorted, so walking them in order is a depth-first walk of their trie: states of
a common prefix are kept, only the rest of a word is computed.

The state of a prefix is its best segmentation's score and last piece. For a unigram model an edge
adds the piece's score. For a merge model (BPE) the sum of scores is not what the merges give;
there an edge from piece p to q stands only if merging "pq" leaves p and q apart, and of all paths
of such edges a prefix has exactly one: the merges' own segmentation.
"""
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, tokenizer_path

MARK = "▁"
BLOCK = MARK.encode()
WORD_CACHE = 600_000
PAIR_CACHE = 2_000_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) pairs of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at:at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at:at + n], at + n
        yield tag >> 3, value


class Model:
    """Pieces, scores and settings of a model file; its path is a parameter of the operator."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.kinds = [], [], []
        self.unigram, self.prefix = True, True
        self.unknown = 0
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}  # normal and user-defined
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces reach over the start of a word")
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if k == 6 else t.encode() for p, t, k in zip(self.pieces, self.texts, self.kinds)], pa.large_binary())
        self.plain = np.array([k in (1, 4) for k in self.kinds])
        self.odd = np.array([k not in (1, 4, 6) for k in self.kinds])
        self.before: dict = {}
        self.pairs = 0

    def merge(self, symbols: list[str]) -> list[str]:
        """What the merges make of a short run: the best-scored neighbours first, the left one on ties."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def lefts(self, piece: str):
        """The pieces before this one that the merges leave apart from it, as far as asked; False if the merges
        do not make one symbol of the piece's characters."""
        stands = (len(piece) == 1 or piece in self.ids) and self.merge(list(piece)) == [piece]
        got = self.before[piece] = stands and {"": True, None: False}  # at the start; after no segmentation
        return got

    def stay_apart(self, lefts: dict, left: str, piece: str) -> bool:
        self.pairs += 1
        if self.pairs > PAIR_CACHE:
            self.before.clear()
            self.pairs = 0
        got = lefts[left] = self.merge([*left, *piece]) == [left, piece]
        return got

    def id_list(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]


def encode_sorted(model: Model, words: list[str]):
    """(word, ids) for sorted distinct words; forward states are kept over common prefixes."""
    scores, lasts, before = [0.0], [""], ""
    low = min(model.scores) - 10
    tails, ids, known, unigram = model.tails, model.ids, model.before, model.unigram
    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del scores[shared + 1:], lasts[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            best, last = None, None
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if unigram:
                    if end - start > 1 and piece not in tails:
                        break  # no piece ends in this, so none that is longer
                    if scores[start] is not None and (piece in ids or end - start == 1):
                        now = scores[start] + (model.scores[ids[piece]] if piece in ids else low)
                        if best is None or now > best:
                            best, last = now, piece
                    continue
                lefts = known.get(piece)
                if lefts is None:
                    if end - start > 1 and piece not in tails:
                        break
                    lefts = model.lefts(piece)
                if lefts:
                    left = lasts[start]
                    apart = lefts.get(left)
                    if apart if apart is not None else model.stay_apart(lefts, left, piece):
                        last = piece
                        break
            if unigram:
                scores.append(best)
            lasts.append(last)
        before = word
        pieces, at = [], len(word)
        while at:
            piece = lasts[at]
            pieces.append(piece)
            at -= len(piece)
        pieces.reverse()
        out = list(map(ids.get, pieces))
        yield word, [i for p in pieces for i in model.id_list(p)] if None in out else out


def marked_words(model: Model, text: str) -> list[str]:
    if not text:
        return []
    return _WORD.findall((MARK if model.prefix else "") + text.replace(" ", MARK))


def word_keys(model: Model, text: str) -> list[str]:
    """The marked words, without the mark that opens each of them where the model puts one before the text."""
    if not model.prefix:
        return marked_words(model, text)
    if text and text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")  # single blanks: what stands between them
    return [w[1:] for w in marked_words(model, text)]


def decode(model: Model, ids: list[int]) -> str:
    """Text of ids: byte pieces join to UTF-8, what is not UTF-8 becomes U+FFFD byte by byte."""
    if model.plain[ids].all() if len(ids) else True:
        text = "".join([model.texts[i] for i in ids])
        return text[1:] if model.prefix and text.startswith(" ") else text
    out, held = [], bytearray()

    def flush():
        while held:
            try:
                out.append(held.decode())
                held.clear()
            except UnicodeDecodeError as e:
                out.append(held[:e.start].decode() + "�")
                del held[:e.start + 1]

    for i in ids:
        if model.kinds[i] == 6:
            held.append(int(model.pieces[i][3:5], 16))
            continue
        flush()
        if model.kinds[i] == 2:
            out.append(" ⁇ ")
        elif model.kinds[i] != 3:
            out.append(model.pieces[i])
    flush()
    text = "".join(out).replace(MARK, " ")
    return text[1:] if model.prefix and text.startswith(" ") else text


def decode_rows(model: Model, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """UTF-8 texts of the rows of ids between the ends; pieces of a whole batch are laid end to end at once."""
    flat, ends = flat[ends[0]:ends[-1]], ends - ends[0]
    pieces = model.bytes.take(pa.array(flat))
    at = np.frombuffer(pieces.buffers()[1], "<i8", len(flat) + 1)[ends].tolist() if len(flat) else [0] * len(ends)
    raw = memoryview(pieces.buffers()[2] or b"")
    odd = np.concatenate([[0], np.cumsum(model.odd[flat])])[ends]  # rows with unknown or control pieces
    out = []
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        text = raw[lo:hi].tobytes()
        try:
            if odd[i] != odd[i + 1]:
                raise ValueError
            text.decode()  # byte pieces that are not UTF-8 by themselves leave a text that is none
            text = text.replace(BLOCK, b" ")
            out.append(text[1:] if model.prefix and text.startswith(b" ") else text)
        except ValueError:
            out.append(decode(model, flat[ends[i]:ends[i + 1]].tolist()).encode())
    return out


def _id_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list column and the ends of its rows; a null row has none."""
    return column.values.to_numpy(), column.offsets.to_numpy()


_MODELS: dict = {}


def _model(path: str):
    """The model and the words known so far, kept by each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = (Model(path), {})
    return _MODELS[path]


def _encode(path: str, keep: list[str]):
    def run(batches):
        model, known = _model(path)
        mark = MARK if model.prefix else ""
        for batch in batches:
            texts = [word_keys(model, t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            if len(known) > WORD_CACHE:
                known.clear()
            fresh = set().union(*texts).difference(known)
            for word, ids in encode_sorted(model, sorted(mark + w for w in fresh)):
                known[word[len(mark):]] = array("i", ids).tobytes()
            rows = [b"".join(map(known.__getitem__, words)) for words in texts]
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)], [*keep, "ids"])

    return run


def encode_documents(docs: DataFrame, model: str | None = None, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids array<int>, for every row of docs; a null or empty text has no ids.

    Rows are encoded where they lie, without a shuffle. Repeated rows and null keys pass through;
    columns outside `keep` are not looked at.
    """
    small_batches(docs.sparkSession, 400)
    chosen = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", ids array<int>"
    return chosen.mapInArrow(_encode(model or tokenizer_path("piece_bpe_32k.model"), list(keep)), schema)


def _decode(path: str):
    def run(batches):
        model, _ = _model(path)
        for batch in batches:
            texts = decode_rows(model, *_id_rows(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names[:-1], "text"])

    return run


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (… , ids last) with text in the place of ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields[:-1]) + ", text string"
    return encoded.mapInArrow(_decode(model or tokenizer_path("piece_bpe_32k.model")), schema)


def _digest(path: str):
    def run(batches):
        model, _ = _model(path)
        for batch in batches:
            flat, ends = _id_rows(batch.column("ids"))
            rows = [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
            same = [back == t.replace(BLOCK, b" ") for back, t in zip(decode_rows(model, flat, ends), as_bytes(batch.column("text")))]
            sha = [xxhash.xxh3_128_hexdigest(np.ascontiguousarray(i, "<i4").tobytes()) for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sha), pa.array(same)], ["doc_id", "n_pieces", "ids_hash", "round_trip"])

    return run


def codec_report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_hash (128-bit, over 32-bit ids) and round_trip (decoding gives the text
    again, block characters of the text as blanks) for every row of docs."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = model or tokenizer_path("piece_bpe_32k.model")
    return encode_documents(keyed, path, ("doc_id", "text")).mapInArrow(_digest(path), "doc_id bigint, n_pieces bigint, ids_hash string, round_trip boolean")
