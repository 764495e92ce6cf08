"""License scans: an Aho-Corasick automaton over a document's words, and a shunting-yard reading
of and/or/with expressions behind identifier tags."""
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, small_batches

#: Base phrases and labels (fixed values of the contract).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "licensed under the apache license": "apache-2",
    "released under the mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "boost",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "gnu free documentation license": "gfdl",
    "sil open font license": "ofl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Words that open an identifier tag.
TAGS = ("spdx license identifier", "license identifier", "spdx licence identifier", "licence identifier")
#: Every phrase and tag holds one of these, so a text without any of them needs no automaton.
KEYS = (b"licen", b" cc by nc ", b" reserved ", b" granted ", b"redistribution", b" commons ", b" public domain ", b" permission to use ")
#: Families of identifiers known to the expression reader, as patterns of the lower-case identifier, and their labels.
FAMILIES = (
    (r"mit(-0|-advertising|-cmu|-feh|-modern-variant)?|x11|expat", "mit"), (r"apache-2\.0", "apache-2"), (r"apache-1\.[01]", "apache-1"), (r"(0bsd|bsd-[0-9]-clause(-[a-z-]+)?)", "bsd"),
    (r"gpl-[123]\.0(-only|-or-later|\+)?", "gpl"), (r"lgpl-(2\.0|2\.1|3\.0)(-only|-or-later|\+)?", "lgpl"), (r"agpl-[13]\.0(-only|-or-later|\+)?", "agpl"), (r"mpl-(1\.0|1\.1|2\.0)(-no-copyleft-exception)?", "mpl"),
    (r"cc0-1\.0", "cc0"), (r"cc-by-nc(-sa|-nd)?-[1-4]\.[05]", "cc-by-nc"), (r"cc-by-sa-[1-4]\.[05]", "cc-by-sa"), (r"cc-by-nd-[1-4]\.[05]", "cc-by-nd"), (r"cc-by-[1-4]\.[05]", "cc-by"),
    (r"isc", "isc"), (r"unlicense", "unlicense"), (r"zlib(-acknowledgement)?", "zlib"), (r"bsl-1\.0", "boost"), (r"epl-[12]\.0", "epl"), (r"eupl-1\.[012]", "eupl"), (r"cddl-1\.[01]", "cddl"), (r"artistic-(1\.0(-perl|-cl8)?|2\.0)", "artistic"),
    (r"python-2\.0(\.1)?|psf-2\.0", "python"), (r"ofl-1\.[01](-rfn|-no-rfn)?", "ofl"), (r"wtfpl", "wtfpl"), (r"postgresql", "postgresql"), (r"ncsa", "ncsa"), (r"ms-(pl|rl)", "ms"), (r"odbl-1\.0", "odbl"), (r"pddl-1\.0", "pddl"), (r"gfdl-1\.[123](-only|-or-later)?", "gfdl"),
)
_FAMILIES = tuple((re.compile(p), label) for p, label in FAMILIES)


def label_of(identifier: str) -> str | None:
    """The family of a lower-case identifier."""
    return next((label for p, label in _FAMILIES if p.fullmatch(identifier)), None)


PERMISSIVE = {"mit", "apache-1", "apache-2", "bsd", "isc", "cc-by", "cc0", "unlicense", "zlib", "boost", "python", "postgresql", "ncsa", "wtfpl", "pddl"}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>, open_use boolean"
_WORD = re.compile(ALNUM)
_TAG = re.compile(rb"licen[sc]e-identifier:[ \t]*([^\n\r*/<>\"]+)", re.I)
_PIECE = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: identifiers and operators in evaluation order; ends before what does not fit."""
    return parsed(expression)[0]


def parsed(expression: str) -> tuple[list[str], bool]:
    """postfix(), and whether it is whole: no operator lacks its right side and no bracket is left open."""
    out, waiting, operand = [], [], False
    for piece in _PIECE.findall(expression):
        low = piece.lower()
        if low in _RANK:
            if not operand:
                break
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif piece == "(":
            if operand:
                break
            waiting.append(piece)
        elif piece == ")":
            if not operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    whole = operand and "(" not in waiting
    if not operand and waiting and waiting[-1] != "(":
        waiting.pop()
    out += [w for w in reversed(waiting) if w != "("]
    return out, whole


def evaluate(expression: str) -> tuple[set, bool | None]:
    """Labels named by an expression, and whether it permits free use: or needs one side, and both;
    with (an exception) keeps its left side's answer. Unknown identifiers permit nothing, and an expression
    that breaks off permits nothing known (null), though its labels count."""
    stack: list = []
    pieces, whole = parsed(expression)
    for piece in pieces:
        if piece in _RANK and len(stack) >= 2:
            (rl, ro), (ll, lo) = stack.pop(), stack.pop()
            stack.append((ll if piece == "with" else ll | rl, lo if piece == "with" else lo or ro if piece == "or" else lo and ro))
        elif piece not in _RANK:
            label = label_of(piece)
            stack.append(({label} if label else set(), label in PERMISSIVE))
    return (stack[-1][0], stack[-1][1] if whole else None) if stack else (set(), None)


def automaton():
    import ahocorasick

    assert all(any(k in f" {p} ".encode() for k in KEYS) for p in (*BASE, *NOTICES, *TAGS))
    a = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        a.add_word(f" {phrase} ", (phrase, label, True))
    for phrase, label in NOTICES.items():
        a.add_word(f" {phrase} ", (phrase, label, False))
    for phrase in TAGS:
        a.add_word(f" {phrase} ", (phrase, "", False))
    a.make_automaton()
    return a


def scan_text(a, raw: bytes) -> tuple:
    """Counts and labels of one text, given as UTF-8 bytes."""
    words = _WORD.findall(raw.lower())
    base, places, labels, expressions, open_use, tags = set(), [], set(), [], None, 0
    if words:
        line = b" " + b" ".join(words) + b" "
        for end, (phrase, label, is_base) in a.iter(line.decode()) if any(k in line for k in KEYS) else ():
            if is_base:
                places.append((end, phrase))
                base.add(label)
            if label:
                labels.add(label)
            else:
                tags += 1
    if places:
        text = line.decode()
        begin, starts, seen = 0, [], 0
        for end, phrase in sorted(places):
            first = end - len(phrase) - 1  # the blank before the phrase
            if first < begin:
                starts.append(text.count(" ", 0, first))
                continue
            seen += text.count(" ", begin, first)
            begin = first
            starts.append(seen)
        places = starts
    if tags:
        for found in _TAG.findall(raw):
            expression = found.decode("utf-8", "replace").strip()
            named, free = evaluate(expression)
            if named:
                labels |= named
                expressions.append(expression)
                if free is not None:
                    open_use = free if open_use is None else open_use and free
    named = base | labels
    score = min(1.0, 0.6 * bool(base) + 0.25 * bool(expressions) + 0.1 * len(named) + 0.05 * min(len(places), 3)) if named else 0.0
    return len(words), len(places), min(places) if places else None, max(places) if places else None, ",".join(sorted(base)), ",".join(sorted(named)), score, expressions, open_use


def _scan(batches):
    a = automaton()
    for batch in batches:
        rows = [scan_text(a, raw or b"") for raw in batch.column("text").cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "open_use"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text), without a shuffle.

    Null texts count as empty: no words, no places, labels "". Repeated rows and null doc_ids give
    rows of their own. Overlapping places all count. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)
