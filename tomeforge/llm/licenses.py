"""Licence scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` in the text with A-Z lower-cased. One
automaton finds all phrases in the words joined by single blanks: the base phrases, the longer notice
phrases, and the tag `spdx license identifier`. What follows the tag in the text itself is read as a
licence expression: OR binds weaker than AND, AND weaker than WITH, brackets group. The tag's labels
are the identifiers of the expression in lower case (`a-with-b` for an exception). The expression is evaluated
twice: to its normal form (`expressions`: equal operands once, operands in order, no needless brackets), and for a set of
accepted licences (`accepted`: whether each expression of the text leaves a choice within them; null without one).

`score` is 1 - (1 - weight) over the findings: a tag 0.95, a notice 0.6, a base phrase 0.4. Null and
empty texts have no words, no labels and score 0; very long texts are scanned whole, in time
proportional to their length. An empty table gives an empty result. Rows are scanned one by one; repeated rows give
repeated results, and only named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tables import extended, mapped, table
from tomeforge.llm.textbytes import IS_WORD, LOWER, slices

#: Phrase: label (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "under the mit license": "mit",
    "released under the mit license": "mit",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I | re.A)
#: Licences that ask for no more than a notice: what `accepted` is evaluated for by default (fixed values).
PERMISSIVE = frozenset("mit mit-0 apache-2.0 bsd-2-clause bsd-3-clause 0bsd isc zlib unlicense cc0-1.0 cc-by-3.0 cc-by-4.0 bsl-1.0 postgresql python-2.0".split())
WEIGHTS = {"base": 0.4, "notice": 0.6, "tag": 0.95}

_PIECE = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*", re.A)
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Identifiers and operators of the longest valid expression at the beginning, operands first.

    An unclosed bracket closes at the end; text without an identifier at its beginning gives nothing.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    at = 0
    for m in _PIECE.finditer(expression):
        piece = m[0].lower()
        if expression[at : m.start()].strip(" \t"):
            break  # a comment's end, a comma: the expression is over
        if piece == "(" and operand_next:
            stack.append(piece)
        elif piece == ")" and not operand_next and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif piece in _BINDS and not operand_next:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[piece]:
                out.append(stack.pop())
            stack.append(piece)
            operand_next = True
        elif piece not in _BINDS and piece not in "()" and operand_next:
            out.append(piece)
            operand_next = False
        else:
            break
        at = m.end()
    if operand_next:  # an operator without its right operand says nothing
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def identifiers(tokens: list[str]) -> set[str]:
    """Every identifier of the expression, `a-with-b` for an exception."""
    stack: list[set[str]] = []
    for x in tokens:
        if x not in _BINDS:
            stack.append({x})
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            if x == "with":
                stack.append({f"{i}-with-{j}" for i in a for j in b})
            else:
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
                stack.append(a)
    return stack[-1] if stack else set()


def satisfied(tokens: list[str], accepted: frozenset[str] | set[str]) -> bool:
    """Whether the accepted licences suffice: one side of OR, both of AND; with an exception what suffices without it, or `a-with-b` itself."""
    stack: list[tuple[bool, str]] = []
    for x in tokens:
        if x not in _BINDS:
            stack.append((x in accepted, x))
        elif len(stack) > 1:
            (b, right), (a, left) = stack.pop(), stack.pop()
            named = f"{left}-with-{right}" if left and right else ""
            stack.append((a or b, "") if x == "or" else (a and b, "") if x == "and" else (a or named in accepted, named))
    return bool(stack) and stack[-1][0]


class _Node:
    """A licence, or an operator with its operands by digest (in order for WITH)."""

    __slots__ = ("digest", "least", "name", "op", "operands")

    def __init__(self, op: str, name: str, operands: dict[bytes, _Node]):
        self.op, self.name, self.operands = op, name, operands
        self.least = name or min(n.least for n in operands.values())
        self.digest = b""

    def settled(self) -> _Node:
        """With its digest, which it needs as an operand."""
        if not self.digest:
            parts = list(self.operands) if self.op == "with" else sorted(self.operands)
            self.digest = hashlib.blake2b("\0".join((self.op, self.name)).encode() + b"".join(parts), digest_size=16).digest()
        return self

    def with_operand(self, other: _Node) -> _Node:
        self.operands.setdefault(other.settled().digest, other)
        self.least = min(self.least, other.least)
        return self


def _joined(op: str, a: _Node, b: _Node) -> _Node:
    """Operands of the same operator are one list; the longer one is used again, so that each operand is moved few times."""
    if a.op != op and b.op != op:
        a, b = _Node(op, "", {a.settled().digest: a}), b
    elif a.op != op or (b.op == op and len(a.operands) < len(b.operands)):
        a, b = b, a
    for x in b.operands.values() if b.op == op else [b]:
        a.with_operand(x)
    return a if len(a.operands) > 1 else next(iter(a.operands.values()))


def normal(tokens: list[str]) -> str:
    """The expression with the operands of AND and OR in order, each once, and the brackets that it needs; empty if there is none."""
    stack: list[_Node] = []
    for x in tokens:
        if x not in _BINDS:
            stack.append(_Node("", x, {}))
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            if x == "with":
                stack.append(_Node(x, "", {b"a" + a.settled().digest: a, b"b" + b.settled().digest: b}))
            else:
                stack.append(_joined(x, a, b))
    out: list[str] = []
    open_: list = stack[-1:]
    while open_:
        node = open_.pop()
        if isinstance(node, str) or not node.op:
            out.append(node if isinstance(node, str) else node.name)
            continue
        operands = list(node.operands.values())
        if node.op != "with":
            operands.sort(key=lambda n: (n.least, n.op != "", n.settled().digest))
        parts: list = []
        for n in operands:
            inner = ["(", n, ")"] if n.op and _BINDS[n.op] < _BINDS[node.op] or (n.op == "with" == node.op and parts) else [n]
            parts += [f" {node.op.upper()} ", *inner] if parts else inner
        open_ += reversed(parts)
    return "".join(out)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scanned(documents: DataFrame, keep: list[str], accepted: frozenset[str] = PERMISSIVE) -> DataFrame:
    """`keep`, number of words, base findings with their places, labels, score, expressions and whether the accepted licences suffice for them."""
    fields = "n_words long,n_base long,first_word long,last_word long,base_labels array<string>,labels array<string>,score double,expressions array<string>,accepted boolean"
    schema = extended(documents, keep, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            rows = []
            for part in slices(batch.column("text")):
                data = LOWER[part.data]
                inside = IS_WORD[data]
                flat = np.where(inside, data, 32).astype(np.uint8)
                keep_byte = inside.copy()
                keep_byte[1:] |= inside[:-1]  # one blank after each word
                for row in range(part.last - part.first):
                    a, b = part.bounds[row], part.bounds[row + 1]
                    own = flat[a:b][keep_byte[a:b]]
                    text = " " + own.tobytes().decode("latin-1").strip(" ") + " "  # a byte is a character, which the phrases don't notice
                    rows.append(_findings(finder, text, lambda row=row, part=part: part.text(row), accepted))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2, pa.float64(), pa.list_(pa.string()), pa.bool_()]
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *(f.split(" ")[0] for f in fields.split(","))])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def _findings(finder: ahocorasick.Automaton, text: str, original, accepted: frozenset[str]) -> tuple:
    n_words = text.count(" ") - 1 if len(text) > 2 else 0
    starts, base_labels, labels, weights, tag = [], set(), set(), [], False
    blanks, upto = 0, 0  # blanks in text[:upto]; matches come by their ends, so that phrases' lengths bound the way back
    for end, phrase in finder.iter(text):
        begin = end - len(phrase) - 1
        blanks += text.count(" ", upto, begin) if begin >= upto else -text.count(" ", begin, upto)
        upto, at = begin, blanks  # blanks before the one that begins the match
        if phrase in BASE:
            starts.append(at)
            base_labels.add(BASE[phrase])
            weights.append(WEIGHTS["base"])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            weights.append(WEIGHTS["notice"])
        tag |= phrase == TAG
    expressions: dict[str, bool] = {}
    if tag:
        for m in TAG_TEXT.finditer(original()):
            parsed = postfix(m[1])
            named = identifiers(parsed)
            if named:
                expressions[normal(parsed)] = satisfied(parsed, accepted)
            labels |= named
            weights += [WEIGHTS["tag"]] * bool(named)
    labels |= base_labels
    doubt = 1.0
    for x in weights:
        doubt *= 1 - x
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), sorted(base_labels), sorted(labels), 1 - doubt, sorted(expressions), all(expressions.values()) if expressions else None


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ","), "expressions": F.array_join("expressions", "; ")})
