"""Byte-level BPE as a monoid: encodings of two halves are joined at their boundary.

`encode` splits a piece in two (at the largest power of two below its length), encodes both and joins them. Two encodings side by
side are the encoding of the whole if and only if every pair of neighbouring tokens is one that the
merges would leave as it is (the two tokens' bytes, merged alone, give these two tokens). Inside
either half that holds already, so `join` looks at the boundary alone: it re-encodes a window of
tokens around it and widens the window, by twice as much each time, on each side whose edge pair isn't
such a pair. Then the tokens outside can't change. Decoding concatenates the bytes of halves up the same tree.

A text is first split by the pattern of the vocabulary, each match is encoded alone, and a match that
is itself in the vocabulary is that token. Of short matches each worker keeps the results it used last.

Null and empty texts have no tokens and decode to nothing; very long texts and matches are encoded
whole. An empty table gives an empty result. Repeated rows are encoded alike; other
columns pass through `tokens` untouched or are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tables import extended, mapped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Results that a worker keeps of each kind (a default of tokens(); ids are the same with any), and characters
#: of a match whose result is kept, at most.
MEMORY, LONGEST = 400_000, 48
#: Bytes that are merged as they are; longer ones are halved. Bytes of a window whose result is kept.
LEAF, WINDOW = 8, 24
#: The characters that Unicode calls white space (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: The letters and numbers up to U+024F (fixed values).
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"


def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern with \s as the Unicode property, which Python's engines read a little wider."""
    inside = regex.sub(r"\[(\^?)\\s", lambda m: f"[{m[1]}{SPACE}", pattern)
    return regex.compile(inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def narrow_splitter(pattern: str) -> re.Pattern | None:
    """The same for texts up to U+024F, by the faster engine; none if the pattern asks for more than it has."""
    made = splitter(pattern).pattern
    for name, own in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS)):
        made = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m, own=own: m[1] + own, made).replace(name, f"[{own}]")
    try:
        return re.compile(made)
    except re.error:
        return None


class Kept(dict):
    """Made values by key; about `most` of the last used ones are kept."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    def __init__(self, ranks: dict[bytes, int], kept: int = MEMORY):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.leaves = Kept(self.merged, kept)
        self.stable = Kept(lambda pair: self.window(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair), kept)

    def merged(self, data: bytes) -> list[int]:
        """Merges of neighbours by rank, lowest first: the definition, for a few bytes at a time."""
        get, none = self.ranks.get, len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def window(self, data: bytes) -> list[int]:
        """The tokens of some neighbouring tokens' bytes."""
        return self.leaves[data] if len(data) <= WINDOW else self.merged_long(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        if self.stable[left[-1], right[0]]:
            return left + right
        i, j, grown = 1, 1, 1
        while True:
            window = self.window(b"".join([self.tokens[t] for t in (*left[-i:], *right[:j])]))
            wider_left = i < len(left) and not self.stable[left[-i - 1], window[0]]
            wider_right = j < len(right) and not self.stable[window[-1], right[j]]
            if not (wider_left or wider_right):
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), i + grown * wider_left)
            j = min(len(right), j + grown * wider_right)
            grown *= 2

    def merged_long(self, data: bytes) -> list[int]:
        """merged() for long windows: the lowest pair comes from a heap, so that n bytes take n log n."""
        get, tokens = self.ranks.get, self.ranks
        size = len(data)
        after, before, length = list(range(1, size + 1)), list(range(-1, size - 1)), [1] * size
        heap = [(rank, i, 1, 1) for i in range(size - 1) if (rank := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, own, other = heapq.heappop(heap)
            j = i + own
            if length[i] != own or j >= size or length[j] != other:
                continue  # one of the two has been merged since
            length[i], length[j] = own + other, 0
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                near = after[i]
                if (rank := get(data[i : near + length[near]])) is not None:
                    heapq.heappush(heap, (rank, i, length[i], length[near]))
            if (near := before[i]) >= 0 and (rank := get(data[near : i + length[i]])) is not None:
                heapq.heappush(heap, (rank, near, length[near], length[i]))
        out, i = [], 0
        while i < size:
            out.append(tokens[data[i : i + length[i]]])
            i = after[i]
        return out

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        return self.reduced(data)

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaves[data]
        middle = 1 << ((len(data) - 1).bit_length() - 1)  # a power of two, where runs of one character seldom break a token
        return self.join(self.reduced(data[:middle]), self.reduced(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) < 9:
            return b"".join([self.tokens[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Pieces:
    """Ids, as 32-bit integers, and decoded bytes of the pattern's matches."""

    def __init__(self, bpe: Bpe, pattern: str, kept: int = MEMORY):
        self.bpe, self.split, self.narrow = bpe, splitter(pattern), narrow_splitter(pattern)
        self.wide = re.compile("[^\0-\u024f]")
        self.known = Kept(self.made, kept)

    def made(self, match: str) -> tuple[bytes, bytes]:
        ids = self.bpe.encode(match.encode())
        return array("i", ids).tobytes(), self.bpe.decode(ids)

    def of(self, text: str) -> list[tuple[bytes, bytes]]:
        """The text's matches in order; long ones are made anew each time."""
        if not text:
            return []
        split = self.split if self.narrow is None or self.wide.search(text) else self.narrow
        known = self.known
        return [known[x] if len(x) <= LONGEST else self.made(x) for x in split.findall(text)]


@cache
def _pieces(data: bytes, pattern: str, kept: int) -> Pieces:
    return Pieces(Bpe(read_ranks(data), kept), pattern, kept)


def tokens(documents: DataFrame, keep: list[str], path: str, pattern: str, kept: int = MEMORY) -> DataFrame:
    """`keep`, the number of the text's tokens, their ids, and the bytes that they decode to."""
    sent = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a vocabulary: a few MB
    schema = extended(documents, keep, "n_tokens long,ids array<int>,decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(sent.value, pattern, kept)
        for batch in batches:
            ids, decoded = [], []
            for value in batch.column("text"):
                parts = pieces.of(value.as_py())
                ids.append(np.frombuffer(b"".join([p[0] for p in parts]), np.int32))
                decoded.append(b"".join([p[1] for p in parts]))
            counts = [len(x) for x in ids]
            bounds = np.cumsum([0, *counts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            columns = [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), lists, pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "decoded"])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def digests(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, number of tokens, and SHA-256 of the comma-joined ids and of the decoded bytes; rows come from tokens()."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(*keep, "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded(documents: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    return digests(tokens(documents, keep, path, pattern), keep)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
