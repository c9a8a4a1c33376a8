"""Packing of tokenised documents into sequences by vector best-fit.

A document's tokens and an end token are one piece, or pieces of exactly the sequence's length if there
are more, of which the first may be shorter. Each piece asks for tokens, for one place of a document and
for attention cost (the square of its length); a sequence has a capacity of each. Pieces are taken from the
greatest demand down (its weighted norm, in shares of the capacities; weights are the scarcity of each
resource) and go into one of the open sequences that keep every capacity: by rule "norm" the one whose
weighted residual is least afterwards, by "dot" the one whose residual has the greatest weighted
product with the demand. Without a feasible one a sequence is opened. Each rule with its weights is a
trial, and a group keeps the trial with the fewest sequences; trials end at the lower bound of any packing.

Pieces that fill a sequence alone are placed where they are made. The others are dealt by hash into groups
of about GROUP_TOKENS tokens and GROUP_PIECES pieces, each packed by a task. Sequences of a group that
stay emptier than FULL are opened again, and their pieces are packed in a second round of groups, so that
the remainders of groups fill each other; if one group of the first round holds all, that round is the last.

Null and empty texts have the end token alone; very long texts are cut, never shortened. Repeated
rows and null ids are documents of their own. An empty table has no sequences. Other columns pass through
where they are asked for, unless they are named as an added one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tables import extended, mapped, table, written

VOCABULARY, END = "byte_bpe_50k.json", 0
LENGTH = 2048
GROUP_TOKENS, GROUP_PIECES = 1 << 24, 1 << 15
#: A sequence with a smaller share of its tokens is packed again in the second round.
FULL = 0.995
#: Rules and how much scarcity weighs: the exponent of the share that all demands have of the capacity.
TRIALS = (("norm", 4.0), ("norm", 1.0), ("dot", 1.0))
#: The pattern of byte-level pre-tokenisation (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


@cache
def _encoder(data: str):
    """Ids of texts as `tokenizers` gives them; by the faster library if the file is plain byte-level BPE whose ids are its merges' order."""
    held = json.loads(data)
    model, before = held["model"], held["pre_tokenizer"] or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    letters, vocabulary = byte_letters(), model.get("vocab", {})
    plain = (
        model["type"] == "BPE" and held["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(vocabulary.get(a + b) == 256 + n for n, (a, b) in enumerate(merges)) and all(vocabulary.get(c, 256) < 256 for c in letters)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in held["added_tokens"])
    )
    if plain:
        import tiktoken

        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in added}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        return lambda texts: [encoding.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def pieces(documents: DataFrame, keep: list[str], path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """`keep`, piece, start, length and ids (unsigned little-endian 32-bit integers) of each document's pieces."""
    sent = documents.sparkSession.sparkContext.broadcast(Path(path).read_text())  # a vocabulary: a few MB
    schema = extended(documents, keep, "piece int,start long,length long,ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for row, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                data, n = np.array([*ids, end], dtype="<u4").tobytes(), len(ids) + 1
                first = (n - 1) % length + 1
                starts = [0, *range(first, n, length)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append(row)
                    for c, x in zip(out, (piece, start, stop - start, data[4 * start : 4 * stop]), strict=True):
                        c.append(x)
            taken = batch.take(pa.array(rows, pa.int64()))
            made = [pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in keep), *made], [*keep, "piece", "start", "length", "ids"])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def fitted(demands: np.ndarray, capacities: np.ndarray, rule: str, power: float) -> tuple[np.ndarray, int]:
    """The sequence of each demand (rows: tokens, documents, cost), and the number of sequences."""
    shares = demands / capacities
    scarcity = shares.sum(axis=0) / shares.sum(axis=0).max()
    weights = scarcity**power
    norms = np.sqrt((weights * shares**2).sum(axis=1))
    order = np.lexsort((np.arange(len(demands)), -norms))
    at_least = np.minimum.accumulate(demands[order][::-1], axis=0)[::-1]  # of this and all later demands
    own, opened = np.empty(len(demands), dtype=np.int64), 0
    left, numbers, held = np.empty((256, demands.shape[1])), np.empty(256, dtype=np.int64), 0
    for step, i in enumerate(order):
        if step % 64 == 0 and held:  # sequences that nothing fits into any more are closed
            open_ = np.flatnonzero((left[:held] >= at_least[step]).all(axis=1))
            left[: len(open_)], numbers[: len(open_)], held = left[open_], numbers[open_], len(open_)
        need = demands[i]
        fits = np.flatnonzero((left[:held] >= need).all(axis=1))
        if not len(fits):
            if held == len(left):
                left, numbers = np.concatenate([left, np.empty_like(left)]), np.concatenate([numbers, np.empty_like(numbers)])
            left[held], numbers[held] = capacities - need, opened
            own[i] = opened
            opened, held = opened + 1, held + 1
            continue
        if rule == "norm":
            after = (left[fits] - need) / capacities
            best = fits[((after * after) @ weights).argmin()]
        else:
            best = fits[((left[fits] / capacities) @ (weights * shares[i])).argmax()]
        own[i] = numbers[best]
        left[best] -= need
    return own, opened


def packed_group(lengths: np.ndarray, capacities: tuple[int, int, int]) -> np.ndarray:
    """The sequence of each piece by the trial that needs the fewest."""
    demands = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.float64) ** 2], axis=1).astype(np.float64)
    size = np.array(capacities, dtype=np.float64)
    least = max(-(-demands.sum(axis=0) // size))  # no packing has fewer
    best = None
    for rule, power in TRIALS:
        own, n = fitted(demands, size, rule, power)
        if best is None or n < best[1]:
            best = own, n
        if n <= least:
            break
    return best[0]


def _placed(rows: DataFrame, groups: int, capacities: tuple[int, int, int], round_: int, full: float) -> DataFrame:
    """Sequence and offset of each row, packed in groups by a hash of `uid`; `open` tells that the sequence stays emptier than `full`."""
    names = [c for c in rows.columns if c != "group_"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        lengths = group.column("length").to_numpy().astype(np.int64)
        own = packed_group(lengths, capacities)
        by = np.lexsort((np.arange(len(own)), own))
        before = np.cumsum(lengths[by]) - lengths[by]
        first = np.flatnonzero(np.r_[True, np.diff(own[by]) > 0])
        offsets, totals = np.empty(len(own), dtype=np.int64), np.bincount(own, weights=lengths)
        offsets[by] = before - np.repeat(before[first], np.diff(np.r_[first, len(by)]))
        number = (round_ << 62) + (group.column("group_")[0].as_py() << 32) + own
        added = pa.array(number, pa.int64()), pa.array(offsets, pa.int64()), pa.array(totals[own] < full * capacities[0])
        return pa.Table.from_arrays([*(group.column(c).combine_chunks() for c in names), *added], [*names, "sequence_id", "offset", "open"])

    dealt = rows.withColumn("group_", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)))
    return dealt.groupBy("group_").applyInArrow(run, extended(rows, names, "sequence_id long,offset long,open boolean"))


def _groups(rows: DataFrame) -> int:
    size = rows.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    return max(1, -(-size["n"] // GROUP_PIECES), -(-(size["tokens"] or 0) // GROUP_TOKENS))


def packed(rows: DataFrame, length: int = LENGTH, documents: int | None = None, cost: int | None = None) -> DataFrame:
    """rows: pieces, with any columns more. Their columns, sequence_id and offset.

    A sequence holds at most `length` tokens, `documents` pieces and `cost` attention cost. The defaults of
    the last two, length and length squared, never bind. A piece that exceeds a capacity by itself is an error.
    """
    if not set(rows.columns).isdisjoint({"uid", "sequence_id", "offset", "open", "group_"}):
        raise ValueError("uid, sequence_id, offset, open and group_ are names of this operator")
    documents, cost = documents or length, cost or length * length
    capacities, names = (length, documents, cost), [*rows.columns, "sequence_id", "offset"]
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    if rows.where((F.col("length") > length) | (F.col("length") * F.col("length") > cost)).limit(1).count():
        raise ValueError("a piece is longer than a sequence, or costs more than one may")
    alone = (F.col("length") == length) | (F.lit(documents) == 1)
    filled = rows.where(alone).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.where(~alone)
    groups = _groups(rest)
    if groups == 1:
        return filled.select(*names).union(_placed(rest, 1, capacities, 0, 0.0).select(*names))
    first = written(_placed(rest, groups, capacities, 0, FULL), "packed")
    again = first.where("open").drop("sequence_id", "offset", "open")
    second = _placed(again, _groups(again), capacities, 1, 0.0)
    return filled.select(*names).union(first.where("not open").select(*names)).union(second.select(*names))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path(VOCABULARY))
    return packed(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
