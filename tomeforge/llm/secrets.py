"""Secret scan: fixed patterns, and spans that a linear-chain CRF tags.

Tokens are runs of letters, digits and `_+/-`. Each is tagged as begin, inside or outside of a secret
from its shape (kinds of characters, length, changes between letters and digits), its first
characters, neighbouring words and how they end, the characters between neighbours, and features of its text; the tags
are decoded by Viterbi. The field is fitted on a bounded sample of `sample` documents of at most
samples.MOST_CHARS characters, into which secrets of many forms, and harmless look-alikes, are put;
what the patterns find there counts as secret too.

Spans of the patterns stay; a tagged span, with the `=` of base 64 behind it, is added where it overlaps none of them. Offsets are code
points with an exclusive end. A null or empty text has no spans; very long texts are tagged whole (about
100 bytes of memory for each byte of the text), in time proportional to their length. An empty table
gives an empty result. Rows are scanned one by one, so that
repeated rows give repeated results; only named columns are read.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import crf
from tomeforge.llm.samples import MOST_CHARS, hashed_sample
from tomeforge.llm.tables import extended, mapped, table
from tomeforge.llm.textbytes import Slice, Words, slices, words

BITS = 16
#: Times that each sampled text is learned from, with other secrets and look-alikes in it.
COPIES = 3
SAMPLE = 400
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "tagged")

TOKEN = np.zeros(256, dtype=bool)
for _c in string.ascii_lowercase + string.digits + "_+/-":
    TOKEN[ord(_c)] = True
TOKEN[128:] = True

#: Byte kinds, counted in one sum: 16 bits each for lower case, upper case, digits and others.
_KIND = np.full(256, 1 << 48, dtype=np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 1 << 16, 1 << 32
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3


def base(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of each pattern's matches."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def tokens(part: Slice) -> Words:
    return words(part, TOKEN)


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64, 128)).astype(np.uint64)


def features(part: Slice, w: Words) -> list[np.ndarray]:
    n = len(w.hash)
    size = w.end - w.start
    inside = TOKEN[w.data]
    at = np.cumsum(size) - size
    own = part.data[inside]
    kind = _CLASS[own]
    counts_of = np.add.reduceat(_KIND[own], at)
    lower, upper, digit, other = (((counts_of >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4))
    if len(size) and size.max() > 0xFFFF:  # 16 bits don't hold the counts
        other, lower, upper, digit = (np.add.reduceat((kind == i).astype(np.int64), at) for i in range(4))
    change = np.zeros(len(own), dtype=np.int64)
    change[1:] = kind[1:] != kind[:-1]
    change[at] = 0
    changes = np.add.reduceat(change, at)
    mixed = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (other > 0) * 8 + (own[at] < 91) * 16
    shape = mixed.astype(np.uint64) * np.uint64(256) + _bucket(size) * np.uint64(16) + np.minimum(changes, 12).astype(np.uint64)
    mostly = (10 * np.maximum(np.maximum(lower, upper), digit) // np.maximum(size, 1)).astype(np.uint64) * np.uint64(16) + _bucket(size)
    zero = np.zeros(1, np.uint64)
    before = np.concatenate([zero, w.hash[:-1]])
    after = np.concatenate([w.hash[1:], zero])
    data = np.concatenate([part.data, np.zeros(4, np.uint8)]).astype(np.uint64)
    gap = data[np.maximum(w.start - 1, 0)] * np.uint64(256) + data[np.maximum(w.start - 2, 0)]
    gap_after = data[w.end] * np.uint64(256) + data[w.end + 1]
    odd = (changes >= 3) | (size >= 16)
    heads, tails = crf.affixes(w, 4)
    named = np.concatenate([zero, tails[3][:-1]])  # how the word before ends: names like db_pass end alike
    counts = w.counts()
    total = np.concatenate([[0], np.cumsum(odd)])
    file = (np.minimum(total[w.rows[1:]] - total[w.rows[:-1]], 7) * 16).astype(np.uint64) + _bucket(counts // 16)
    file = np.repeat(file, counts)
    odd_value = odd.astype(np.uint64) + np.uint64(1)
    assigned = np.isin(part.data[np.maximum(w.start - 1, 0)], [58, 61]) | np.isin(part.data[np.maximum(w.start - 2, 0)], [58, 61])
    values = [shape, mostly, heads[3] * odd_value, before * odd_value, after * odd_value, np.concatenate([zero, before[:-1]]) * odd_value, gap * odd_value, gap_after * odd_value, file * odd_value, shape * np.uint64(2) + assigned.astype(np.uint64), before * np.uint64(3) + assigned.astype(np.uint64), named * np.uint64(5) + assigned.astype(np.uint64)]
    return [crf.slot(v, k, BITS) for k, v in enumerate(values)]


def _first(w: Words) -> np.ndarray:
    first = np.zeros(len(w.hash), dtype=bool)
    first[w.rows[:-1][w.counts() > 0]] = True
    return first


def _points(part: Slice) -> np.ndarray:
    """Code points before each byte of the slice."""
    return np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])


def tagged(part: Slice, w: Words, tags: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Start and end of each tagged span, by row."""
    out: dict[int, list[tuple[int, int]]] = {}
    at = None
    for i in np.flatnonzero(tags == BEGIN).tolist():
        at = _points(part) if at is None else at
        row = int(np.searchsorted(w.rows, i, side="right")) - 1
        j = i + 1
        while j < w.rows[row + 1] and tags[j] == INSIDE:
            j += 1
        zero, end = at[part.bounds[row]], int(w.end[j - 1])
        padding = next((n for n in range(2) if end + n >= part.bounds[row + 1] or part.data[end + n] != 61), 2)  # `=` at the end of a secret in base 64
        out.setdefault(row, []).append((int(at[w.start[i]] - zero), int(at[end] - zero) + padding))
    return out


def apart(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the spans, none of which overlaps another, that overlap none of the found (start, kind, end); both by start."""
    i, reach = 0, 0  # of the found that begin before the span's end, the last end
    for a, b in spans:
        while i < len(found) and found[i][0] < b:
            reach = max(reach, found[i][2])
            i += 1
        if reach <= a:
            yield a, b


def _made(rng: random.Random) -> tuple[str, str, str]:
    """A secret of some form, with what stands before and after it.

    Forms are kinds of shapes and places, not lists of vendors: prefixes, names and commands are drawn letter by letter
    for the most part, so that the field learns what random characters look like and where secrets stand.
    """
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    letters, safe, symbols = string.ascii_letters + digits, string.ascii_letters + digits + "+/", "!@#$%^&*?"
    word = lambda a, b: pick(lower, rng.randint(a, b))
    strong = lambda: pick(letters, rng.randint(3, 8)) + rng.choice(symbols) + pick(letters, rng.randint(3, 8)) + rng.choice(["", rng.choice(symbols)])
    value = rng.choice([
        lambda: pick(letters, rng.randint(8, 40)), lambda: pick("0123456789abcdef", rng.choice([16, 18, 24, 32, 40, 64])), lambda: "AKIA" + pick(upper + digits, 16),
        lambda: word(1, 6) + rng.choice("-_") + pick(letters + rng.choice(["", "-_"]), rng.randint(16, 48)), lambda: word(2, 5) + "_" + word(3, 6) + "_" + pick(letters, rng.randint(16, 40)),
        lambda: pick(upper, rng.randint(1, 4)) + pick(lower, rng.randint(0, 3)) + pick(letters + "_-", rng.randint(24, 40)), lambda: ".".join([pick(letters, rng.randint(2, 30)), pick(letters, rng.randint(18, 44)), pick(letters + "_-", rng.randint(20, 48))]),
        lambda: pick(safe, rng.choice([22, 40, 43, 64, 86, 88])) + rng.choice(["", "=", "=="]), strong, strong, lambda: "-".join(pick(rng.choice(["0123456789abcdef", upper + digits]), n) for n in rng.choice([(8, 4, 4, 4, 12), (5, 5, 5, 5), (11, 12, 24)])),
    ])()
    name = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "client_secret", "access_key", "auth", "key", "private_key", "PASSWORD", "Token", "passphrase", "login", f"{word(2, 6)}_pass", f"{word(2, 6).upper()}_PWD", f"{word(2, 6).title()}Key", f"{word(2, 5)}_{rng.choice(['key', 'cred', 'auth', 'secret'])}"])
    short = pick(letters, rng.randint(8, 14))
    return rng.choice([
        (f"{name}=", value, ""), (f"{name}: ", value, ""), (f'{name} = "', value, '"'), (f"{name}='", value, "'"), (f"export {name.upper()}=", value, ""), (f'"{name}": "', value, '"'), (f"{word(4, 9)}={word(3, 6)};{name}=", value, ";"),
        ("Authorization: Bearer ", value, ""), (f"https://{word(4, 8)}:", value.replace("/", "x"), "@host.example.com/db"), (f"https://{word(3, 8)}.example.com/{word(4, 9)}/", "/".join([pick(upper + digits, 9), pick(upper + digits, 10), pick(letters, 24)]), ""),
        (f"{word(3, 6)} -{rng.choice(lower)} {word(3, 6)} -{rng.choice(lower)}", short, f" {word(3, 6)}"), (f"{word(3, 6)} --{rng.choice(['password', 'token', 'secret', 'key', 'pass'])} ", value, ""), (f"{word(3, 6)} -{rng.choice(lower)} {word(3, 7)}:", short, f" https://{word(3, 6)}"),
        (f"{rng.choice(['the', 'my', 'your', 'our'])} {rng.choice(['password', 'pass word', 'passphrase', 'code', 'login', 'secret', 'access key', word(3, 5) + ' code', word(3, 5) + ' word'])} is {rng.choice(['', 'now ', 'still '])}", rng.choice([short, strong()]), ""),
        ("", value if len(value) > 19 else "AKIA" + pick(upper + digits, 16), ""), ("", value if len(value) > 19 else word(2, 5) + rng.choice("-_") + pick(letters, 30), ""),
        ("-----BEGIN RSA PRIVATE KEY-----\n", "\n".join(pick(safe, 64) for _ in range(rng.randint(2, 5))), "\n-----END RSA PRIVATE KEY-----"),
    ])


def _harmless(rng: random.Random) -> str:
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low = string.ascii_lowercase
    return rng.choice([
        lambda: pick(string.digits, rng.randint(1, 12)), lambda: f"20{pick(string.digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"https://www.{pick(low, 8)}.example.org/{pick(low, 5)}/{pick(string.digits, 5)}.html",
        lambda: f"{pick(low, 6)}.{pick(string.digits, 2)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: pick(low, rng.randint(14, 40)), lambda: pick(string.ascii_uppercase, rng.randint(3, 24)),
        lambda: f"+{pick(string.digits, 2)} {pick(string.digits, 3)} {pick(string.digits, 7)}", lambda: f"{pick(low, 4).title()}{pick(low, 5).title()}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: rng.choice(["token", "secret:", "the password is", "key =", "my code is fine", "the login is slow"]), lambda: f"{pick(low, 5)}-{pick(low, 6)}-{pick(string.digits, 3)}",
        lambda: f"{pick(low, 3)} -{rng.choice(low)} {pick(low, 6)}", lambda: f"{pick(low, 5)}={pick(low, 6)}", lambda: f"{pick(low, 6)}!{pick(low, 5)}", lambda: f"{pick(low, 4)}_{pick(low, 5)}_{pick(low, 6)}", lambda: f"{pick(string.digits, 4)} {pick(string.digits, 4)} {pick(string.digits, 4)} {pick(string.digits, 4)}", lambda: f"/{pick(low, 4)}/{pick(low, 6)}/{pick(low, 5)}.txt", lambda: f"{rng.choice(['the', 'my', 'your'])} {pick(low, 5)} is {pick(low, rng.randint(4, 12))}",
    ])()


def fit(texts: list[str], seed: int = 7) -> crf.Model | None:
    rng = random.Random(seed)
    sample, spans = [], []
    for text in sorted(texts) * COPIES:
        pieces = text.split(" ")
        made = []
        for _ in range(rng.choice([0, 2, 4, 8, 12])):
            made.append((rng.randrange(len(pieces) + 1), _made(rng)))
        made += [(rng.randrange(len(pieces) + 1), (_harmless(rng), "", "")) for _ in range(rng.choice([2, 4, 8, 16]))]
        out, own, at = [], [], 0
        for i, piece in enumerate([*pieces, ""]):
            for _, (before, value, after) in (x for x in made if x[0] == i):
                whole = before + value + after
                if value:
                    own.append((at + len(before), at + len(before) + len(value)))
                out.append(whole)
                at += len(whole) + 1
            out.append(piece)
            at += len(piece) + 1
        whole = " ".join(out)
        found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(whole) if len(m[2]) >= 6] + [(a, b) for a, kind, b in base(whole) if kind]
        sample.append(whole)
        spans.append(sorted({*own, *found}))
    if not sample:
        return None
    (part,) = slices(pa.array(sample, pa.string()), 1 << 40)
    w, at = tokens(part), _points(part)
    if not len(w.hash):
        return None
    zero = np.repeat(at[part.bounds[:-1]], w.counts())
    start, end = at[w.start] - zero, at[w.end] - zero
    gold = np.zeros(len(start), dtype=np.int64)
    for r, own in enumerate(spans):
        a, b = int(w.rows[r]), int(w.rows[r + 1])
        for x, y in own:
            held = np.flatnonzero((end[a:b] > x) & (start[a:b] < y)) + a
            gold[held] = INSIDE
            gold[held[:1]] = BEGIN
    return crf.train(features(part, w), gold, _first(w), ["outside", "begin", "inside"], BITS, epochs=6, banned=[(OUTSIDE, INSIDE)], banned_starts=[INSIDE])


def scanned(documents: DataFrame, model: crf.Model | None, keep: list[str]) -> DataFrame:
    """`keep` and an array of (kind, start, end), by start and then kind as in KINDS."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights for three labels
    schema = extended(documents, keep, "spans array<struct<kind:string,start:int,end:int>>")
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for part in slices(batch.column("text")):
                w = tokens(part)
                added = {}
                if own is not None and len(w.hash):
                    added = tagged(part, w, crf.viterbi(own.emissions(features(part, w)), _first(w), own.moves, own.starts))
                for row in range(part.last - part.first):
                    found = base(part.text(row))
                    found += [(a, 3, b) for a, b in apart(added.get(row, []), found)]
                    rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, kind_of)], [*keep, "spans"])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def fitted(documents: DataFrame, sample: int = SAMPLE) -> crf.Model | None:
    rows = documents.where(F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS))
    return fit([r.text for r in hashed_sample(rows.select("doc_id", "text"), "doc_id", sample).collect()])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = scanned(documents, fitted(documents), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    fixed = F.filter("spans", lambda s: s.kind != KINDS[3])
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
