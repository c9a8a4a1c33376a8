"""Toxic spans and document scores by a linear-chain CRF.

Only documents carry labels, so tokens are labelled first: a word is marked in toxic training
documents if it, or one of its beginnings, stands in many of them, in texts that differ from each
other, and hardly in clean ones. The CRF learns these tokens from hashed words, affixes, n-grams and neighbours; its
forward-backward marginals give each document's expected number of toxic words, their largest
probability and their density, which a logistic curve fitted on the same training documents turns
into the score. Words with a marginal of at least 0.5 are the offending spans.

The model is fitted on a bounded sample (`per_class` documents of either label, of at most
samples.MOST_CHARS characters), never on held-out documents. A null or empty text has no words and
gets the score of no evidence; very long texts are scored whole, window by window. An empty table gives
an empty result. Without rows of both labels every score is 0. Repeated rows are scored
one by one; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import crf
from tomeforge.llm.samples import MOST_CHARS, labelled_sample, learnable
from tomeforge.llm.tables import extended, mapped, table
from tomeforge.llm.textbytes import Slice, Words, mix, slices, words

BITS = 16
PER_CLASS = 500
THRESHOLD = 0.7
#: A mark's documents: at least so many distinct ones, this share of them, and so many times the clean share.
LEAST_DOCUMENTS, LEAST_SHARE, TIMES = 5, 0.02, 20
#: Bytes of a word's beginnings that may be marks, besides whole words.
BEGINNINGS = (4, 5, 6)


class ToxicityModel:
    model: crf.Model
    curve: np.ndarray

    def features(self, w: Words) -> list[np.ndarray]:
        heads, tails = crf.affixes(w, 6)
        zero = np.zeros(1, np.uint64)
        values = [w.hash, *heads[2:], *tails[1:3], *crf.grams(w, 3, 2), np.concatenate([zero, w.hash[:-1]]), np.concatenate([w.hash[1:], zero])]
        return [crf.slot(v, k, BITS) for v, k in zip(values, [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9], strict=True)]

    def words(self, w: Words) -> np.ndarray:
        """Probability that each word is toxic."""
        if not len(w.hash):
            return np.zeros(0)
        return crf.long_marginals(self.model, self.features, w, _first(w))[:, 1]

    def documents(self, w: Words, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_evidence(w, p) @ self.curve))


def _first(w: Words) -> np.ndarray:
    first = np.zeros(len(w.hash), dtype=bool)
    first[w.rows[:-1][w.counts() > 0]] = True
    return first


def _evidence(w: Words, p: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; without words all but the constant are 0."""
    counts, total = w.counts(), np.concatenate([[0], np.cumsum(p)])
    total = total[w.rows[1:]] - total[w.rows[:-1]]
    most = np.zeros(len(counts))
    if some := np.flatnonzero(counts > 0).tolist():
        most[some] = np.maximum.reduceat(p, w.rows[:-1][some])
    return np.column_stack([np.ones(len(counts)), np.log1p(total), most, np.log1p(100 * total / np.maximum(counts, 1))])


def marked(w: Words, toxic: np.ndarray) -> np.ndarray:
    """True at the words that mark toxic texts; copies of one text count about once."""
    row = w.row_of()
    likeness = np.full(len(toxic), np.iinfo(np.int64).max, np.int64).astype(np.uint64)
    np.minimum.at(likeness, row, mix(w.hash + np.uint64(1)))
    totals = [max(1, len(np.unique(likeness[toxic == y]))) for y in (0, 1)]
    heads, _ = crf.affixes(w, max(BEGINNINGS))
    out = np.zeros(len(row), dtype=bool)
    for key in (w.hash, *(heads[n - 1] for n in BEGINNINGS)):
        values, at = np.unique(key, return_inverse=True)
        pairs = np.unique(np.column_stack([at.astype(np.uint64), likeness[row], toxic[row].astype(np.uint64)]), axis=0)
        counts = [np.bincount(pairs[pairs[:, 2] == y, 0].astype(np.int64), minlength=len(values)) for y in (0, 1)]
        often = counts[1] >= max(LEAST_DOCUMENTS, LEAST_SHARE * totals[1])
        out |= (often & (counts[1] / totals[1] >= TIMES * (counts[0] + 0.5) / totals[0]))[at]
    return out & (toxic[row] == 1)


def fit(rows: list[tuple[str, int]]) -> ToxicityModel | None:
    """rows: texts and 1 for toxic."""
    rows = sorted(rows)
    toxic = np.array([y for _, y in rows])
    if len(set(toxic.tolist())) < 2:
        return None
    (part,) = slices(pa.array([t for t, _ in rows], pa.string()), 1 << 40)
    w = words(part)
    gold = marked(w, toxic)
    made = ToxicityModel()
    made.model = crf.train(made.features(w), gold.astype(np.int64), _first(w), ["clean", "toxic"], BITS, epochs=4)
    x = _evidence(w, made.words(w))
    made.curve = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ made.curve))
        step = x.T @ (p - toxic) + 0.5 * made.curve
        made.curve -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(step)), step)
    return made


def _spans(part: Slice, w: Words, p: np.ndarray) -> list[str]:
    """start:end of each offending word in code points of its text, comma-joined, for each text."""
    at = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    out = [[] for _ in range(len(w.rows) - 1)]
    for i in np.flatnonzero(p >= 0.5):
        row = int(np.searchsorted(w.rows, i, side="right")) - 1
        zero = at[part.bounds[row]]
        out[row].append(f"{at[w.start[i]] - zero}:{at[w.end[i]] - zero}")
    return [",".join(x) for x in out]


def scored(documents: DataFrame, model: ToxicityModel | None, keep: list[str]) -> DataFrame:
    """`keep`, the score and the offending spans."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights for two labels
    schema = extended(documents, keep, "score double,spans string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores, spans = [], []
            for part in slices(batch.column("text")):
                w = words(part)
                p = own.words(w) if own else np.zeros(len(w.hash))
                scores += (own.documents(w, p) if own else np.zeros(len(w.rows) - 1)).tolist()
                spans += _spans(part, w, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], [*keep, "score", "spans"])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def fitted(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel | None:
    labels = labels.where(learnable() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    drawn = labelled_sample(labels, "doc_id", "toxic", per_class)  # at most 4 * per_class rows
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS)).select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class)
    return fit([(r.text, r.toxic) for r in rows.collect()])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = scored(documents, fitted(documents, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
