"""Language identification of words and documents by a linear-chain CRF.

Features of a word are its hashed self, affixes, inner n-grams, length and its place in a lexicon of
each language's frequent words; transitions between neighbouring words' languages are learned from
sequences that are put together from lines of different documents, so that code-switched text is
labelled word by word. Forward-backward marginals summed over a document give its language and score.

The model is fitted on a bounded sample (`per_class` documents of each language of at most
samples.MOST_CHARS characters), never on held-out documents. Texts that are null, empty or without a
letter are `und` with score 0; very long texts are labelled whole, window by window. An empty table gives
an empty result. With no labelled document at all, every document is `und`. Repeated
rows and clashing extra columns don't matter: rows are scored one by one and only named columns read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import crf
from tomeforge.llm.samples import MOST_CHARS, labelled_sample, learnable
from tomeforge.llm.tables import extended, mapped, table
from tomeforge.llm.textbytes import Slice, Words, slices, words

BITS = 16
PER_CLASS = 250
#: Words of a language's lexicon, and lines that make one training sequence.
LEXICON, LINES = 300, 8
UNKNOWN = "und"


class LanguageModel:
    def __init__(self, model: crf.Model, lexicon: dict[int, int]):
        self.model = model
        self.keys = np.array(sorted(lexicon), dtype=np.uint64)
        self.masks = np.array([lexicon[int(k)] for k in self.keys], dtype=np.uint64)

    def features(self, w: Words) -> list[np.ndarray]:
        heads, tails = crf.affixes(w)
        values = [w.hash, *heads, *tails, *crf.grams(w, 2, 3), *crf.grams(w, 3, 2)]
        kinds = [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 8, 8]
        values.append(np.minimum(w.end - w.start, 12))
        kinds.append(9)
        if len(self.keys):
            at = np.searchsorted(self.keys, w.hash)
            at[at == len(self.keys)] = 0
            values.append(np.where(self.keys[at] == w.hash, self.masks[at], np.uint64(0)))
            kinds.append(10)
        return [crf.slot(v, k, BITS) for v, k in zip(values, kinds, strict=True)]

    def words(self, w: Words) -> np.ndarray:
        """Probability of each language at each word."""
        first = np.zeros(len(w.hash), dtype=bool)
        first[w.rows[:-1][w.counts() > 0]] = True
        return crf.long_marginals(self.model, self.features, w, first)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel | None:
    """rows: texts and their languages."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    lines = [(line, names.index(lang)) for text, lang in sorted(rows) for line in text.split("\n") if line.strip()]
    lines = [lines[i] for i in rng.permutation(len(lines))]
    gold, starts, parts = [], [0], []
    counts: list[Counter] = [Counter() for _ in names]
    for part in slices(pa.array([t for t, _ in lines], pa.string()), 1 << 40):
        w = words(part)
        label = np.repeat([y for _, y in lines], w.counts())
        for y in range(len(names)):
            values, n = np.unique(w.hash[label == y], return_counts=True)
            counts[y].update(dict(zip(values.tolist(), n.tolist(), strict=True)))
        gold.append(label)
        parts.append(w)
    if not gold or not len(gold[0]):
        return None
    lexicon: dict[int, int] = {}
    for y, c in enumerate(counts):
        for word, _ in c.most_common(LEXICON):
            lexicon[word] = lexicon.get(word, 0) | (1 << (y % 63))
    made = LanguageModel(None, lexicon)
    w, label = parts[0], gold[0]
    first = np.zeros(len(label), dtype=bool)
    first[w.rows[:-1:LINES][w.rows[:-1:LINES] < len(label)]] = True
    first[0] = True
    made.model = crf.train(made.features(w), label, first, names, BITS, epochs=3, decay=1e-4, seed=seed)
    return made


def has_letter(part: Slice, row: int) -> bool:
    data = part.data[part.bounds[row] : part.bounds[row + 1]]
    letters = data | np.uint8(32)
    if bool(((letters >= 97) & (letters <= 122) & (data < 128)).any()):
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in part.text(row))


def identified(documents: DataFrame, model: LanguageModel | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep`, the predicted language and the share of the words' probability that it has, so named."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights a language
    schema = extended(documents, keep, "{} string,{} double".format(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            langs, scores = [], []
            for part in slices(batch.column("text")):
                w = words(part)
                share = np.zeros((len(w.rows) - 1, 1))
                if own is not None:
                    sums = np.concatenate([np.zeros((1, len(own.model.labels))), np.cumsum(own.words(w), axis=0)])
                    share = (sums[w.rows[1:]] - sums[w.rows[:-1]]) / np.maximum(w.counts(), 1)[:, None]
                best = share.argmax(axis=1)
                for row, count in enumerate(w.counts()):
                    known = own is not None and count and has_letter(part, row)
                    langs.append(own.model.labels[best[row]] if known else UNKNOWN)
                    scores.append(min(1.0, float(share[row, best[row]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return mapped(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def fitted(documents: DataFrame, per_class: int = PER_CLASS) -> LanguageModel | None:
    rows = documents.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS))
    sample = labelled_sample(rows.select("doc_id", "lang", "text"), "doc_id", "lang", per_class)
    return fit([(r.text, r.lang) for r in sample.collect()])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = identified(documents, fitted(documents), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
