"""Bounded samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.tables import written

#: Characters of a sampled text at most; longer ones are not learned from.
MOST_CHARS = 20_000
#: Labels whose counts are broadcast (some 50 bytes each).
MOST_BROADCAST = 100_000


def learnable(doc_id: str = "doc_id"):
    """False for the documents that are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def labelled_sample(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About per_class rows of each label, drawn by a hash of the key, and never more than twice that in all.

    Labels are counted first, so that a rare label gets its rows at any size of the table; every label is
    sampled. The counts, a row for each label, are joined back as a table, which is broadcast if it has at
    most MOST_BROADCAST rows.
    """
    counts = written(rows.groupBy(label).count().withColumnsRenamed({label: "label_", "count": "count_"}), "labels")
    classes = counts.count()
    counts = F.broadcast(counts) if classes <= MOST_BROADCAST else counts
    drawn = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / float(1 << 30)
    held = rows.join(counts, F.col(label) == F.col("label_")).where(drawn < per_class / F.col("count_"))
    return held.select(*rows.columns).orderBy(F.xxhash64(key), key).limit(2 * per_class * max(1, classes))


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows that come first by a hash of the key.

    Rows are counted first, and those far down the order go before it is made: together the partitions
    send the driver about twice `most` rows, at any size of the table.
    """
    place, share = F.xxhash64(key), 2 * most / max(1, rows.count())
    if share < 1:
        rows = rows.where(place < int(share * 2.0**64) - (1 << 63))
    return rows.orderBy(place, key).limit(most)
