"""Places in one total order, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.operators.graph import cut

_WITHIN = (1 << 33) - 1


def placed(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, by the columns `order`, which tell all rows apart.

    A range-partitioned sort gives each row its place in its partition; partitions' sizes, one number
    each, give what comes before. The sorted rows are checkpointed, so that both agree.
    """
    key = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumns({"part_": F.shiftright(key, 33).cast("int"), "at_": key.bitwiseAND(F.lit(_WITHIN))}))
    before, total = [], 0
    for part, n in sorted((r["part_"], r["count"]) for r in ordered.groupBy("part_").count().collect()):
        before.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "part_ int, before_ long")
    return ordered.join(F.broadcast(starts), "part_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")
