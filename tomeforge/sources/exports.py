"""Exports of nodes as JSON lines in parts, with a manifest of content hashes; parts that are the same aren't written again.

A node's claims, citations or relations are lines of at most CHUNK items, each with the node, the kind and
the chunk's number, so that a node with any number of them is never collected. Chunks are counted by
the items' places in one range sort of all items, and written once as a table of their own; from there each
task writes its lines into the parts' files without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.operators.graph import own_folder
from tomeforge.operators.index import bucket
from tomeforge.operators.ordered import placed
from tomeforge.sources.versions import Versions

CHUNK = 100


def chunked(items: DataFrame, order: list[str], kind: str, chunk: int = CHUNK) -> DataFrame:
    """items: (node, item, and the columns `order`, which tell a node's items apart). (node, kind, chunk, items) in order."""
    rows = placed(items, "node", *order)
    first = rows.groupBy("node").agg(F.min("place").alias("first"))
    rows = rows.join(first, "node").withColumn("at", F.col("place") - F.col("first"))
    listed = rows.groupBy("node", F.floor(F.col("at") / chunk).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("held"))  # `chunk` at most
    path = own_folder(items.sparkSession, f"export-{kind}")  # lines are read for the digests, for ranges and to be written, and by each export
    made = listed.select("node", F.lit(kind).alias("kind"), "chunk", F.col("held.item").alias("items"))
    made.write.parquet(path)
    return items.sparkSession.read.schema(made.schema).parquet(path)


def lines(sections: list[DataFrame], parts: int) -> DataFrame:
    """(part, node, kind, chunk, value) of the sections' rows (node, kind, chunk, items); value is the JSON line."""
    made = [s.select("node", "kind", "chunk", F.to_json(F.struct("node", "kind", "chunk", "items")).alias("value")) for s in sections]
    out = made[0]
    for rows in made[1:]:
        out = out.union(rows)
    return out.withColumn("part", bucket(F.col("node").cast("string"), parts))


def _share(line: Column, start: int) -> Column:
    return F.sum(F.conv(F.substring(F.sha2(line, 256), start, 15), 16, 10).cast("decimal(38,0)"))


def digests(rows: DataFrame) -> DataFrame:
    """(part, n_lines, digest): sums of two pieces of the lines' SHA-256, which don't depend on their order."""
    value = F.col("value")
    held = rows.groupBy("part").agg(F.count("*").alias("n_lines"), _share(value, 1).alias("a"), _share(value, 16).alias("b"))
    return held.select("part", "n_lines", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


class Export:
    """Versions of an export in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Versions(spark, folder)

    def write(self, rows: DataFrame) -> list[int]:
        """rows: as lines() gives them. Writes the parts whose content differs from the newest version's, and says which; none: no new version."""
        new = {str(r["part"]): [r["n_lines"], r["digest"]] for r in digests(rows).collect()}  # a row for each part
        manifest = self.store.manifest()
        old = manifest.get("digests", {})
        changed = sorted(int(p) for p in new.keys() | old.keys() if new.get(p) != old.get(p))
        if changed:
            self.store.commit({"lines": (rows.where(F.col("part").isin(changed)), changed, [])}, manifest["version"], {"digests": new}, kind="text")
        return changed

    def read(self) -> DataFrame:
        """(value, part) of the newest version."""
        return self.store.read("lines")

    def errors(self) -> DataFrame:
        """(part, error) of parts whose lines aren't those of the manifest: lines where the number differs, else digest."""
        said = self.store.manifest().get("digests", {})
        wanted = self.store.spark.createDataFrame([(int(p), n, d) for p, (n, d) in said.items()], "part int, wanted long, wanted_digest string")
        rows = wanted.join(digests(self.read()), "part", "full_outer")
        error = F.when(~F.col("n_lines").eqNullSafe(F.col("wanted")), "lines").when(F.col("digest") != F.col("wanted_digest"), "digest")
        return rows.select("part", error.alias("error")).where("error is not null")
