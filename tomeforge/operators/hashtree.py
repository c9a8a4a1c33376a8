"""Trees of hashes over a corpus (unit, source, bucket, corpus), compared from the root.

A tree is stored as versioned parts (see sources/versions.py): `leaves` (source, unit, kind, sha256) and `sources`
(source, n, digest) in buckets of the source, and each bucket's digest in the manifest. A digest is the number and two
sums of pieces of what is below, so that it needs no order and a source with any number of units is added up
in parts. Two trees are compared by their manifests; of buckets that differ the sources are read, and of sources that
differ the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.operators.index import bucket
from tomeforge.sources.versions import Versions

BUCKETS = 64
LEAF = ["source", "unit", "kind", "sha256"]


def _sum(digest: Column, start: int) -> Column:
    return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def _folded(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """(keys, n, digest) of the rows, whose own hash is that of the columns `parts`."""
    own = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)), 256)
    held = rows.withColumn("own_", own).groupBy(*keys).agg(F.count("*").alias("n"), _sum(F.col("own_"), 1).alias("a"), _sum(F.col("own_"), 16).alias("b"))
    return held.select(*keys, "n", F.concat_ws("-", "a", "b").alias("digest"))


class HashTree:
    def __init__(self, spark: SparkSession, folder: str):
        self.store = Versions(spark, folder)

    def write(self, leaves: DataFrame, buckets: int = BUCKETS) -> HashTree:
        """leaves: (source, unit, kind, sha256); the next version of the tree."""
        rows = leaves.select(*LEAF).withColumn("part", bucket(F.col("source").cast("string"), buckets))
        by_source = lambda done: _folded(done["leaves"], ["part", "source"], LEAF)
        version = self.store.number()
        held = self.store.manifest(version) if version else None
        # digests of buckets go into the manifest, so they are made from the rows that are written
        digests = {str(r["part"]): [r["n"], r["digest"]] for r in _folded(_folded(rows, ["part", "source"], LEAF), ["part"], ["source", "n", "digest"]).collect()}
        old = held.get("digests", {}) if held else {}
        changed = sorted(int(p) for p in digests.keys() | old.keys() if digests.get(p) != old.get(p))
        if changed or held is None:
            some = rows.where(F.col("part").isin(changed))
            self.store.commit({"leaves": (some, changed, ["source", "kind", "unit"]), "sources": (by_source, changed, ["source"])}, version, {"digests": digests})
        return self

    def root(self) -> dict[str, list]:
        """The digests of the buckets, which are what the corpus is made of."""
        return self.store.manifest()["digests"]


def differing(left: HashTree, right: HashTree) -> list[int]:
    a, b = left.root(), right.root()
    return sorted(int(p) for p in a.keys() | b.keys() if a.get(p) != b.get(p))


def drift(left: HashTree, right: HashTree) -> DataFrame:
    """(source, unit, kind, status) of leaves that aren't the same: missing (in right), extra or changed. Only differing branches are read."""
    parts = differing(left, right)
    a, b = left.store.read("sources", parts), right.store.read("sources", parts)
    other = b.select("part", "source", F.col("n").alias("n_"), F.col("digest").alias("digest_"))
    sources = a.join(other, ["part", "source"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("digest_")) | ~F.col("n").eqNullSafe(F.col("n_"))).select("part", "source")
    key = ["source", "unit", "kind"]
    held = lambda tree, name: tree.store.read("leaves", parts).join(sources, ["part", "source"], "left_semi").select(*key, F.col("sha256").alias(name))
    both = held(left, "a").join(held(right, "b"), key, "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select(*key, status.alias("status")).where("status is not null")


def corpus_errors(catalog: DataFrame, publications: DataFrame, listed: DataFrame, published: HashTree, checkpoint: HashTree, links: DataFrame, resources: DataFrame, files: DataFrame) -> DataFrame:
    """(source, what, error) of a published corpus.

    catalog: (source, sha256, pages, skipped); publications: (source, sha256, images_linked); listed: (source, unit, sha256) of
    the Markdown that a publication says it has; published, checkpoint: trees of the files with the kinds markdown, structure,
    scan and image; links: (source, unit, target) of local images; resources: (file, sha256); files: (file, sha256, linked)
    that are there. Skipped sources are left out; of a source without publication that alone is said.
    """
    wanted = catalog.where("not coalesce(skipped, false)").select("source", "sha256", "pages")
    has = publications.select("source", F.col("sha256").alias("said"), "images_linked")
    open_ = wanted.join(has, "source", "left")
    there = open_.where("said is not null")
    say = lambda rows, what, error: rows.select(F.col("source").cast("string").alias("source"), what.cast("string").alias("what"), error.alias("error"))
    nothing = F.lit(None).cast("string")
    ours = there.select("source")
    leaves = published.store.read("leaves").where("kind = 'markdown'").select("source", "unit", F.col("sha256").alias("own"))
    markdown = listed.join(ours, "source", "left_semi").join(leaves, ["source", "unit"], "left")
    pages = there.where("pages > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("unit"))
    moved = drift(checkpoint, published).where("kind != 'markdown' and status != 'extra'").join(ours, "source", "left_semi")
    target = links.join(ours, "source", "left_semi").join(files.select(F.col("file").alias("target")).distinct(), "target", "left_anti")
    on_disk = files.select("file", F.col("sha256").alias("own"), "linked")
    alone = resources.join(on_disk, "file", "left").where("own is null or linked or own != sha256").withColumn("source", nothing)
    return (
        say(open_.where("said is null"), nothing, F.lit("missing_publication"))
        .union(say(there.where("said != sha256"), nothing, F.lit("bad_provenance")))
        .union(say(markdown.where("own is null or own != sha256"), F.col("unit"), F.lit("bad_markdown")))
        .union(say(pages.join(leaves.select("source", "unit"), ["source", "unit"], "left_anti"), F.col("unit"), F.lit("missing_unit")))
        .union(say(moved, F.col("unit"), F.concat(F.col("status"), F.lit("_"), F.col("kind"))))
        .union(say(target, F.col("target"), F.lit("broken_link")))
        .union(say(there.where("images_linked"), nothing, F.lit("linked_images")))
        .union(say(alone, F.col("file"), F.lit("standalone_resource")))
    )
