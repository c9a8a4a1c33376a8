"""Catalogs of originals: one row of equal content, first place seen, and completeness of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import stable_id

#: Suffixes by kind (fixed values); anything else is auxiliary.
DOCUMENTS = ("pdf", "html", "htm", "php", "txt", "doc", "docx", "xls", "xlsx", "md", "rtf", "odt")
MEDIA = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "mp3", "mp4", "ogg", "wav")


def file_kind(path: Column, head: Column | None = None) -> Column:
    """document, media or auxiliary by suffix; a .php file that begins as a JPEG is media."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kind = F.when(suffix.isin(*DOCUMENTS), "document").when(suffix.isin(*MEDIA), "media").otherwise("auxiliary")
    return kind if head is None else F.when((suffix == "php") & (F.hex(head) == "FFD8FF"), "media").otherwise(kind)


def catalog(files: DataFrame) -> DataFrame:
    """files: sha256, collection, path, scope (order of scopes), bytes. One row for each content.

    The place seen first, by scope and path, is canonical and the rest are copies, listed in its row; where a
    content can have a great many places, as empty files have, firsts() and copies() hold no list.
    """
    place = F.struct("scope", "path", "collection")
    rows = files.groupBy("sha256").agg(F.sort_array(F.collect_list(place)).alias("places"), F.max("bytes").alias("bytes"))
    return rows.select(
        stable_id(F.col("sha256")).alias("id"),
        "sha256",
        "bytes",
        F.col("places")[0]["path"].alias("path"),
        F.col("places")[0]["collection"].alias("collection"),
        F.transform(F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(1))), lambda p: p["path"]).alias("copies"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["collection"]))).alias("collections"),
    )


def firsts(files: DataFrame) -> DataFrame:
    """One row of each content: its first place, how many copies it has, and the collections that have it."""
    rows = files.groupBy("sha256").agg(F.min(F.struct("scope", "path", "collection")).alias("place"), (F.count("*") - 1).alias("n_copies"), F.max("bytes").alias("bytes"), F.array_sort(F.collect_set("collection")).alias("collections"))
    return rows.select(stable_id(F.col("sha256")).alias("id"), "sha256", "bytes", "place.path", "place.collection", "n_copies", "collections")


def copies(files: DataFrame) -> DataFrame:
    """(id, path, copy_of) of the places that aren't the first of their content."""
    first = firsts(files).select("sha256", "id", F.col("path").alias("copy_of"))
    return files.join(first, "sha256").where("path != copy_of").select("id", "path", "copy_of")


def missing_units(sources: DataFrame, present: DataFrame) -> DataFrame:
    """sources: (source, pages); present: (source, page). Pages 1..pages that aren't there."""
    wanted = sources.where("pages > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    return wanted.join(present.select("source", F.col("page").cast("int").alias("page")).distinct(), ["source", "page"], "left_anti")


def drift(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status of every key of either side: same, changed, missing (right) or extra (left)."""
    a, b = left.select(key, F.col(digest).alias("a"), F.lit(True).alias("in_a")), right.select(key, F.col(digest).alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def ready(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """sources: (source, pages); pages: (source, page). Sources whose distinct pages are as many as said."""
    have = pages.groupBy("source").agg(F.count_distinct("page").alias("have"))
    return sources.join(have, "source").where("have = pages").select("source", "pages")


def publication_plan(built: DataFrame, published: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Each (path, sha256) three ways: copy, keep, update, or refuse where the disk was edited locally."""
    rows = built.select("path", F.col("sha256").alias("new")).join(published.select("path", F.col("sha256").alias("old")), "path", "left")
    rows = rows.join(on_disk.select("path", F.col("sha256").alias("disk")), "path", "left")
    action = F.when(F.col("disk").isNull(), "copy").when(F.col("disk") == F.col("new"), "keep").when(F.col("disk").eqNullSafe(F.col("old")), "update").otherwise("refuse")
    return rows.select("path", action.alias("action"))
