"""Which documents and paragraphs of an entity add something: exact copies, decisions, spans; coverage.py has the loop over retained ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.functions.text import collapsed

#: Redundancy counts only strictly above.
THRESHOLD = 0.80


def exact_copies(documents: DataFrame, entity: str, key: str, text: str) -> DataFrame:
    """Each document and the first of its entity with equal text but for wrapping and case (or null)."""
    same = Window.partitionBy(entity, F.xxhash64(collapsed(F.col(text))), F.sha2(collapsed(F.col(text)), 256))
    first = F.min(key).over(same)
    return documents.select(entity, key, F.when(F.col(text).isNotNull() & (first != F.col(key)), first).alias("copy_of"))


def decision(p_no: Column) -> Column:
    return F.when(p_no > THRESHOLD, "exclude_redundant").otherwise("retain")


def numbered_paragraphs(paragraphs: DataFrame, document: str, position: str, text: str) -> DataFrame:
    """Numbers P00001… in each document, and skip_redundant for exact copies of an earlier paragraph of it."""
    order = Window.partitionBy(document).orderBy(position)
    same = Window.partitionBy(document, collapsed(F.col(text))).orderBy(position)
    status = F.when(F.row_number().over(same) > 1, "skip_redundant").otherwise("add")
    return paragraphs.select(document, position, F.format_string("P%05d", F.row_number().over(order)).alias("number"), status.alias("status"))


def merged_blocks(blocks: DataFrame, key: str, text: str, origin: str) -> DataFrame:
    """Equal blocks of a key stored once, with how many and which origins they came from."""
    digest = F.sha2(collapsed(F.col(text)), 256)
    return blocks.groupBy(key, digest.alias("block_sha256")).agg(F.count("*").alias("occurrences"), F.count_distinct(origin).alias("origins"), F.min(origin).alias("first_origin"))


def exact_fragments(paragraphs: DataFrame, fragments: DataFrame, paragraph: str) -> DataFrame:
    """The fragments, and as `exact` whether their text is the paragraph's there; the paragraph's body isn't kept."""
    both = fragments.join(paragraphs.select(paragraph, "body"), paragraph)
    own = F.substring("body", F.col("fragment_start") - F.col("offset_start") + 1, F.col("fragment_end") - F.col("fragment_start"))
    return both.select(*(c for c in fragments.columns if c != "fragment_body"), (own == F.col("fragment_body")).alias("exact"))


def tiling_errors(fragments: DataFrame, paragraph: str) -> DataFrame:
    """fragments: paragraph, offset_start, offset_end, fragment_start, fragment_end, exact (or body and fragment_body).

    Paragraphs whose fragments, by start, don't follow each other without gap or overlap from the
    paragraph's start to its end, or whose text differs from the paragraph's there; with the first reason.
    """
    order = Window.partitionBy(paragraph).orderBy("fragment_start", "fragment_end")
    before = F.coalesce(F.lag("fragment_end").over(order), F.col("offset_start"))
    last = F.lead("fragment_start").over(order).isNull()
    own = lambda: F.substring("body", F.col("fragment_start") - F.col("offset_start") + 1, F.col("fragment_end") - F.col("fragment_start"))
    exact = F.col("exact") if "exact" in fragments.columns else own() == F.col("fragment_body")
    reason = (
        F.when(F.col("fragment_start") > before, "gap")
        .when(F.col("fragment_start") < before, "overlap")
        .when((F.col("fragment_end") <= F.col("fragment_start")) | (F.col("fragment_end") > F.col("offset_end")), "bounds")
        .when(~exact, "body")
        .when(last & (F.col("fragment_end") != F.col("offset_end")), "missing_tail")
    )
    rows = fragments.withColumn("reason", reason).where("reason is not null")
    return rows.groupBy(paragraph).agg(F.min_by("reason", F.struct("fragment_start", "fragment_end")).alias("reason"))


def selected_spans(paragraphs: DataFrame, votes: DataFrame) -> DataFrame:
    """paragraphs: paragraph, status, body, offset_start, offset_end; votes: paragraph, fragment_start, fragment_end, fragment_body, decision.

    Reference paragraphs and those without votes come whole; of others the redundant fragments go, the
    useful are `add` and the rest `add_uncertain`. Other statuses select nothing. Check with
    tiling_errors first.
    """
    open_ = paragraphs.where(F.col("status").isin("reference", "add", "add_uncertain"))
    voted = open_.where("status != 'reference'").join(votes, "paragraph")
    whole = open_.join(voted.select("paragraph").distinct(), "paragraph", "left_anti").select("paragraph", "status", "body", "offset_start", "offset_end")
    parts = voted.where(~F.col("decision").eqNullSafe(F.lit("redundant"))).select("paragraph", F.when(F.col("decision") == "useful", "add").otherwise("add_uncertain").alias("status"), F.col("fragment_body").alias("body"), F.col("fragment_start").alias("offset_start"), F.col("fragment_end").alias("offset_end"))
    return whole.unionByName(parts)


def contained_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, block, start, end) of old blocks with the number of new blocks of the doc that hold them whole.

    An equi-join on the document carries the range condition; old blocks should lie in exactly one.
    """
    b = new.select("doc", F.col("start").alias("new_start"), F.col("end").alias("new_end"))
    holds = (F.col("new_start") <= F.col("start")) & (F.col("end") <= F.col("new_end"))
    joined = old.join(b, "doc", "left")
    return joined.groupBy("doc", "block").agg(F.count_if(holds).alias("holders"))


#: Tokens of a question's context above which it isn't asked (a fixed value).
CONTEXT_TOKENS = 2048


def paragraph_additions(paragraphs: DataFrame, metadata: Column) -> DataFrame:
    """paragraphs: entity, document, rank (of the document), position, text, is_reference, scores, context_tokens. Each with its number, status, reason, sha256 and covered_by.

    In order of rank, document and position: `metadata` where the condition holds; `reference` in a reference document; skip_redundant
    as a copy, but for wrapping and case, of a paragraph of the entity that was kept before (covered_by names the first
    one), or if every unit's score is strictly above THRESHOLD; add_uncertain if the context is too long to be asked about or a unit has
    no score; else add. A paragraph that was skipped for its score covers no copy of it.
    """
    place = F.struct("rank", "document", "position")
    digest = F.sha2(collapsed(F.col("text")), 256)
    rows = paragraphs.withColumns({"metadata_": F.coalesce(metadata, F.lit(False)), "digest_": digest, "place_": place})
    known = F.coalesce(F.size("scores") > 0, F.lit(False)) & F.coalesce(F.forall("scores", lambda s: s.isNotNull()), F.lit(False))
    too_long = F.coalesce(F.col("context_tokens") > CONTEXT_TOKENS, F.lit(False))
    redundant = known & ~too_long & F.coalesce(F.forall("scores", lambda s: s > THRESHOLD), F.lit(False))
    kept = ~F.col("metadata_") & (F.coalesce("is_reference", F.lit(False)) | ~redundant)
    first = rows.where(kept).groupBy("entity", "digest_").agg(F.min("place_").alias("first_"))
    rows = rows.join(first, ["entity", "digest_"], "left")
    copy = F.coalesce(F.col("place_") > F.col("first_"), F.lit(False))
    reason = (
        F.when(F.col("metadata_"), "metadata").when(F.coalesce("is_reference", F.lit(False)), "reference").when(copy, "exact_copy")
        .when(too_long, "context_too_long").when(~known, "unanswered").when(redundant, "scored").otherwise("adds")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("metadata", "reference"), F.col("reason")).when(F.col("reason").isin("exact_copy", "scored"), "skip_redundant").when(F.col("reason") == "adds", "add").otherwise("add_uncertain")
    number = F.format_string("P%05d", F.row_number().over(Window.partitionBy("entity", "document").orderBy("position")))
    covered = F.when(F.col("reason") == "exact_copy", F.struct(F.col("first_.document").alias("document"), F.col("first_.position").alias("position")))
    return rows.select("entity", "document", "position", number.alias("number"), status.alias("status"), "reason", F.sha2("text", 256).alias("sha256"), covered.alias("covered_by"))
