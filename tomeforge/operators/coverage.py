"""Which documents of an entity add something to those retained before them, as rounds over an inverted index.

In order of position, a document is held against the retained documents of its entity that come before
it: exact text, then cumulative exact units, then new numbers, then answers about its open units. What
it is held against are features (its profile, whole text, units and numbers): a feature counts as kept
for a document if an earlier retained document has it. So a feature is settled by its first holder that
isn't excluded, and a document waits only for the features whose first such holder is another
undecided one.

Each round looks that holder up for every feature, by one aggregation, and decides all documents
whose selection is the same whatever their unsettled features turn out to be. The first undecided document
of an entity has none, so each round decides some; rounds are as many as documents that wait for each
other in a row. Reasons follow when all selections are known. An entity with any number of documents is
spread over all tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.batches import bounded, give_back
from tomeforge.functions.records import profile
from tomeforge.operators.curation import THRESHOLD
from tomeforge.operators.graph import cut

_NUMBERS = re.compile(r"\d+(?:[.,]\d+)?(?:\s*[dD](?:\s*\+\s*\d)?)?")
PROFILE, WHOLE, UNIT, NUMBER = 0, 1, 2, 3
OPEN, RETAINED, EXCLUDED = 0, 1, 2


def units(text: str) -> list[str]:
    """Paragraphs in the form in which they are equal."""
    return [" ".join(u.lower().split()) for u in re.split(r"\n\s*\n", text) if u.strip()]


def features(documents: DataFrame) -> DataFrame:
    """(uid, kind, feature, p) of each document's features, once each; p: how probably a unit adds nothing, if it was asked."""
    bounded(documents.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                body = row.body or ""
                answers = json.loads(row.answers) if row.answers else {}
                own = json.dumps(profile(row.profile), sort_keys=True)
                found = {(WHOLE, " ".join(body.lower().split()))} | {(UNIT, u) for u in units(body)} | {(NUMBER, "".join(x.lower().split())) for x in _NUMBERS.findall(body)}
                found |= {(PROFILE, own)} if own != "{}" else set()
                for kind, value in found:
                    digest = hashlib.blake2b(f"{row.entity}\0{kind}\0{value}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    p = answers.get(value, answers.get("*")) if kind == UNIT else None
                    out.append((row.uid, kind, digest, None if p is None else float(p)))
            yield pd.DataFrame(out, columns=["uid", "kind", "feature", "p"]).astype({"p": "float64"})
        give_back()

    rows = documents.select("uid", F.to_json(F.struct("entity")).alias("entity"), "body", "profile", "answers").mapInPandas(run, "uid long, kind int, feature string, p double")
    return rows.withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def _count(kind: int, *conditions):
    held = F.col("kind") == kind
    for c in conditions:
        held = held & c
    return F.coalesce(F.count_if(held), F.lit(0))


#: Counts of a document's features: of each kind those that are new to it, unsettled and kept, and the units among them whose answer is bad.
def _tallies(state):
    new, unknown, kept = state == "new", state == "unknown", state == "kept"
    bad = ~F.coalesce(F.col("p") > THRESHOLD, F.lit(False))
    return [
        _count(PROFILE, new).alias("profile_new"), _count(PROFILE, unknown).alias("profile_unknown"),
        _count(WHOLE, kept).alias("whole_kept"), _count(WHOLE, unknown).alias("whole_unknown"),
        _count(UNIT).alias("units"), _count(UNIT, new).alias("unit_new"), _count(UNIT, unknown).alias("unit_unknown"), _count(UNIT, new, bad).alias("unit_new_bad"), _count(UNIT, unknown, bad).alias("unit_unknown_bad"),
        _count(UNIT, new, F.col("p").isNull()).alias("unit_new_unasked"),
        _count(NUMBER, new).alias("number_new"), _count(NUMBER, unknown).alias("number_unknown"),
    ]


def _possible() -> tuple:
    """Whether a document can turn out excluded, and retained, by its tallies."""
    n = lambda name: F.col(name) > 0
    all_kept, not_all_kept = n("units") & ~n("unit_new"), ~n("units") | n("unit_new") | n("unit_unknown")
    good_unknown = F.col("unit_unknown") > F.col("unit_unknown_bad")
    excluded = ~n("unit_new_bad") & (n("unit_new") | good_unknown)  # by answers
    retained = n("unit_new_bad") | n("unit_unknown_bad") | ~n("units")
    excluded, retained = ~n("number_new") & excluded, n("number_new") | n("number_unknown") | retained
    excluded, retained = all_kept | (not_all_kept & excluded), not_all_kept & retained
    whole_maybe, whole_not = n("whole_kept") | n("whole_unknown"), ~n("whole_kept")
    excluded, retained = whole_maybe | (whole_not & excluded), whole_not & retained
    return ~n("profile_new") & excluded, n("profile_new") | n("profile_unknown") | retained


def selections(documents: DataFrame, held: DataFrame) -> DataFrame:
    """(uid, rank, status) of all documents: RETAINED or EXCLUDED."""
    first = documents.groupBy("entity").agg(F.min(F.struct("rank", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    status = documents.join(first, "uid", "left").select("uid", "rank", F.when(F.coalesce("is_first", F.lit(False)) | F.col("image"), RETAINED).otherwise(OPEN).alias("status"))
    status = cut(status)
    while not status.where(F.col("status") == OPEN).isEmpty():
        holder = held.join(status.where(F.col("status") != EXCLUDED), "uid").groupBy("feature").agg(F.min(F.struct("rank", "status")).alias("holder"))
        waiting = status.where(F.col("status") == OPEN).select("uid", "rank")
        rows = held.join(waiting, "uid").join(holder, "feature")
        state = F.when(F.col("holder.rank") == F.col("rank"), "new").when(F.col("holder.status") == RETAINED, "kept").otherwise("unknown")
        tallies = rows.groupBy("uid").agg(*_tallies(state))
        excluded, retained = _possible()
        decided = tallies.select("uid", F.when(excluded & ~retained, EXCLUDED).when(retained & ~excluded, RETAINED).otherwise(OPEN).alias("now"))
        status = cut(status.join(decided, "uid", "left").select("uid", "rank", F.coalesce("now", "status").alias("status")))
    return status


def coverage(documents: DataFrame) -> DataFrame:
    """documents: entity, document, position, body, profile (JSON or null), has_image, answers.

    (entity, document, selection, reason, covered_by) of each. An excluded document never covers another. `answers` is
    a JSON object of each normalised unit's (or "*"'s) probability of adding nothing, which must all be
    above THRESHOLD. Null texts are empty ones; null positions come last; a document is one row of its entity.
    """
    wanted = documents.select("entity", "document", "position", "body", "profile", "has_image", "answers").withColumn("uid", F.monotonically_increasing_id())
    wanted = cut(wanted)  # ids that stay
    rank = F.struct(F.col("position").isNull().alias("last"), F.col("position").alias("position"), F.col("document").alias("document"), F.col("uid").alias("uid"))
    image = F.coalesce("has_image", F.lit(False)) & (F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")) == "")
    facts = wanted.select("uid", "entity", "document", rank.alias("rank"), image.alias("image"))
    held = cut(features(wanted))
    status = selections(facts, held)
    kept = facts.join(status.where(F.col("status") == RETAINED).select("uid"), "uid", "left_semi").select("uid", "rank")
    owner = held.join(kept, "uid").groupBy("feature").agg(F.min("rank").alias("owner"))
    first = facts.groupBy("entity").agg(F.min(F.struct("rank", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    rows = held.join(facts.select("uid", "rank"), "uid").join(owner, "feature", "left")
    is_kept = F.coalesce(F.col("owner") < F.col("rank"), F.lit(False))
    own = F.col("owner.document")
    tallies = rows.groupBy("uid").agg(
        *_tallies(F.when(is_kept, "kept").otherwise("new")),
        F.max(F.when(is_kept & (F.col("kind") == WHOLE), own)).alias("whole_owner"),
        F.sort_array(F.collect_set(F.when(is_kept & (F.col("kind") == UNIT), own))).alias("owners"),
    )
    n = lambda name: F.col(name) > 0
    reason = (
        F.when(F.coalesce("is_first", F.lit(False)), "reference")
        .when(F.col("image"), "non_text_source")
        .when(n("profile_new"), "distinct_profile")
        .when(n("whole_kept"), "exact_normalized_text")
        .when(n("units") & ~n("unit_new"), "exact_unit_coverage")
        .when(n("number_new"), "new_numeric_or_dice_information")
        .when(n("unit_new") & ~n("unit_new_bad"), "every_unit_redundant")
        .when(n("unit_new_unasked"), "deferred")
        .otherwise("contributes")
    )
    done = facts.join(tallies, "uid").join(first, "uid", "left").withColumn("reason", reason)
    excluded = F.col("reason").isin("exact_normalized_text", "exact_unit_coverage", "every_unit_redundant")
    none = F.slice("owners", 1, 0)
    covered = F.when(F.col("reason") == "exact_normalized_text", F.array("whole_owner")).when(F.col("reason") == "exact_unit_coverage", F.col("owners")).otherwise(none)
    return done.select("entity", "document", F.when(excluded, "exclude_redundant").otherwise("retain").alias("selection"), "reason", covered.alias("covered_by"))
