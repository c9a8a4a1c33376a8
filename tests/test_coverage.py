import json
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomeforge.functions.records import profile
from tomeforge.operators import coverage

THRESHOLD = 0.8
NUMBERS = re.compile(r"\d+(?:[.,]\d+)?(?:\s*[dD](?:\s*\+\s*\d)?)?")


def units_of(text):
    return [" ".join(u.lower().split()) for u in re.split(r"\n\s*\n", text or "") if u.strip()]


def fold(group):
    keptunits_of: dict[str, str] = {}
    kept_texts = {}
    kept_numbers = set()
    kept_profiles = set()
    out = []
    for n, row in enumerate(group.sort_values(["position", "document"]).itertuples()):
        body = row.body or ""
        units, whole = units_of(body), " ".join(body.lower().split())
        numbers = {"".join(x.lower().split()) for x in NUMBERS.findall(body)}
        own_profile = json.dumps(profile(row.profile), sort_keys=True)
        answers = json.loads(row.answers) if row.answers else {}
        verdict, reason, covered = "retain", "reference" if n == 0 else "", []
        if n:
            if row.has_image and not whole:
                reason = "non_text_source"
            elif own_profile != "{}" and own_profile not in kept_profiles:
                reason = "distinct_profile"
            elif whole in kept_texts:
                verdict, reason, covered = "exclude_redundant", "exact_normalized_text", [kept_texts[whole]]
            elif units and all(u in keptunits_of for u in units):
                verdict, reason, covered = "exclude_redundant", "exact_unit_coverage", sorted({keptunits_of[u] for u in units})
            elif not numbers <= kept_numbers:
                reason = "new_numeric_or_dice_information"
            else:
                open_ = [u for u in units if u not in keptunits_of]
                sure = [answers.get(u, answers.get("*")) for u in open_]
                if open_ and all(p is not None and p > THRESHOLD for p in sure):
                    verdict, reason = "exclude_redundant", "every_unit_redundant"
                else:
                    reason = "deferred" if any(p is None for p in sure) else "contributes"
        if verdict == "retain":
            kept_texts.setdefault(whole, row.document)
            for u in units:
                keptunits_of.setdefault(u, row.document)
            kept_numbers |= numbers
            kept_profiles.add(own_profile)
        out.append((row.entity, row.document, verdict, reason, covered))
    return pd.DataFrame(out, columns=["entity", "document", "selection", "reason", "covered_by"])


SCHEMA = "entity string, document long, position int, body string, profile string, has_image boolean, answers string"


def made(rng, entity, size):
    """Documents of few words, so that texts, units and numbers meet again and again, and long chains wait for each other."""
    words = ["alpha", "Beta", "gamma 1", "delta 2D+1", "epsilon", "7"]
    out = []
    for i in range(size):
        units = [" ".join(rng.choices(words, k=rng.choice([1, 1, 2]))) for _ in range(rng.randrange(0, 4))]
        answers = rng.choice([None, None, {"*": 0.9}, {"*": 0.8}, {"alpha": 0.95, "beta": 0.99, "gamma 1": 0.81}])
        out.append((entity, i, rng.randrange(size), rng.choice(["\n\n", "\n \n\n"]).join(units) if units else rng.choice([None, "", " "]), rng.choice([None] * 6 + ['{"hull": "4D"}', '{"hull": "5D"}', "{}"]), rng.random() < 0.2, answers and json.dumps(answers)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [r for e in range(60) for r in made(rng, f"e{e}" if e else None, rng.randrange(1, 14))]
    got = {(r.entity, r.document): (r.selection, r.reason, r.covered_by) for r in coverage.coverage(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    wanted = {}
    for entity in {r[0] for r in rows}:
        own = frame[frame.entity.isna()] if entity is None else frame[frame.entity == entity]
        for r in fold(own).itertuples():
            wanted[entity, r.document] = (r.selection, r.reason, r.covered_by)
    assert got == wanted and len({r for _, r, _ in wanted.values()}) == 9


def test_a_large_entity_is_many_tasks(spark):
    n = 100_000
    d = F.col("id")
    body = F.concat(F.lit("unit "), (d % 40_000).cast("string"), F.lit("\n\nshared by all"), F.when(d % 5 == 0, F.concat(F.lit("\n\nunit "), (d * 7 % 40_000).cast("string"))).otherwise(""))
    rows = spark.range(n, numPartitions=8).select(F.lit("one").alias("entity"), d.alias("document"), d.cast("int").alias("position"), body.alias("body"), F.lit(None).cast("string").alias("profile"), F.lit(False).alias("has_image"), F.when(d % 3 == 0, '{"*": 0.9}').alias("answers"))
    began = time.time()
    got = {r.document: (r.selection, r.reason, r.covered_by) for r in coverage.coverage(rows).collect()}
    assert time.time() - began < 240
    frame = rows.toPandas()
    wanted = {r.document: (r.selection, r.reason, r.covered_by) for r in fold(frame).itertuples()}
    assert got == wanted


def test_no_documents(spark):
    assert coverage.coverage(spark.createDataFrame([], SCHEMA)).count() == 0
