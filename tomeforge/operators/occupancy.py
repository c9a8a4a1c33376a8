"""Who is where: people from assignments, possible extras by zone, and machines from posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRA_OF = {"shift1": "extra1", "shift2": "extra2"}


def occupancy(assignments: DataFrame, zones: DataFrame, posts: DataFrame, rooms: DataFrame, mode: str) -> DataFrame:
    """(room, kind, who, shared, extra) of a mode.

    assignments: person, cycle, rooms (array), zone, shared; zones: name, position, rooms; posts: rooms,
    droids (arrays); rooms: room. Extras follow the mode asked for and are off in an alert; a zone is
    the first of its name; unknown rooms are dropped.
    """
    own = assignments.where(F.col("cycle") == mode).select(F.explode("rooms").alias("room"), F.lit("person").alias("kind"), F.col("person").cast("string").alias("who"), "shared", F.lit(False).alias("extra"))
    first = zones.groupBy("name").agg(F.min_by("rooms", "position").alias("zone_rooms"))
    cycle = EXTRA_OF.get(mode)
    extra = assignments.where(F.col("cycle") == cycle if cycle else F.lit(False)).join(first, F.col("zone") == F.col("name"))
    extra = extra.select(F.explode("zone_rooms").alias("room"), F.lit("person").alias("kind"), F.col("person").cast("string").alias("who"), F.lit(True).alias("shared"), F.lit(True).alias("extra"))
    machines = posts.select(F.explode("rooms").alias("room"), "droids").select("room", F.lit("droid").alias("kind"), F.explode("droids").alias("who"), F.lit(False).alias("shared"), F.lit(False).alias("extra"))
    return own.unionByName(extra).unionByName(machines).join(rooms.select("room"), "room", "left_semi")


def snapshot(people: DataFrame, mode: str, seed: int) -> DataFrame:
    """One place drawn for each person: (person, place).

    people: person, posts (array of rooms of the mode), shared, grade, section, extra_rooms (array),
    deployed. The deployed are outside; a shared post is one of its rooms, another the first; in an alert
    .60/.20/.20 go to reserve, emergency quarters and mess; off duty half sleep, a quarter of the rest
    with an extra follow it, and then mess .30, training to .50, officers to .60, pilots to .75, and the
    others roam. Draws are by seed and person, so that a retried task draws the same.
    """
    draw = lambda n: (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "person"), F.lit(1 << 40)) / float(1 << 40))
    pick = lambda rooms, n: F.element_at(rooms, (F.floor(draw(n) * F.size(rooms)) + 1).cast("int"))
    on_duty = F.when(F.col("shared"), pick(F.col("posts"), 0)).otherwise(F.try_element_at("posts", F.lit(1)))
    alert = F.when(draw(1) < 0.6, "virtual-alert-reserve").when(draw(1) < 0.8, "emergency-quarters").otherwise("mess")
    roll = draw(2)
    off = (
        F.when(draw(3) < 0.5, "crew-quarters")
        .when((F.size("extra_rooms") > 0) & (draw(4) < 0.25), pick(F.col("extra_rooms"), 5))
        .when(roll < 0.3, "mess")
        .when(roll < 0.5, "training")
        .when((roll < 0.6) & F.col("grade").isin("Cpt", "LtChef", "Lt"), "officers-lounge")
        .when((roll < 0.75) & (F.col("section") == "Escadrille"), "pilots-room")
        .otherwise("virtual-roaming")
    )
    place = F.when(F.col("deployed"), "outside").when(F.size("posts") > 0, on_duty).otherwise(alert if mode == "alert" else off)
    return people.select("person", place.alias("place"))
