"""Rules of campaigns, ships, media, navigation and schedules, as tables of what breaks them: (owner, what, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.records import is_polygon

#: Identifiers, confined local URLs, provenances and limits (fixed values).
IDENTIFIER = r"^[\p{L}\p{N}_-]{1,100}\z"
LOCAL_URL = r"^(?:/asset/[A-Za-z0-9_-]+|/runtime/media/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+)\z"
PROVENANCES = ("official", "personal", "interpretation")
MOST_MEDIA, MOST_POINTS, URL_LENGTH, CAPTION_LENGTH = 100, 500, 600, 500
#: Ids that one task counts, about 130 MB; left to itself Spark puts 64 MB of short ids together, millions of them.
TASK_IDS = 500_000
#: Parts of a campaign, and whether they are lists (fixed values).
CAMPAIGN_PARTS = {"crew.members": True, "ship.rooms": True, "ship.decks": True, "droids.catalog": True, "operations": False, "skills.rankings": False, "history.groups": True}


def _say(rows: DataFrame, owner: Column, what: Column, rule: str) -> DataFrame:
    return rows.select(owner.cast("string").alias("owner"), what.cast("string").alias("what"), F.lit(rule).alias("rule"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def campaign_errors(campaigns: DataFrame) -> DataFrame:
    """campaigns: (id, json). Parts that are missing, or aren't lists where they must be; a JSON that can't be read lacks all."""
    rows = []
    for part, is_list in CAMPAIGN_PARTS.items():
        found = F.get_json_object("json", f"$.{part}")
        ok = found.startswith("[") if is_list else found.isNotNull() & ~found.isin("", "false", "0")
        rows.append(F.when(~_holds(ok), F.lit(part)))
    broken = campaigns.select("id", F.explode(F.array_compact(F.array(*rows))).alias("part"))
    return _say(broken, F.col("id"), F.col("part"), "structure")


def member_errors(members: DataFrame) -> DataFrame:
    """members: (campaign, id, name, history, stats, assignments). An error for each broken rule of a member; an id that is repeated, once."""
    rules = {
        "invalid_id": F.col("id").rlike(IDENTIFIER),
        "no_name": F.length(F.trim("name")) > 0,
        "no_history": F.col("history").isNotNull(),
        "no_stats": F.col("stats").isNotNull(),
        "no_assignments": F.col("assignments").isNotNull(),
    }
    repeated = members.where("id is not null").groupBy("campaign", "id").count().where("count > 1")
    return _all([*(_say(members.where(~_holds(ok)), F.col("campaign"), F.col("id"), name) for name, ok in rules.items()), _say(repeated, F.col("campaign"), F.col("id"), "repeated_id")])


def plan_errors(decks: DataFrame, rooms: DataFrame, plans: DataFrame, regions: DataFrame) -> DataFrame:
    """decks: (ship, deck); rooms: (ship, id, deck); plans: (ship, id, deck); regions: (ship, plan, id, room, points of x and y).

    Plans and regions share one namespace in a ship. A plan's deck is one of the ship's, and a region's room,
    where it has one, is on that deck. Points are 3 to 500 within 0 to 100, and enclose an area.
    """
    named = plans.select("ship", "id").union(regions.select("ship", "id"))
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, -(-named.count() // TASK_IDS))
    ids = named.repartition(tasks, "ship", "id").groupBy("ship", "id").count().where("count > 1")
    unknown = plans.join(decks.distinct(), ["ship", "deck"], "left_anti")
    on = regions.join(plans.groupBy("ship", F.col("id").alias("plan")).agg(F.min("deck").alias("plan_deck")), ["ship", "plan"], "left")
    on = on.join(rooms.groupBy("ship", F.col("id").alias("room")).agg(F.min("deck").alias("room_deck")), ["ship", "room"], "left")
    inside = F.forall("points", lambda p: p["x"].between(0, 100) & p["y"].between(0, 100)) & F.size("points").between(3, MOST_POINTS)
    shape = F.when(~_holds(inside), "bad_points").when(~_holds(is_polygon(F.col("points"))), "no_area")
    shapes = regions.select("ship", "id", shape.alias("rule")).where("rule is not null")  # one pass, since points may be dear to make
    return _all([
        _say(ids, F.col("ship"), F.col("id"), "repeated_id"),
        _say(unknown, F.col("ship"), F.col("id"), "unknown_deck"),
        _say(on.where("plan_deck is null"), F.col("ship"), F.col("id"), "unknown_plan"),
        _say(on.where(F.col("room").isNotNull() & F.col("plan_deck").isNotNull() & ~_holds(F.col("room_deck") == F.col("plan_deck"))), F.col("ship"), F.col("id"), "wrong_room"),
        shapes.select(F.col("ship").cast("string").alias("owner"), F.col("id").cast("string").alias("what"), "rule"),
    ])


def media_errors(media: DataFrame) -> DataFrame:
    """media: (room, id, url, caption, provenance). Ids are unique in a room, URLs local and without a way out, and a room has at most 100."""
    parts = F.split("url", "/")
    confined = F.col("url").rlike(LOCAL_URL) & ~F.array_contains(parts, "..") & (F.length("url") <= URL_LENGTH)
    rules = {
        "invalid_id": F.col("id").rlike(IDENTIFIER),
        "url": confined,
        "caption": F.length(F.coalesce("caption", F.lit(""))) <= CAPTION_LENGTH,
        "provenance": F.col("provenance").isin(*PROVENANCES),
    }
    counted = lambda *keys: media.groupBy(*keys).count()
    return _all([
        *(_say(media.where(~_holds(ok)), F.col("room"), F.col("id"), name) for name, ok in rules.items()),
        _say(counted("room", "id").where("count > 1"), F.col("room"), F.col("id"), "repeated_id"),
        _say(counted("room").where(F.col("count") > MOST_MEDIA), F.col("room"), F.lit(None), "too_many"),
    ])


def navigation_errors(entities: DataFrame, nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """entities: (id); nodes: (id, entities, position of x and y or null); routes: (id, from, to, points, hours_min, hours_max).

    Nodes and routes share one namespace, a node's entities exist, a route joins two nodes that have a position, its
    first and last points are theirs exactly, and known hours are positive and in order.
    """
    ids = nodes.select("id").union(routes.select("id")).groupBy("id").count().where("count > 1")
    named = nodes.select(F.col("id").alias("node"), F.explode("entities").alias("id"))
    at = nodes.where("position is not null").groupBy("id").agg(F.min("position").alias("position"))
    ends = routes
    for end in ("from", "to"):
        ends = ends.join(at.select(F.col("id").alias(end), F.col("position").alias(f"{end}_at")), end, "left")
    same = F.col("from").eqNullSafe(F.col("to"))
    loose = lambda point, end: F.col(end).isNotNull() & ~_holds((point["x"] == F.col(end)["x"]) & (point["y"] == F.col(end)["y"]))
    detached = loose(F.try_element_at("points", F.lit(1)), "from_at") | loose(F.try_element_at("points", F.lit(-1)), "to_at")
    hours = F.col("hours_min").isNotNull() | F.col("hours_max").isNotNull()
    route = F.lit("route")
    return _all([
        _say(ids, F.lit("map"), F.col("id"), "repeated_id"),
        _say(named.join(entities.select("id").distinct(), "id", "left_anti"), F.col("node"), F.col("id"), "unknown_entity"),
        _say(ends.where(same), route, F.col("id"), "same_ends"),
        _say(ends.where("from_at is null or to_at is null"), route, F.col("id"), "no_position"),
        _say(ends.where(detached), route, F.col("id"), "detached"),
        _say(routes.where(hours & ~_holds((F.col("hours_min") > 0) & (F.col("hours_max") >= F.col("hours_min")))), route, F.col("id"), "hours"),
    ])


def schedule_errors(schedules: DataFrame) -> DataFrame:
    """schedules: (id, shift1, shift2): two different hours, each from 0 to 23."""
    inside = F.col("shift1").between(0, 23) & F.col("shift2").between(0, 23)
    return _all([
        _say(schedules.where(~_holds(inside)), F.col("id"), F.lit(None), "hour"),
        _say(schedules.where(F.col("shift1") == F.col("shift2")), F.col("id"), F.lit(None), "same_start"),
    ])
