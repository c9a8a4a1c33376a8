from pyspark.sql import functions as F

from tomeforge.operators import rules


def found(rows):
    return sorted((r.owner, r.what, r.rule) for r in rows.collect())


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


SQUARE = points((0, 0), (10, 0), (10, 10), (0, 10))


def test_plans(spark):
    decks = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "A")], "ship string, deck string")
    rooms = spark.createDataFrame([("s", "r1", "A"), ("s", "r2", "B"), ("t", "r1", "A")], "ship string, id string, deck string")
    plans = spark.createDataFrame([("s", "p", "A"), ("s", "q", "Z"), ("t", "p", "A")], "ship string, id string, deck string")
    rows = [
        ("s", "p", "ok", "r1", SQUARE), ("s", "p", "free", None, SQUARE), ("s", "p", "q", None, SQUARE), ("s", "p", "deck", "r2", SQUARE), ("s", "p", "room", "none", SQUARE), ("s", "x", "plan", None, SQUARE),
        ("s", "p", "line", None, points((0, 0), (5, 5), (10, 10))), ("s", "p", "out", None, points((0, 0), (101, 0), (0, 10))), ("s", "p", "two", None, points((0, 0), (1, 0))), ("t", "p", "ok", "r1", SQUARE),
    ]
    regions = spark.createDataFrame(rows, "ship string, plan string, id string, room string, points array<struct<x:double,y:double>>")
    assert found(rules.plan_errors(decks, rooms, plans, regions)) == sorted([("s", "q", "repeated_id"), ("s", "q", "unknown_deck"), ("s", "deck", "wrong_room"), ("s", "room", "wrong_room"), ("s", "plan", "unknown_plan"), ("s", "line", "no_area"), ("s", "out", "bad_points"), ("s", "two", "bad_points")])
    assert found(rules.plan_errors(decks, rooms, plans.where("id = 'p'"), regions.where("id = 'ok'"))) == []


def test_ids_of_many_regions_are_counted_in_many_tasks_and_points_once(spark, monkeypatch):
    monkeypatch.setattr(rules, "TASK_IDS", 20, raising=False)
    decks = spark.createDataFrame([("s", "A")], "ship string, deck string")
    rooms = spark.createDataFrame([], "ship string, id string, deck string")
    plans = spark.createDataFrame([("s", "p", "A")], "ship string, id string, deck string")
    regions = spark.range(1000).selectExpr("'s' as ship", "'p' as plan", "case when id % 100 = 0 then 'p' when id % 100 = 1 then 'twice' else 'r' || id end as id", "cast(null as string) as room", "id % 250 as n")
    made = F.when(F.col("n") == 0, F.array()).otherwise(F.array(*(F.struct(F.lit(p["x"]).alias("x"), (F.lit(p["y"]) * (F.col("n") % 250 > 1).cast("int")).alias("y")) for p in SQUARE)))
    regions = regions.withColumn("points", made.cast("array<struct<x:double,y:double>>"))
    errors = rules.plan_errors(decks, rooms, plans, regions)
    assert found(errors) == sorted([("s", "p", "repeated_id"), ("s", "twice", "repeated_id"), *[("s", "p", "bad_points")] * 2, ("s", "r250", "bad_points"), ("s", "r750", "bad_points")] + [("s", x, "no_area") for x in ("twice", "r251", "twice", "r751")])
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert ", 51), REPARTITION_BY_NUM" in plan


def test_media(spark):
    good = "/runtime/media/rooms/a.b/c.png"
    rows = [("r", "a", good, None, "official"), ("r", "b", "/asset/x_1-2", "", "personal"), ("q", "a", good, "", "interpretation"), ("r", "c", "/asset/x/y", "", "official"), ("r", "d", "/runtime/media/../x", "", "official"), ("r", "e", f"{good}\n", "", "official"), ("r", "f", None, "", None), ("r", "g", good, "x" * 501, "official"), ("r", "h h", good, "", "official"), ("r", "a", good, "", "official")]
    rows += [("many", f"m{i}", good, "", "official") for i in range(101)]
    media = spark.createDataFrame(rows, "room string, id string, url string, caption string, provenance string")
    got = [(o or "", w or "", r) for o, w, r in ((x.owner, x.what, x.rule) for x in rules.media_errors(media).collect())]
    assert sorted(got) == sorted([("r", "c", "url"), ("r", "d", "url"), ("r", "e", "url"), ("r", "f", "url"), ("r", "f", "provenance"), ("r", "g", "caption"), ("r", "h h", "invalid_id"), ("r", "a", "repeated_id"), ("many", "", "too_many")])


def test_navigation(spark):
    entities = spark.createDataFrame([("e",)], "id string")
    nodes = spark.createDataFrame([("a", ["e"], {"x": 1.0, "y": 2.0}), ("b", [], {"x": 3.0, "y": 4.0}), ("c", ["none"], None)], "id string, entities array<string>, position struct<x:double,y:double>")
    line = points((1, 2), (50, 50), (3, 4))
    rows = [("ok", "a", "b", line, None, None), ("a", "a", "b", line, 1.0, 2.0), ("same", "a", "a", points((1, 2), (1, 2)), None, None), ("lost", "a", "c", line, None, None), ("none", "x", "b", line, None, None), ("loose", "a", "b", points((1, 2), (3, 4.5)), None, None), ("empty", "a", "b", [], None, None), ("back", "b", "a", line, None, None), ("late", "a", "b", line, 2.0, 1.0), ("half", "a", "b", line, 2.0, None)]
    routes = spark.createDataFrame(rows, "id string, from string, to string, points array<struct<x:double,y:double>>, hours_min double, hours_max double")
    wanted = [("map", "a", "repeated_id"), ("c", "none", "unknown_entity"), ("route", "same", "same_ends"), ("route", "lost", "no_position"), ("route", "none", "no_position"), *(("route", i, "detached") for i in ("loose", "empty", "back")), ("route", "late", "hours"), ("route", "half", "hours")]
    assert found(rules.navigation_errors(entities, nodes, routes)) == sorted(wanted)


def test_members_campaigns_and_schedules(spark):
    rows = [("c", "é-1_a", "n", "{}", "{}", "{}"), ("c", "x" * 101, "n", "{}", "{}", "{}"), ("c", "b", " ", None, "{}", None), ("d", "b", "n", "{}", None, "{}"), ("c", "b", "n", "{}", "{}", "{}")]
    members = spark.createDataFrame(rows, "campaign string, id string, name string, history string, stats string, assignments string")
    assert found(rules.member_errors(members)) == sorted([("c", "x" * 101, "invalid_id"), ("c", "b", "no_name"), ("c", "b", "no_history"), ("c", "b", "no_assignments"), ("d", "b", "no_stats"), ("c", "b", "repeated_id")])
    whole = '{"crew":{"members":[]},"ship":{"rooms":[],"decks":[]},"droids":{"catalog":[]},"operations":{},"skills":{"rankings":{}},"history":{"groups":[]}}'
    campaigns = spark.createDataFrame([("ok", whole), ("no", whole.replace('"rooms":[]', '"rooms":{}').replace('"operations":{}', '"operations":null')), ("bad", "{"), ("null", None)], "id string, json string")
    got = found(rules.campaign_errors(campaigns))
    assert [g for g in got if g[0] == "no"] == [("no", "operations", "structure"), ("no", "ship.rooms", "structure")] and len(got) == 16
    schedules = spark.createDataFrame([("a", 0, 23), ("b", 5, 5), ("c", -1, 3), ("d", 3, 24), ("e", None, 3)], "id string, shift1 int, shift2 int")
    assert [(r.owner, r.rule) for r in rules.schedule_errors(schedules).orderBy("owner", F.desc("rule")).collect()] == [("b", "same_start"), ("c", "hour"), ("d", "hour"), ("e", "hour")]
