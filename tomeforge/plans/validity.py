"""Queries over data that breaks the rules of campaigns, ships, media, maps and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.operators import rules
from tomeforge.plans.base import query

SHIP_SQL = """
with decks as (select n_nationkey as ship, 'D' || d as deck from nation, range(6) as t(d)), rooms as (select n_nationkey as ship, 'room-' || d as id, 'D' || d as deck from nation, range(7) as t(d)),
plans as (select s_nationkey as ship, 'plan-' || s_suppkey as id, 'D' || (s_suppkey % 7) as deck from supplier),
pts as (select l_orderkey as o, list({'x': case when l_orderkey % 41 = 0 then l_quantity * 3 else l_quantity end, 'y': case when l_orderkey % 43 = 1 then 0 else l_discount * 100 end} order by l_linenumber, l_partkey, l_suppkey) as v from lineitem group by 1),
r as (select s_nationkey as ship, 'plan-' || (s_suppkey + case when o_orderkey % 59 = 2 then 100000 else 0 end) as plan, case when o_orderkey % 97 = 0 then 'plan-' || s_suppkey else 'reg-' || o_orderkey end as id,
    case when o_orderkey % 6 > 0 then 'room-' || (s_suppkey % 7 + case when o_orderkey % 13 = 0 then 1 else 0 end) end as room, coalesce(v, []) as v from orders join supplier on s_suppkey = o_custkey % 10 left join pts on o = o_orderkey),
q as (select *, len(v) between 3 and 500 and len(list_filter(v, lambda p: p.x < 0 or p.x > 100 or p.y < 0 or p.y > 100)) = 0 as inside, list_sum([v[i].x * v[i % len(v) + 1].y - v[i % len(v) + 1].x * v[i].y for i in range(1, len(v) + 1)]) as area from r),
j as (select q.*, plans.deck as plan_deck, rooms.deck as room_deck from q left join plans on plans.ship = q.ship and plans.id = q.plan left join rooms on rooms.ship = q.ship and rooms.id = q.room)
select ship::varchar as owner, id as what, 'repeated_id' as rule from (select ship, id from plans union all select ship, id from r) group by ship, id having count(*) > 1
union all select ship::varchar, id, 'unknown_deck' from plans where (ship, deck) not in (select (ship, deck) from decks)
union all select ship::varchar, id, 'unknown_plan' from j where plan_deck is null
union all select ship::varchar, id, 'wrong_room' from j where room is not null and plan_deck is not null and room_deck is distinct from plan_deck
union all select ship::varchar, id, 'bad_points' from j where not inside
union all select ship::varchar, id, 'no_area' from j where inside and abs(area) < 1e-5
"""


@query(SHIP_SQL)
def ship_errors(table, spark):
    """V5: plans and regions with ids, decks, rooms or polygons that break the rules."""
    ship = F.col("n_nationkey").alias("ship")
    numbered = lambda n: table("nation").select(ship, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("d"))
    deck = F.concat(F.lit("D"), F.col("d").cast("string")).alias("deck")
    s, o, k = F.col("s_suppkey"), F.col("o_orderkey"), F.col("l_orderkey")
    plan = lambda n: F.concat(F.lit("plan-"), n.cast("string"))
    plans = table("supplier").select(F.col("s_nationkey").alias("ship"), plan(s).alias("id"), F.concat(F.lit("D"), (s % 7).cast("string")).alias("deck"))
    x = F.when(k % 41 == 0, F.col("l_quantity") * 3).otherwise(F.col("l_quantity"))
    y = F.when(k % 43 == 1, 0.0).otherwise(F.col("l_discount") * 100)
    v = table("lineitem").groupBy(k.alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y")))).alias("v"))
    v = v.select("o_orderkey", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    regions = table("orders").join(table("supplier"), s == F.col("o_custkey") % 10).join(v, "o_orderkey", "left").select(
        F.col("s_nationkey").alias("ship"), plan(s + F.when(o % 59 == 2, 100000).otherwise(0)).alias("plan"), F.when(o % 97 == 0, plan(s)).otherwise(F.concat(F.lit("reg-"), o.cast("string"))).alias("id"),
        F.when(o % 6 > 0, F.concat(F.lit("room-"), (s % 7 + F.when(o % 13 == 0, 1).otherwise(0)).cast("string"))).alias("room"), F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>")).alias("points"),
    )
    rooms = numbered(7).select("ship", F.concat(F.lit("room-"), F.col("d").cast("string")).alias("id"), deck)
    return rules.plan_errors(numbered(6).select("ship", deck), rooms, plans, regions)


MEDIA_SQL = """
with m as (select s_nationkey as room, case when s_suppkey % 19 = 1 then 'm/' || s_suppkey when s_suppkey % 17 = 1 then 'm-1' else 'm-' || s_suppkey end as id,
    case s_suppkey % 6 when 0 then '/asset/x-' || s_suppkey when 1 then '/runtime/media/rooms/' || s_suppkey || '.png' when 2 then '/runtime/media/rooms/../' || s_suppkey when 3 then 'https://host/' || s_suppkey when 4 then '/runtime/media//x.png' else '/asset/' || repeat('a', 600) end as url,
    repeat('c', case when s_suppkey % 23 = 3 then 501 else 500 end) as caption, case when s_suppkey % 29 = 4 then 'rumour' when s_suppkey % 2 = 0 then 'official' else 'personal' end as provenance from supplier)
select room::varchar as owner, id as what, 'invalid_id' as rule from m where id like 'm/%' union all select room::varchar, id, 'url' from m where not (url like '/asset/x-%' or url like '/runtime/media/rooms/%.png')
union all select room::varchar, id, 'caption' from m where length(caption) > 500 union all select room::varchar, id, 'provenance' from m where provenance = 'rumour'
union all select room::varchar, id, 'repeated_id' from m group by room, id having count(*) > 1 union all select room::varchar, null, 'too_many' from m group by room having count(*) > 100
"""


@query(MEDIA_SQL)
def media_errors(table, spark):
    """V6: media of rooms whose ids, URLs, captions or provenance break the rules."""
    s = F.col("s_suppkey")
    text = s.cast("string")
    url = (
        F.when(s % 6 == 0, F.concat(F.lit("/asset/x-"), text)).when(s % 6 == 1, F.concat(F.lit("/runtime/media/rooms/"), text, F.lit(".png"))).when(s % 6 == 2, F.concat(F.lit("/runtime/media/rooms/../"), text))
        .when(s % 6 == 3, F.concat(F.lit("https://host/"), text)).when(s % 6 == 4, "/runtime/media//x.png").otherwise(F.concat(F.lit("/asset/"), F.repeat(F.lit("a"), 600)))
    )
    id_ = F.when(s % 19 == 1, F.concat(F.lit("m/"), text)).when(s % 17 == 1, "m-1").otherwise(F.concat(F.lit("m-"), text))
    caption = F.when(s % 23 == 3, F.repeat(F.lit("c"), 501)).otherwise(F.repeat(F.lit("c"), 500))
    provenance = F.when(s % 29 == 4, "rumour").when(s % 2 == 0, "official").otherwise("personal")
    return rules.media_errors(table("supplier").select(F.col("s_nationkey").alias("room"), id_.alias("id"), url.alias("url"), caption.alias("caption"), provenance.alias("provenance")))


MAP_SQL = """
with e as (select 'part-' || p_partkey as id from part where p_partkey % 50 <> 7),
n as (select 'node-' || c_custkey as id, ['part-' || (c_custkey % 40), 'part-' || (c_custkey % 40 + 3)] as entities, c_custkey % 31 <> 4 as placed, c_custkey % 100 as x, c_custkey % 7 as y from customer),
r as (select case when o_orderkey % 211 = 0 then 'node-' || o_custkey else 'route-' || o_orderkey end as id, 'node-' || o_custkey as f, 'node-' || case when o_orderkey % 83 = 5 then o_custkey when o_orderkey % 71 = 6 then -1 else o_custkey + 1 end as t, o_custkey as c, o_orderkey as o,
    case when o_orderkey % 61 = 1 then -1.0 when o_orderkey % 67 = 2 then null else 2.0 end as low, case when o_orderkey % 73 = 3 then 1.0 else 4.0 end as high from orders),
p as (select r.*, a.placed as a_placed, b.placed as b_placed, a.x as ax, a.y as ay, b.x as bx, b.y as by_, case when o % 37 = 8 then c % 100 + 0.5 else c % 100 end as fx, c % 7 as fy, (c + 1) % 100 as tx, (c + 1) % 7 as ty from r left join n a on a.id = f and a.placed left join n b on b.id = t and b.placed)
select 'map' as owner, id as what, 'repeated_id' as rule from (select id from n union all select id from r) group by id having count(*) > 1
union all select id, x, 'unknown_entity' from (select id, unnest(entities) as x from n) where x not in (select id from e)
union all select 'route', id, 'same_ends' from r where f = t
union all select 'route', id, 'no_position' from p where a_placed is null or b_placed is null
union all select 'route', id, 'detached' from p where a_placed and (ax <> fx or ay <> fy) or b_placed and (bx <> tx or by_ <> ty)
union all select 'route', id, 'hours' from r where low is null or low <= 0 or high < low
"""


@query(MAP_SQL)
def map_errors(table, spark):
    """V7: nodes and routes of a map with ids, entities, ends, positions, lines or hours that break the rules."""
    c, k, o = F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderkey")
    entities = table("part").where("p_partkey % 50 != 7").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"))
    part = lambda n: F.concat(F.lit("part-"), n.cast("string"))
    node = lambda n: F.concat(F.lit("node-"), n.cast("string"))
    at = lambda n, more=0.0: F.struct(((n % 100).cast("double") + more).alias("x"), (n % 7).cast("double").alias("y"))
    nodes = table("customer").select(node(c).alias("id"), F.array(part(c % 40), part(c % 40 + 3)).alias("entities"), F.when(c % 31 != 4, at(c)).alias("position"))
    to = F.when(o % 83 == 5, k).when(o % 71 == 6, -1).otherwise(k + 1)
    routes = table("orders").select(
        F.when(o % 211 == 0, node(k)).otherwise(F.concat(F.lit("route-"), o.cast("string"))).alias("id"), node(k).alias("from"), node(to).alias("to"),
        F.array(at(k, F.when(o % 37 == 8, 0.5).otherwise(0.0)), at(k + 50), at(k + 1)).alias("points"),
        F.when(o % 61 == 1, -1.0).when(o % 67 == 2, None).otherwise(2.0).alias("hours_min"), F.when(o % 73 == 3, 1.0).otherwise(4.0).alias("hours_max"),
    )
    return rules.navigation_errors(entities, nodes, routes)


MEMBERS_SQL = """
with m as (select c_nationkey as campaign, case when c_custkey % 47 = 1 then 'a b' when c_custkey % 53 = 2 then null when c_custkey % 9 = 4 then 'é_' || (c_custkey % 90) else 'm-' || c_custkey end as id, case when c_custkey % 37 = 3 then '  ' when c_custkey % 41 = 0 then null else c_name end as name,
    c_custkey % 29 <> 5 as history, c_custkey % 31 <> 6 as stats, c_custkey % 43 <> 7 as assignments from customer)
select campaign::varchar as owner, id as what, rule from (
    select campaign, id, unnest([case when id is null or id = 'a b' then 'invalid_id' end, case when trim(coalesce(name, '')) = '' then 'no_name' end, case when not history then 'no_history' end, case when not stats then 'no_stats' end, case when not assignments then 'no_assignments' end]) as rule from m) where rule is not null
union all select campaign::varchar, id, 'repeated_id' from m where id is not null group by campaign, id having count(*) > 1
"""


@query(MEMBERS_SQL)
def member_errors(table, spark):
    """V2: members of campaigns whose ids, names or parts break the rules."""
    c = F.col("c_custkey")
    id_ = F.when(c % 47 == 1, "a b").when(c % 53 == 2, None).when(c % 9 == 4, F.concat(F.lit("é_"), (c % 90).cast("string"))).otherwise(F.concat(F.lit("m-"), c.cast("string")))
    name = F.when(c % 37 == 3, "  ").when(c % 41 == 0, None).otherwise(F.col("c_name"))
    has = lambda n, at, name: F.when(c % n != at, "{}").alias(name)
    return rules.member_errors(table("customer").select(F.col("c_nationkey").alias("campaign"), id_.alias("id"), name.alias("name"), has(29, 5, "history"), has(31, 6, "stats"), has(43, 7, "assignments")))


CAMPAIGN_SQL = """
with c as (select s_suppkey as id, s_suppkey % 11 as n from supplier)
select id::varchar as owner, part as what, 'structure' as rule from c, (values ('crew.members', 1), ('ship.rooms', 2), ('ship.decks', 3), ('droids.catalog', 4), ('operations', 5), ('skills.rankings', 6), ('history.groups', 7), ('crew.members', 8)) as v(part, place) where n = place or n = 9
group by id, part
"""


@query(CAMPAIGN_SQL)
def campaign_errors(table, spark):
    """V2: campaigns whose JSON lacks a part, has something else than a list there, or can't be read."""
    n = F.col("s_suppkey") % 11
    list_ = lambda at: F.when(n == at, F.lit("{}")).otherwise(F.lit("[1]"))
    members = F.when(n == 1, F.lit("null")).when(n == 8, F.lit('"none"')).otherwise(F.lit("[]"))
    text = F.concat(
        F.lit('{"crew": {"members": '), members, F.lit('}, "ship": {"rooms": '), list_(2), F.lit(', "decks": '), list_(3), F.lit('}, "droids": {"catalog": '), list_(4), F.lit("}"),
        F.when(n == 5, F.lit("")).otherwise(F.lit(', "operations": {"posts": []}')), F.lit(', "skills": '), F.when(n == 6, F.lit("{}")).otherwise(F.lit('{"rankings": {"a": 1}}')), F.lit(', "history": {"groups": '), list_(7), F.when(n == 9, F.lit("")).otherwise(F.lit("}}")),
    )
    return rules.campaign_errors(table("supplier").select(F.col("s_suppkey").alias("id"), text.alias("json")))


@query("""
with s as (select event_id as id, event_id % 27 - 1 as a, case when event_id % 13 = 0 then event_id % 27 - 1 when event_id % 17 = 0 then null else event_id % 29 end as b from events)
select id::varchar as owner, null::varchar as what, 'hour' as rule from s where not coalesce(a between 0 and 23 and b between 0 and 23, false) union all select id::varchar, null, 'same_start' from s where a = b
""")
def schedule_errors(table, spark):
    """V8: schedules whose two shifts don't begin at two hours of a day."""
    e = F.col("event_id")
    second = F.when(e % 13 == 0, e % 27 - 1).when(e % 17 == 0, None).otherwise(e % 29)
    return rules.schedule_errors(table("events").select(e.alias("id"), (e % 27 - 1).alias("shift1"), second.alias("shift2")))
