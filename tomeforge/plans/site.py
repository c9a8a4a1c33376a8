"""Queries over people, rooms, routes and schemas: occupancy, itineraries and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.functions.records import is_polygon
from tomeforge.operators import audit, graph, occupancy
from tomeforge.plans.base import ROUTES, query, routes

#: Orders as people, their lines as assignments, suppliers as rooms, nations as zones.
CREW = """
assign as (select l_orderkey as person, case l_linenumber % 4 when 0 then 'shift1' when 1 then 'shift2' when 2 then 'alert' else 'extra1' end as cycle, l_suppkey as room, l_suppkey % 25 as zone, l_quantity > 25 as shared from lineitem),
rooms as (select s_suppkey as room from supplier where s_suppkey % 9 <> 0),
zones as (select n_nationkey % 20 as name, n_nationkey as position, n_nationkey * 3 + 1 as room from nation),
posts as (select s_suppkey as room, 'R' || (s_suppkey % 5) as droid from supplier where s_suppkey % 8 = 0)
"""


def _assignments(table):
    line = F.col("l_linenumber") % 4
    cycle = F.when(line == 0, "shift1").when(line == 1, "shift2").when(line == 2, "alert").otherwise("extra1")
    return table("lineitem").select(F.col("l_orderkey").alias("person"), cycle.alias("cycle"), F.array("l_suppkey").alias("rooms"), (F.col("l_suppkey") % 25).alias("zone"), (F.col("l_quantity") > 25).alias("shared"))


def _rooms(table):
    return table("supplier").where("s_suppkey % 9 != 0").select(F.col("s_suppkey").alias("room"))


def _zones(table):
    n = F.col("n_nationkey")
    return table("nation").select((n % 20).cast("long").alias("name"), n.alias("position"), F.array((n * 3 + 1).cast("long")).alias("rooms"))


def _posts(table):
    s = F.col("s_suppkey")
    return table("supplier").where(s % 8 == 0).select(F.array(s).alias("rooms"), F.array(F.concat(F.lit("R"), (s % 5).cast("string"))).alias("droids"))


OCCUPANCY_SQL = f"""
with {CREW}, first as (select name, min_by(room, position) as room from zones group by name),
o as (select room, 'person' as kind, person::varchar as who, shared, false as extra from assign where cycle = 'shift1'
    union all select f.room, 'person', person::varchar, true, true from assign join first f on f.name = zone where cycle = 'extra1'
    union all select room, 'droid', droid, false, false from posts)
select o.room, kind, extra, count(*) as n, count(distinct who) as who, count(*) filter (where shared) as shared from o where room in (select room from rooms) group by 1, 2, 3
"""


@query(OCCUPANCY_SQL)
def room_occupancy(table, spark):
    """Who is in which room in the first shift, with possible extras and machines."""
    rows = occupancy.occupancy(_assignments(table), _zones(table), _posts(table), _rooms(table), "shift1")
    return rows.groupBy("room", "kind", "extra").agg(F.count("*").alias("n"), F.count_distinct("who").alias("who"), F.count_if("shared").alias("shared"))


@query(f"with {CREW} select (select count(*) from posts) as droids, (select count(distinct person) from assign) as assigned, (select count(*) from rooms) as rooms, (select count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) as unassigned")
def overview_counts(table, spark):
    """Sums of the overview; people without assignments are kept apart."""
    a = _assignments(table).select("person").distinct()
    people = table("orders").select(F.col("o_orderkey").alias("person")).join(a.withColumn("has", F.lit(True)), "person", "left")
    one = _posts(table).agg(F.sum(F.size("droids")).alias("droids")).crossJoin(a.agg(F.count("*").alias("assigned")))  # single rows side by side
    return one.crossJoin(_rooms(table).agg(F.count("*").alias("rooms"))).crossJoin(people.agg(F.count_if(F.col("has").isNull()).alias("unassigned")))


@query("select a.c_custkey as id, b.c_name as related, b.c_nationkey as section from customer a join customer b on b.c_custkey = a.c_custkey + 7 where a.c_nationkey = b.c_nationkey")
def related_people(table, spark):
    """Relations from person to person."""
    c = table("customer")
    b = c.select((F.col("c_custkey") - 7).alias("id"), F.col("c_name").alias("related"), F.col("c_nationkey").alias("section"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("section")).join(b, ["id", "section"]).select("id", "related", "section")


@query("select c_mktsegment as section, count(*) as members from customer group by 1")
def sections(table, spark):
    """G14."""
    return table("customer").groupBy(F.col("c_mktsegment").alias("section")).agg(F.count("*").alias("members"))


@query("select p_partkey as id, p_size as pips, cast(100 * p_size as double) / greatest(1, max(p_size) over (partition by p_brand)) as bar, rank() over (partition by p_brand order by p_size desc) as place from part")
def skill_bars(table, spark):
    """A skill against the largest of its group, and its place."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand")
    bar = (F.lit(100) * F.col("p_size")).cast("double") / F.greatest(F.lit(1), F.max("p_size").over(w))
    return table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("pips"), bar.alias("bar"), F.rank().over(w.orderBy(F.desc("p_size"))).cast("long").alias("place"))


@query("select c_custkey as id, list_position(['BUILDING', 'AUTOMOBILE', 'MACHINERY'], c_mktsegment) as deck from customer where c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') order by deck, c_custkey")
def deck_rows(table, spark):
    """O3, P10: rows by the place of their deck in a list and then their own."""
    order = F.array(F.lit("BUILDING"), F.lit("AUTOMOBILE"), F.lit("MACHINERY"))
    deck = F.array_position(order, F.col("c_mktsegment"))
    return table("customer").where(deck > 0).select(F.col("c_custkey").alias("id"), deck.cast("int").alias("deck")).orderBy("deck", "id")


@query("with l as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem) select l_orderkey as id, string_agg(l_partkey::varchar, ',' order by n) as first_parts from l where n <= 14 group by 1")
def first_skills(table, spark):
    """The first of a list, in its order."""
    rows = table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("all"))
    return rows.select("id", F.array_join(F.transform(F.slice("all", 1, 14), lambda x: x["l_partkey"].cast("string")), ",").alias("first_parts"))


ITINERARY_SQL = f"""
with recursive {ROUTES}, e as (select id, a, b, kind, hours_min, hours_max from routes where hours_min is not null union all select id, b, a, kind, hours_min, hours_max from routes where hours_min is not null),
w(node, low, high, path, seen, rift) as (select 0, 0.0::double, 0.0::double, []::integer[], [0], false
    union all select e.b, w.low + e.hours_min, w.high + e.hours_max, w.path || [e.id], w.seen || [e.b], w.rift or e.kind = 'rift' from w join e on e.a = w.node where not list_contains(w.seen, e.b) and len(w.path) < 5),
r as (select *, row_number() over (partition by node order by low, path) as n from w)
select node, array_to_string(seen, '>') as nodes, array_to_string(path, '>') as routes, low * 1.5 as hours_min, high * 1.5 as hours_max, rift as contains_rift from r where n = 1 and node in (0, 12, 18)
"""


@query(ITINERARY_SQL)
def itineraries(table, spark):
    """Quickest documented routes from one system to three, at a factor of 1.5."""
    found = None
    for goal in (0, 12, 18):
        row = graph.itinerary(routes(table), 0, goal, factor=1.5).select(F.lit(goal).alias("node"), F.array_join("nodes", ">").alias("nodes"), F.array_join("routes", ">").alias("routes"), "hours_min", "hours_max", "contains_rift")
        found = row if found is None else found.union(row)
    return found


@query("with recursive t(id) as (select 3::bigint union all select c.c_custkey from customer c join t on c.c_custkey // 2 = t.id) select id from t")
def process_tree(table, spark):
    """A process and all below it."""
    nodes = table("customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("parent"))
    return graph.descendants(nodes, 3)


POLYGON_SQL = """
with p as (select l_orderkey as id, list({'x': l_quantity, 'y': l_discount * 100} order by l_linenumber, l_partkey, l_suppkey) as v from lineitem group by 1),
a as (select id, len(v) as corners, list_sum([v[i].x * v[i % len(v) + 1].y - v[i % len(v) + 1].x * v[i].y for i in range(1, len(v) + 1)]) as area from p)
select id, corners as corners, corners >= 3 and abs(area) >= 1e-5 as valid from a
"""


@query(POLYGON_SQL)
def polygons(table, spark):
    """Polygons with an area."""
    rows = table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")))).alias("v"))
    rows = rows.select("id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("v"))
    return rows.select("id", F.size("v").cast("long").alias("corners"), is_polygon(F.col("v")).alias("valid"))


ROOMS_SQL = f"""
with {CREW}, declared as (select room from rooms union select 9 union select 18)
select case when room % 9 = 0 then 'undeclared' else 'unknown' end as problem, count(*) as n from assign where cycle in ('shift1', 'shift2', 'alert') and room not in (select room from declared) group by 1
"""


@query(ROOMS_SQL)
def unknown_rooms(table, spark):
    """Assigned rooms that are neither rooms nor declared."""
    declared = _rooms(table).union(spark.createDataFrame([(9,), (18,)], "room long")).distinct()
    a = _assignments(table).where(F.col("cycle").isin("shift1", "shift2", "alert")).select(F.explode("rooms").alias("room"))
    return audit.orphans(a, "room", declared, "room").groupBy(F.when(F.col("room") % 9 == 0, "undeclared").otherwise("unknown").alias("problem")).agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def duplicate_ids(table, spark):
    """V1, V6: ids that aren't unique."""
    return audit.duplicates(table("lineitem"), "l_orderkey", "l_linenumber")


@query("select o_orderkey as id, o_custkey * 2 as target from orders where not exists (select 1 from customer where c_custkey = o_custkey * 2)")
def dangling_relations(table, spark):
    """V4: relation targets that don't exist."""
    o = table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("target"))
    return audit.orphans(o, "target", table("customer"), "c_custkey").select("id", "target")


RULES_SQL = """
select id, rule from (select c_custkey as id, unnest([case when not (c_acctbal >= 0) then 'balance' end, case when not (c_nationkey between 0 and 20) then 'nation' end, case when not (length(c_name) between 1 and 17) then 'name' end]) as rule from customer) where rule is not null
"""


@query(RULES_SQL)
def broken_rules(table, spark):
    """Extra: rules of a table as expressions, one row for each that a row breaks (V2 and V8 are in validity.py)."""
    rules = {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey").between(0, 20), "name": F.length("c_name").between(1, 17)}
    return audit.rule_breaks(table("customer").withColumnRenamed("c_custkey", "id"), "id", rules)


NAV_SQL = f"""
with {ROUTES} select 'same_ends' as error, count(*) as errors from routes where a = b union all select 'unknown_end', count(*) from routes where a not in (select n_nationkey from nation where n_nationkey <> 7) or b not in (select n_nationkey from nation where n_nationkey <> 7)
union all select 'repeated_id', count(*) from (select id from (select id from routes union all select n_nationkey from nation) group by id having count(*) > 1)
"""


@query(NAV_SQL)
def navigation_errors(table, spark):
    """V7: ids unique over nodes and routes, ends distinct and known."""
    r, n = routes(table), table("nation").where("n_nationkey != 7").select(F.col("n_nationkey").alias("node"))
    known = r.join(n.select(F.col("node").alias("a")), "a", "left_semi").join(n.select(F.col("node").alias("b")), "b", "left_semi").select("id")
    ids = r.select("id").union(table("nation").select("n_nationkey"))
    return audit.report({"same_ends": r.where("a = b"), "unknown_end": r.join(known, "id", "left_anti"), "repeated_id": audit.duplicates(ids, "id")})


@query()
def crew_snapshot(table, spark):
    """One drawn place for each person; its shares are tested."""
    d = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    people = table("orders").select(
        d.alias("person"),
        F.when(d % 3 == 0, F.array(F.concat(F.lit("room-"), (d % 7).cast("string")), F.lit("bridge"))).otherwise(empty).alias("posts"),
        (d % 2 == 0).alias("shared"),
        F.when(d % 5 == 0, "Lt").otherwise("Sdt").alias("grade"),
        F.when(d % 4 == 0, "Escadrille").otherwise("Pont").alias("section"),
        F.when(d % 6 == 1, F.array(F.lit("extra-1"))).otherwise(empty).alias("extra_rooms"),
        (d % 50 == 0).alias("deployed"),
    )
    return occupancy.snapshot(people, "shift1", 42)
