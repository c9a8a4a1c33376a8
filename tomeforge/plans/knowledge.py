"""Queries over records, versions and entities: joins, counts, integrity and redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.operators import audit, catalog, curation, graph
from tomeforge.plans.base import KB, entities, profiles, query, records, versions

COPIES_SQL = """
with f as (select sha256(text) as sha256, source as collection, source || '/' || doc_id as path, octet_length(encode(text)) as bytes, 0 as scope from documents where text is not null)
select 'src-' || substr(sha256, 1, 16) as id, sha256, cast(max(bytes) as bigint) as bytes, min(path) as path, cast(count(*) - 1 as bigint) as n_copies, array_to_string(list_sort(list_distinct(list(collection))), ',') as collections
from f group by sha256
"""


@query(COPIES_SQL)
def corpus_catalog(table, spark):
    """Documents as files, one row of equal content with the first path and its copies."""
    files = table("documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("source").alias("collection"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(0).alias("scope"), F.octet_length("text").alias("bytes"))
    rows = catalog.firsts(files)
    return rows.select("id", "sha256", F.col("bytes").cast("long").alias("bytes"), "path", "n_copies", F.array_join("collections", ",").alias("collections"))


@query("select case when regexp_matches(lower(url), '\\.(html|htm|php)([?#].*)?$') then 'document' else 'auxiliary' end as kind, count(*) as n from pages group by 1")
def file_kinds(table, spark):
    """Kinds by suffix."""
    return table("pages").groupBy(catalog.file_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("select lang as format, count(*) as sources, cast(sum(n_chars) as bigint) as units from documents group by lang")
def catalog_totals(table, spark):
    """Formats, units and sources."""
    return table("documents").groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("sources"), F.sum("n_chars").alias("units"))


@query(f"with {KB} select r.id, v.origin, p.hull from records r join versions v on v.id = r.current_version left join profiles p on p.version_id = v.id where r.active")
def current_versions(table, spark):
    """Active records with their current version and its profile."""
    current = records(table).where("active").select("id", "current_version")
    found = current.join(versions(table).select(F.col("id").alias("current_version"), "origin"), "current_version")
    return found.join(profiles(table).withColumnRenamed("version_id", "current_version"), "current_version", "left").select("id", "origin", "hull")


@query(f"with {KB} select r.id, r.current_version, v.record_id from records r left join versions v on v.id = r.current_version where v.id is null or v.record_id <> r.id")
def wrong_owner(table, spark):
    """Current version missing or another record's."""
    return audit.wrong_owner(records(table), versions(table))


@query(f"with {KB} select count(*) as missing from records r where not exists (select 1 from entities e where e.id = r.entity_id)")
def missing_entities(table, spark):
    """J4."""
    return audit.orphans(records(table), "entity_id", entities(table), "id").agg(F.count("*").alias("missing"))


REDIRECTS_SQL = f"""
with recursive {KB}, chain(id, node, hops) as (select id, redirect_to, 1 from entities where redirect_to is not null
    union all select c.id, e.redirect_to, c.hops + 1 from chain c join entities e on e.id = c.node where e.redirect_to is not null and c.hops < 200)
select distinct id from chain where hops >= 200
"""


@query(REDIRECTS_SQL)
def redirect_cycles(table, spark):
    """Entities whose redirects never end."""
    return graph.redirects_into_cycles(entities(table))


@query(f"with {KB} select v.origin, v.universe, count(*) as records from records r join versions v on v.id = r.current_version where r.active group by 1, 2")
def origins(table, spark):
    """G1."""
    v = versions(table).select(F.col("id").alias("current_version"), "origin", F.col("universe"))
    return records(table).where("active").select("current_version").join(v, "current_version").groupBy("origin", "universe").agg(F.count("*").alias("records"))


@query("select case when n_chars < 500 then 'short' else 'long' end as stage, coalesce(lang, 'none') as reason, count(*) as records from documents where n_chars < 500 or n_chars > 5000 group by 1, 2")
def gaps(table, spark):
    """Gaps by stage and reason."""
    rows = table("documents").where("n_chars < 500 or n_chars > 5000")
    return rows.groupBy(F.when(F.col("n_chars") < 500, "short").otherwise("long").alias("stage"), F.coalesce("lang", F.lit("none")).alias("reason")).agg(F.count("*").alias("records"))


FTS = "fts as (select doc_id as record_id from documents where doc_id % 31 <> 0 union all select doc_id from documents where doc_id % 29 = 0)"


@query(f"with {KB}, {FTS} select r.id, count(f.record_id) as entries from records r left join fts f on f.record_id = r.id where r.active group by r.id having count(f.record_id) <> 1")
def index_audit(table, spark):
    """Active records without exactly one index entry."""
    d = table("documents").select(F.col("doc_id").alias("record_id"))
    entries = d.where("record_id % 31 != 0").union(d.where("record_id % 29 = 0"))
    return audit.index_errors(records(table).where("active"), entries)


AUDIT_SQL = f"""
with recursive {KB}, {FTS}, chain(id, node, hops) as (select id, redirect_to, 1 from entities where redirect_to is not null
    union all select c.id, e.redirect_to, c.hops + 1 from chain c join entities e on e.id = c.node where e.redirect_to is not null and c.hops < 200)
select 'current_version_wrong_owner' as error, count(*) as errors from records r left join versions v on v.id = r.current_version where v.id is null or v.record_id <> r.id
union all select 'missing_entity', count(*) from records r where not exists (select 1 from entities e where e.id = r.entity_id)
union all select 'missing_or_duplicate_fts_record', count(*) from (select r.id from records r left join fts f on f.record_id = r.id where r.active group by r.id having count(f.record_id) <> 1)
union all select 'redirect_cycle', count(distinct id) from chain where hops >= 200
"""


@query(AUDIT_SQL)
def store_audit(table, spark):
    """Every integrity check as one row."""
    d = table("documents").select(F.col("doc_id").alias("record_id"))
    entries = d.where("record_id % 31 != 0").union(d.where("record_id % 29 = 0"))
    return audit.report({
        "current_version_wrong_owner": audit.wrong_owner(records(table), versions(table)),
        "missing_entity": audit.orphans(records(table), "entity_id", entities(table), "id"),
        "missing_or_duplicate_fts_record": audit.index_errors(records(table).where("active"), entries),
        "redirect_cycle": graph.redirects_into_cycles(entities(table)),
    })


@query("select o_custkey % 50 as a, o_orderkey as id, cast(o_totalprice as decimal(18, 2)) as score from orders where o_orderstatus = 'O' order by score desc, a, id limit 100")
def top_proposals(table, spark):
    """O1: the best pending proposals."""
    rows = table("orders").where("o_orderstatus = 'O'").select((F.col("o_custkey") % 50).alias("a"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("score"))
    return rows.orderBy(F.desc("score"), "a", "id").limit(100)


@query("select o_orderkey as id, row_number() over (order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderkey) as place from orders")
def priority_order(table, spark):
    """O2: jobs by kind and then id, each with its place."""
    from tomeforge.operators.ordered import placed

    kind = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return placed(table("orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind")), "kind", "id").select("id", "place")


@query("select distinct id from (select l_partkey as id from lineitem where l_quantity > 45 union all select l_suppkey from lineitem where l_quantity > 45) where id is not null")
def proposal_ids(table, spark):
    """Distinct ids of both ends."""
    rows = table("lineitem").where("l_quantity > 45")
    return rows.select(F.col("l_partkey").alias("id")).union(rows.select("l_suppkey")).na.drop().distinct()


@query("select count(distinct (least(l_partkey % 100, l_suppkey), greatest(l_partkey % 100, l_suppkey), l_returnflag)) as combos, count(*) as links from lineitem")
def pair_combos(table, spark):
    """Distinct unordered pairs by task."""
    a, b = F.col("l_partkey") % 100, F.col("l_suppkey")
    return table("lineitem").agg(F.count_distinct(F.struct(F.least(a, b), F.greatest(a, b), F.col("l_returnflag"))).alias("combos"), F.count("*").alias("links"))


IMPORT_SQL = """
with jobs as (select o_orderkey as id, sha256(o_orderkey || '|' || o_custkey) as fp, 'v1' as contract from orders),
answers as (select o_orderkey as id, sha256(o_orderkey || '|' || case when o_orderkey % 9 = 0 then 0 else o_custkey end) as fp, case when o_orderkey % 11 = 0 then 'v0' else 'v1' end as contract, o_orderstatus as status from orders)
select status, count(*) filter (where ok) as imported, count(*) filter (where not ok) as skipped from
(select a.status, j.id is not null as ok from answers a left join jobs j on a.id = j.id and a.fp = j.fp and a.contract = j.contract and a.status <> 'P') group by status
"""


@query(IMPORT_SQL)
def decision_import(table, spark):
    """Decisions whose id, fingerprint and contract match, and the rest."""
    o = table("orders")
    fp = lambda c: F.sha2(F.concat_ws("|", F.col("o_orderkey"), c), 256)
    jobs = o.select(F.col("o_orderkey").alias("id"), fp(F.col("o_custkey")).alias("fp"), F.lit("v1").alias("contract"), F.lit(True).alias("known"))
    answers = o.select(F.col("o_orderkey").alias("id"), fp(F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(F.col("o_custkey"))).alias("fp"), F.when(F.col("o_orderkey") % 11 == 0, "v0").otherwise("v1").alias("contract"), F.col("o_orderstatus").alias("status"))
    ok = F.col("known").isNotNull() & (F.col("status") != "P")
    return answers.join(jobs, ["id", "fp", "contract"], "left").groupBy("status").agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))


@query("select n.n_name as node, count(*) as segments, count(distinct s.s_suppkey % 7) as citations from nation n join customer c on c.c_nationkey = n.n_nationkey join supplier s on s.s_nationkey = n.n_nationkey group by 1")
def node_segments(table, spark):
    """Nodes with their segments and citations, many to many, each side counted by key first."""
    c = table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"), F.count_distinct(F.col("s_suppkey") % 7).alias("citations"))
    n = table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("node"))
    return n.join(c, "k").join(s, "k").select("node", (F.col("n") * F.col("m")).alias("segments"), "citations")


BINDING_SQL = """
select o_orderkey % 4 as kind, count(*) as bound, count(*) filter (where target is null) as missing from (
select o.o_orderkey, case o_orderkey % 4 when 0 then (select c_custkey from customer where c_custkey = o_custkey * 2) when 1 then (select s_suppkey from supplier where s_suppkey = o_custkey)
    when 2 then (select p_partkey from part where p_partkey = o_custkey) else (select n_nationkey from nation where n_nationkey = o_custkey % 30) end as target from orders o) group by 1
"""


@query(BINDING_SQL)
def site_bindings(table, spark):
    """Each binding looked up in the table of its kind; the missing are errors."""
    o = table("orders").select((F.col("o_orderkey") % 4).alias("kind"), "o_custkey")
    parts = []
    for kind, name, key, ref in ((0, "customer", "c_custkey", F.col("o_custkey") * 2), (1, "supplier", "s_suppkey", F.col("o_custkey")), (2, "part", "p_partkey", F.col("o_custkey")), (3, "nation", "n_nationkey", F.col("o_custkey") % 30)):
        known = table(name).select(F.col(key).cast("long").alias("ref"), F.lit(True).alias("known")).distinct()
        parts.append(o.where(F.col("kind") == kind).select("kind", ref.cast("long").alias("ref")).join(known, "ref", "left"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("kind").agg(F.count("*").alias("bound"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("select n_name as name, n_regionkey as type, count(*) as n from (select n_name, n_regionkey from nation union all select n_name, n_regionkey from nation where n_nationkey % 6 = 0) group by 1, 2 having count(*) <> 1")
def ambiguous_nodes(table, spark):
    """(name, type) that isn't exactly one node."""
    n = table("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("type"), "n_nationkey")
    return audit.duplicates(n.union(n.where("n_nationkey % 6 = 0")), "name", "type").withColumnRenamed("rows", "n")


ALIASES_SQL = r"""
with d as (select doc_id, trim(regexp_replace(lower(strip_accents(split_part(text, ' ', 1))), '[^a-z0-9]+', ' ', 'g')) as key from documents)
select key, count(*) as members, min(doc_id) as first_id from d where key <> '' group by key having count(*) > 1
"""


@query(ALIASES_SQL)
def equal_names(table, spark):
    """Names that are equal in search form share a key; aliases would only link."""
    from tomeforge.functions.text import search_form

    name = F.split_part("text", F.lit(" "), F.lit(1))
    d = table("documents").select("doc_id", search_form(name).alias("key")).where("key != ''")
    return d.groupBy("key").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).where("members > 1")


@query(r"""with b as (select source as key, sha256(lower(trim(regexp_replace(b, '[ \t\n\x0B\f\r]+', ' ', 'g')))) as block_sha256, doc_id from (select source, doc_id, unnest(string_split(text, chr(10))) as b from documents))
select key, block_sha256, count(*) as occurrences, count(distinct doc_id) as origins, min(doc_id) as first_origin from b group by 1, 2""")
def stored_blocks(table, spark):
    """Equal blocks of a key once, with where they came from."""
    b = table("documents").select(F.col("source").alias("key"), "doc_id", F.explode(F.split("text", "\n")).alias("block"))
    return curation.merged_blocks(b, "key", "block", "doc_id")


@query(r"""with u as (select doc_id, sha256(lower(trim(regexp_replace(b, '[ \t\n\x0B\f\r]+', ' ', 'g')))) as h from (select doc_id, unnest(string_split(text, chr(10))) as b from documents))
select count(distinct h) as distinct_blocks, count(*) as occurrences, count(*) - count(distinct h) as repeats from u""")
def block_census(table, spark):
    """Distinct blocks, occurrences and repeats."""
    from tomeforge.functions.text import collapsed

    u = table("documents").select(F.explode(F.split("text", "\n")).alias("b")).groupBy(F.sha2(collapsed(F.col("b")), 256).alias("h")).agg(F.count("*").alias("n"))
    return u.agg(F.count("*").alias("distinct_blocks"), F.sum("n").alias("occurrences"), (F.sum("n") - F.count("*")).alias("repeats"))
