"""Queries over writes, quotes, snapshots, stages, recoveries and the audit of a whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.operators import audit, catalog, hashtree, pilot, records
from tomeforge.operators.graph import own_folder
from tomeforge.plans import base
from tomeforge.plans.base import KB, query

WRITES_SQL = """
with c as (select doc_id as id, sha256(text) as revision from documents where text is not null),
w as (select doc_id as id, s as seq, case when doc_id % 5 = s then 'old' else sha256(text) end as expected, case when doc_id % 7 = s then '' else text || s end as body from documents, (values (0), (1), (2)) as v(s) where text is not null
    union all select doc_id + 10000000, 0, 'old', 'x' from documents where doc_id % 50 = 0),
r as (select w.*, c.revision, row_number() over (partition by w.id, w.expected, body <> '' order by seq) = 1 as first from w left join c on c.id = w.id),
s as (select *, case when revision is null then 'unknown' when expected <> revision then 'conflict' when body = '' then 'invalid' when first then 'saved' else 'conflict' end as status from r)
select id, cast(seq as bigint) as seq, status, case when status = 'saved' then sha256(body) else revision end as revision from s
"""


@query(WRITES_SQL)
def optimistic_writes(table, spark):
    """Writes that expect a revision: saved, conflict, invalid or unknown."""
    d = table("documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    s = F.col("seq")
    w = d.select("id", "body", F.explode(F.array(*(F.lit(n).cast("long") for n in range(3)))).alias("seq"))
    w = w.select("id", "seq", F.when(F.col("id") % 5 == s, "old").otherwise(F.sha2("body", 256)).alias("expected"), F.when(F.col("id") % 7 == s, "").otherwise(F.concat("body", s.cast("string"))).alias("body"))
    lost = table("documents").where("doc_id % 50 = 0").select((F.col("doc_id") + 10_000_000).alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("old").alias("expected"), F.lit("x").alias("body"))
    return records.optimistic_writes(d, w.union(lost), F.col("body") != "").select("id", "seq", "status", "revision")


QUOTES_SQL = """
with q as (select doc_id as id, text, doc_id % 40 + case when doc_id % 11 = 0 then 1 else 0 end as start, case when doc_id % 7 = 0 then 'No ' else '' end || substr(text, doc_id % 40 + 1, 30) as quote, doc_id % 13 = 0 as forged from documents),
r as (select id, case when text is null or quote = '' then 'empty' when start + length(quote) > length(text) then 'bounds' when substr(text, start + 1, length(quote)) <> quote then 'text' when forged then 'hash' end as reason from q)
select id, reason from r where reason is not null
"""


@query(QUOTES_SQL)
def quote_errors(table, spark):
    """Quotes that aren't exactly the source's text at their offset, or whose hash differs."""
    k = F.col("doc_id")
    own = F.substring("text", (k % 40 + 1).cast("int"), F.lit(30))
    quote = F.concat(F.when(k % 7 == 0, "No ").otherwise(""), own)
    q = table("documents").select(k.alias("id"), "text", (k % 40 + F.when(k % 11 == 0, 1).otherwise(0)).alias("start"), quote.alias("quote"))
    q = q.withColumn("sha256", F.when(F.col("id") % 13 == 0, "forged").otherwise(F.sha2("quote", 256)))
    return records.quote_errors(q)


SNAPSHOT_SQL = f"""
with {KB}, p as (select l_orderkey * 10 + l_linenumber as id, l_partkey as a, case when l_quantity > 40 then null else l_suppkey end as b, l_extendedprice as score from lineitem where l_linestatus = 'O'),
best as (select * from p where a in (select id from records where universe <> 'en') order by score desc, a, id limit 500), ids as (select distinct x as id from (select a as x from best union all select b from best) where x is not null),
s as (select source as source_id, 'title ' || source as title from documents group by source)
select i.id, r.id is not null as found, r.source_id, s.title, p.hull from ids i left join records r on r.id = i.id left join s on s.source_id = r.source_id left join profiles p on p.version_id = r.current_version
"""


@query(SNAPSHOT_SQL)
def pilot_snapshot(table, spark):
    """Records at both ends of the best proposals in a scope, with source and profile."""
    li = table("lineitem").where("l_linestatus = 'O'")  # open ones are pending
    p = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("a"), F.when(F.col("l_quantity") <= 40, F.col("l_suppkey")).alias("b"), F.col("l_extendedprice").alias("score"))
    r = base.records(table)
    s = table("documents").select(F.col("source").alias("source_id")).distinct().withColumn("title", F.concat(F.lit("title "), "source_id"))
    held = records.snapshot(p, r.select("id", "source_id", "current_version"), s, base.profiles(table), 500, r.where("universe != 'en'"))
    return held.select("id", "found", "source_id", "title", "hull")


STAGES_SQL = """
with o as (select o_custkey as plan, o_orderpriority as priority, o_orderkey as stage, o_orderstatus <> 'P' and o_totalprice < 300000 as ok from orders),
w as (select *, coalesce(sum(case when ok then 0 else 1 end) over (partition by plan order by priority, stage rows between unbounded preceding and 1 preceding), 0) as before from o)
select plan, stage, ok from w where before = 0
"""


@query(STAGES_SQL)
def stages_run(table, spark):
    """Stages by priority until one fails or isn't complete."""
    o = table("orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("stage"), ((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") < 300000)).alias("ok"))
    return records.stages_run(o, "plan", ["priority", "stage"], F.col("ok")).select("plan", "stage", "ok")


RECOVERY_SQL = """
select doc_id as id, case when doc_id % 5 = 0 then 'incomplete' when doc_id % 7 = 0 then 'engine' when doc_id % 11 = 0 then 'source_changed' when n_chars + case when doc_id % 13 = 0 then 1 else 0 end <> length(coalesce(text, '')) then 'characters' when doc_id % 17 = 0 then 'marked' else 'recover' end as action from documents
"""


@query(RECOVERY_SQL)
def recovery_plan(table, spark):
    """Pages whose preconditions for native text hold, or the first that fails."""
    k = F.col("doc_id")
    sha = F.sha2("text", 256)
    rows = table("documents").select(
        k.alias("id"), (k % 5 != 0).alias("complete"), F.when(k % 7 == 0, "other").otherwise("ocr").alias("engine"), F.lit("ocr").alias("wanted_engine"),
        sha.alias("source_sha256"), F.when(k % 11 == 0, "changed").otherwise(sha).alias("now_sha256"), (F.col("n_chars") + F.when(k % 13 == 0, 1).otherwise(0)).alias("chars"), "text", (k % 17 == 0).alias("marked"),
    )
    return records.recovery_plan(rows)


AUDIT_SQL = r"""
with d as (select doc_id, source, text, sha256(text) as sha from documents where text is not null), pub as (select doc_id, case when doc_id % 29 = 0 then 'changed' else sha end as sha from d where doc_id % 23 <> 0),
li as (select l_orderkey as source, l_linenumber as page from lineitem), exp as (select source, unnest(range(1, max(page) + 2)) as page from li group by source),
links as (select doc_id, 'img/' || (doc_id % 9) || '.png' as link from d)
select 'missing_publication' as error, count(*) as errors from d where doc_id not in (select doc_id from pub)
union all select 'changed_publication', count(*) from d join pub using (doc_id) where d.sha <> pub.sha
union all select 'missing_unit', count(*) from exp where not exists (select 1 from li where li.source = exp.source and li.page = exp.page)
union all select 'broken_link', count(*) from links where link not in (select 'img/' || i || '.png' from range(7) as t(i))
union all select 'standalone_resource', count(*) from (select 'img/' || i || '.png' as link from range(12) as t(i)) where link not in (select link from links)
union all select 'repeated_id', count(*) from (select doc_id from documents group by doc_id having count(*) > 1)
"""


@query(AUDIT_SQL)
def corpus_audit(table, spark):
    """One table of all errors of a published corpus."""
    d = table("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    pub = d.where("doc_id % 23 != 0").withColumn("sha", F.when(F.col("doc_id") % 29 == 0, "changed").otherwise(F.col("sha")))
    states = catalog.drift(d, pub, "doc_id", "sha")
    li = table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"))
    units = catalog.missing_units(li.groupBy("source").agg((F.max("page") + 1).alias("pages")), li)
    png = lambda n: F.concat(F.lit("img/"), n.cast("string"), F.lit(".png")).alias("link")
    links, files = d.select(png(F.col("doc_id") % 9)), spark.range(12).select("id", png(F.col("id")))
    return audit.report({
        "missing_publication": states.where("status = 'missing'"),
        "changed_publication": states.where("status = 'changed'"),
        "missing_unit": units,
        "broken_link": links.join(F.broadcast(files.where("id < 7")), "link", "left_anti"),  # seven rows
        "standalone_resource": files.join(links.distinct(), "link", "left_anti"),
        "repeated_id": audit.duplicates(table("documents"), "doc_id"),
    })


#: Documents as units of sources of ten, with files of four kinds; some are lost or changed between checkpoint and publication.
TREES = """
u as (select doc_id // 10 as source, doc_id % 10 + 1 as unit, doc_id, sha256(coalesce(text, '')) as sha from documents),
k as (select source, unit, doc_id, 'markdown' as kind, sha from u union all select source, unit, doc_id, 'structure', sha256('structure' || sha) from u union all select source, unit, doc_id, 'scan', sha256('scan' || sha) from u where source % 2 = 0 union all select source, unit, doc_id, 'image', sha256('image' || sha) from u where doc_id % 7 = 0),
c as (select source, unit, kind, sha as sha256 from k where not (kind = 'markdown' and doc_id % 977 = 5)),
p as (select source, unit, kind, case when kind = 'structure' and doc_id % 391 = 0 or kind = 'image' and doc_id % 203 = 0 or kind = 'markdown' and doc_id % 577 = 3 then 'changed' else sha end as sha256 from k where not (kind = 'scan' and doc_id % 397 = 1) and not (kind = 'markdown' and doc_id % 683 = 2))
"""


def trees(table, spark) -> tuple[hashtree.HashTree, hashtree.HashTree]:
    """The trees of the checkpoint and of the publication."""
    d = F.col("doc_id")
    u = table("documents").select(F.floor(d / 10).alias("source"), (d % 10 + 1).cast("int").alias("unit"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    own = lambda kind: F.sha2(F.concat(F.lit(kind), "sha"), 256)
    kinds = F.array_compact(F.array(
        F.struct(F.lit("markdown").alias("kind"), F.col("sha").alias("sha256")),
        F.struct(F.lit("structure").alias("kind"), own("structure").alias("sha256")),
        F.when(F.col("source") % 2 == 0, F.struct(F.lit("scan").alias("kind"), own("scan").alias("sha256"))),
        F.when(d % 7 == 0, F.struct(F.lit("image").alias("kind"), own("image").alias("sha256"))),
    ))
    k = u.select("source", "unit", "doc_id", F.explode(kinds).alias("k")).select("source", "unit", "doc_id", "k.*")
    is_ = lambda kind, n, at: (F.col("kind") == kind) & (d % n == at)
    changed = is_("structure", 391, 0) | is_("image", 203, 0) | is_("markdown", 577, 3)
    built = k.where(~is_("markdown", 977, 5))
    shown = k.where(~is_("scan", 397, 1) & ~is_("markdown", 683, 2)).withColumn("sha256", F.when(changed, "changed").otherwise(F.col("sha256")))
    return tuple(hashtree.HashTree(spark, own_folder(spark, "tree")).write(rows) for rows in (built, shown))


@query(f"with {TREES} select coalesce(c.source, p.source) as source, coalesce(c.unit, p.unit) as unit, coalesce(c.kind, p.kind) as kind, case when p.source is null then 'missing' when c.source is null then 'extra' else 'changed' end as status from c full join p on c.source = p.source and c.unit = p.unit and c.kind = p.kind where c.sha256 is distinct from p.sha256")
def tree_drift(table, spark):
    """Files that differ between two trees of hashes, compared from the root."""
    return hashtree.drift(*trees(table, spark)).select("source", F.col("unit").cast("long").alias("unit"), "kind", "status")


@query(f"with {TREES}, f as (select coalesce(c.source, p.source) as source from c full join p on c.source = p.source and c.unit = p.unit and c.kind = p.kind where c.sha256 is distinct from p.sha256) select distinct (('0x' || substr(md5(source::varchar), 1, 8))::bigint % {hashtree.BUCKETS})::int as bucket from f")
def tree_branches(table, spark):
    """The buckets of two trees that differ, which are all that a comparison reads."""
    return spark.createDataFrame([(b,) for b in hashtree.differing(*trees(table, spark))], "bucket int")


ERRORS_SQL = f"""
with {TREES},
cat as (select source, count(*) + case when source % 53 = 9 then 1 else 0 end as pages, source % 31 = 30 as skipped from u group by source), w as (select * from cat where not skipped), has as (select * from w where source % 37 <> 11),
link as (select source, doc_id % 23 as n from u where doc_id % 3 = 0)
select source::varchar as source, null as what, 'missing_publication' as error from w where source % 37 = 11
union all select source::varchar, null, 'bad_provenance' from has where source % 41 = 7
union all select u.source::varchar, u.unit::varchar, 'bad_markdown' from u join has using (source) left join p on p.source = u.source and p.unit = u.unit and p.kind = 'markdown' where p.sha256 is distinct from u.sha
union all select source::varchar, unit::varchar, 'missing_unit' from (select source, unnest(range(1, pages + 1)) as unit from has) x where not exists (select 1 from p where p.source = x.source and p.unit = x.unit and p.kind = 'markdown')
union all select c.source::varchar, c.unit::varchar, case when p.source is null then 'missing_' else 'changed_' end || c.kind from c join has on has.source = c.source left join p on p.source = c.source and p.unit = c.unit and p.kind = c.kind where c.kind <> 'markdown' and p.sha256 is distinct from c.sha256
union all select source::varchar, 'images/' || n || '.png', 'broken_link' from link join has using (source) where n >= 20
union all select source::varchar, null, 'linked_images' from has where source % 43 = 0
union all select null, file, 'standalone_resource' from (select 'images/' || (doc_id % 23) || '.png' as file, doc_id % 23 as n from documents group by all) where n >= 20 or n % 6 = 5 or n = 4
"""


@query(ERRORS_SQL)
def corpus_errors(table, spark):
    """Every error of a published corpus: provenance, Markdown, units, scans, structures, images, links and resources."""
    built, shown = trees(table, spark)
    d = F.col("doc_id")
    u = table("documents").select(F.floor(d / 10).alias("source"), (d % 10 + 1).cast("int").alias("unit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id")
    s = F.col("source")
    catalog_ = u.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("sha").alias("sha256"), (F.col("n") + F.when(s % 53 == 9, 1).otherwise(0)).alias("pages"), (s % 31 == 30).alias("skipped"))
    publications = catalog_.where(s % 37 != 11).select("source", F.when(s % 41 == 7, "other").otherwise("sha").alias("sha256"), (s % 43 == 0).alias("images_linked"))
    png = F.concat(F.lit("images/"), (d % 23).cast("string"), F.lit(".png"))
    links = u.where("doc_id % 3 = 0").select("source", "unit", png.alias("target"))
    resources = table("documents").select((d % 23).alias("n"), png.alias("file")).distinct()
    files = resources.where("n < 20").select("file", F.when(F.col("n") % 6 == 5, "other").otherwise("sha").alias("sha256"), (F.col("n") == 4).alias("linked"))
    return hashtree.corpus_errors(catalog_, publications, u.select("source", "unit", "sha256"), shown, built, links, resources.select("file", F.lit("sha").alias("sha256")), files)


PILOT_SQL = """
with r as (select doc_id, 'rec-' || substr(sha256(doc_id::varchar), 1, 16) as id, source, sha256('name ' || doc_id || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) as version, lang from documents),
p as (select x.id as a, y.id as b, max(l_extendedprice) as score from lineitem join r x on x.doc_id = l_partkey left join r y on y.doc_id = l_suppkey where l_linestatus = 'O' and x.lang <> 'en' group by 1, 2),
j as (select *, 'job-' || substr(sha256('same|' || a || '|' || coalesce(b, '')), 1, 16) as id from p), best as (select * from j order by score desc, a, id limit 300),
ids as (select a as id from best union select b from best where b is not null), held as (select r.* from r join ids using (id))
select 'jobs' as "table", id, null as version from best
union all select 'records', id, version from held
union all select 'sources', source, null from (select distinct source from held where source is not null)
union all select 'profiles', version, null from held where doc_id % 4 = 0
"""


@query(PILOT_SQL)
def pilot_copy(table, spark):
    """A snapshot that is written once, and opened again with its identities, versions, jobs and digests checked."""
    d = table("documents")
    name = F.concat(F.lit("name "), F.col("doc_id").cast("string"))
    records_ = d.select(
        pilot.record_id(F.col("doc_id")).alias("id"), F.col("doc_id").cast("string").alias("source_key"), F.col("source").alias("source_id"), name.alias("name"), F.col("lang").alias("universe"), F.col("text").alias("body"),
        pilot.version_of(name, F.col("lang"), F.col("text")).alias("current_version"),
    )
    known = lambda key, to: records_.select(F.col("source_key").cast("long").alias(key), F.col("id").alias(to))
    pairs = table("lineitem").join(known("l_partkey", "a"), "l_partkey").join(known("l_suppkey", "b"), "l_suppkey", "left")
    status = F.when(F.col("l_linestatus") == "O", "pending").otherwise("accepted")
    proposals = pairs.groupBy("a", "b", status.alias("status")).agg(F.max("l_extendedprice").alias("score")).withColumn("task", F.lit("same"))
    proposals = proposals.withColumn("id", pilot.job_id(F.col("task"), F.col("a"), F.col("b")))
    sources = d.where("source is not null").select(F.col("source").alias("source_id")).distinct().withColumn("title", F.concat(F.lit("title "), "source_id"))
    profiles = records_.where("cast(source_key as long) % 4 = 0").select(F.col("current_version").alias("version_id"), F.lit("{}").alias("stats"))
    folder = own_folder(spark, "pilot")
    pilot.Pilot(spark, folder).create(proposals, records_, sources, profiles, 300, records_.where("universe != 'en'"))
    held = pilot.Pilot(spark, folder).open()
    rows = lambda name, id_, version=None: held[name].select(F.lit(name).alias("table"), F.col(id_).alias("id"), (F.col(version) if version else F.lit(None).cast("string")).alias("version"))
    return rows("jobs", "id").union(rows("records", "id", "current_version")).union(rows("sources", "source_id")).union(rows("profiles", "version_id"))
