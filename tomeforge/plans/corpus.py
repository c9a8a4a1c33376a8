"""Queries over pages, units and texts: scans, completeness, passages, search and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.functions import text as tx
from tomeforge.operators import audit, blocks, catalog, search
from tomeforge.plans.base import query

PAGE = "'<!-- source: ' || source || '; pdf_page: ' || doc_id || ' -->' || chr(10) || text"


def _page():
    return F.concat(F.lit("<!-- source: "), F.col("source"), F.lit("; pdf_page: "), F.col("doc_id").cast("string"), F.lit(" -->\n"), F.col("text"))


@query("select source, cast(doc_id as bigint) as page, 'pdf_page' as unit_kind, cast(n_chars as bigint) as n_chars from documents where text is not null")
def page_units(table, spark):
    """Pages read back from their header comments."""
    rows = table("documents").where("text is not null").select(_page().alias("markdown"))
    rows = rows.select(tx.page_header(F.col("markdown")).alias("h"), tx.passage(F.col("markdown"), None, None).alias("body"), "markdown")
    return rows.select("h.source", F.col("h.unit").cast("long").alias("page"), "h.unit_kind", (F.length("markdown") - F.instr("markdown", "-->") - 3).cast("long").alias("n_chars"))


@query("""with o as (select l_orderkey as source, max(l_linenumber) + 1 as pages from lineitem group by 1), w as (select source, unnest(range(1, pages + 1)) as page from o)
select source, cast(page as bigint) as page from w where not exists (select 1 from lineitem l where l.l_orderkey = w.source and l.l_linenumber = w.page)""")
def missing_units(table, spark):
    """Units 1..n of a source that aren't there."""
    li = table("lineitem")
    sources = li.groupBy(F.col("l_orderkey").alias("source")).agg((F.max("l_linenumber") + 1).alias("pages"))
    return catalog.missing_units(sources, li.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"))).select("source", F.col("page").cast("long").alias("page"))


@query("select o_orderkey as id from orders where o_orderkey % 40 <> 3 and not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def missing_publication(table, spark):
    """Sources that aren't skipped and have no publication."""
    o = table("orders").select(F.col("o_orderkey").alias("id"))
    skipped = o.where("id % 40 = 3")
    return o.join(skipped, "id", "left_anti").join(table("lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


DRIFT_SQL = """
with a as (select c_custkey as k, sha256(c_name) as h from customer where c_custkey % 17 <> 0), b as (select c_custkey as k, sha256(case when c_custkey % 13 = 0 then c_name || '!' else c_name end) as h from customer where c_custkey % 19 <> 0)
select case when b.k is null then 'missing' when a.k is null then 'extra' when a.h = b.h then 'same' else 'changed' end as status, count(*) as n from a full join b on a.k = b.k group by 1
"""


@query(DRIFT_SQL)
def publication_drift(table, spark):
    """Published against built, by hash."""
    c = table("customer")
    built = c.where("c_custkey % 17 != 0").select("c_custkey", F.sha2("c_name", 256).alias("h"))
    out = c.where("c_custkey % 19 != 0").select("c_custkey", F.sha2(F.when(F.col("c_custkey") % 13 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), 256).alias("h"))
    return catalog.drift(built, out, "c_custkey", "h").groupBy("status").agg(F.count("*").alias("n"))


PLAN_SQL = """
with f as (select c_custkey as k, 'page-' || c_custkey as path, sha256(c_name) as new, case when c_custkey % 5 = 0 then null when c_custkey % 3 = 0 then sha256(c_name || 'old') else sha256(c_name) end as old,
    case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then sha256('edited') when c_custkey % 3 = 0 then sha256(c_name || 'old') else sha256(c_name) end as disk from customer)
select case when disk is null then 'copy' when disk = new then 'keep' when disk is not distinct from old then 'update' else 'refuse' end as action, count(*) as n from f group by 1
"""


@query(PLAN_SQL)
def publication_plan(table, spark):
    """What a publication would do, refusing to overwrite local edits."""
    k = F.col("c_custkey")
    f = table("customer").select(F.concat(F.lit("page-"), k).alias("path"), k, "c_name")
    new, old = F.sha2("c_name", 256), F.sha2(F.concat("c_name", F.lit("old")), 256)
    built = f.select("path", new.alias("sha256"))
    published = f.where(k % 5 != 0).select("path", F.when(k % 3 == 0, old).otherwise(new).alias("sha256"))
    disk = f.where(k % 7 != 0).select("path", F.when(k % 11 == 0, F.sha2(F.lit("edited"), 256)).when(k % 3 == 0, old).otherwise(new).alias("sha256"))
    return catalog.publication_plan(built, published, disk).groupBy("action").agg(F.count("*").alias("n"))


@query("with s as (select l_orderkey as source, count(*) as pages, count(distinct l_linenumber) as have from lineitem group by 1) select source, pages from s where pages = have")
def ready_sources(table, spark):
    """T4: sources whose distinct pages are as many as the catalog says."""
    li = table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"))
    return catalog.ready(li.groupBy("source").agg(F.count("*").alias("pages")), li)


LINKS_SQL = r"""
with m as (select doc_id, 'See ![plan](img/' || (doc_id % 9) || '.png) and ![x](https://example.org/a.png) ![y](' || source || '.png)' as md from documents),
l as (select doc_id, unnest(regexp_extract_all(md, '!\[[^\]]*\]\(([^)\s]+)', 1)) as link from m)
select link, count(*) as uses from l where not regexp_matches(link, '^(https?|data):') and link not in (select 'img/' || i || '.png' from range(0, 7) as r(i)) group by link
"""


@query(LINKS_SQL)
def broken_links(table, spark):
    """Image links to files that aren't there."""
    md = F.concat(F.lit("See ![plan](img/"), (F.col("doc_id") % 9).cast("string"), F.lit(".png) and ![x](https://example.org/a.png) ![y]("), F.col("source"), F.lit(".png)"))
    links = table("documents").select(F.explode(tx.image_links(md)).alias("link"))
    there = spark.range(7).select(F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")).alias("link"))
    return links.join(F.broadcast(there), "link", "left_anti").groupBy("link").agg(F.count("*").alias("uses"))


@query("select user_id, count(*) as n from events where cast(json_extract(props, '$.k') as bigint) between 20 and 90 group by user_id having count(*) > 5")
def busy_users(table, spark):
    """A filter over counted rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").where(k.between(20, 90)).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 5")


@query(r"select c_custkey as id, replace(replace(replace(replace(replace('<' || c_name || ' & ''' || c_mktsegment || '''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '""', '&quot;'), '''', '&#39;') as html from customer".replace('\'""\'', "'\"'"))
def escaped_names(table, spark):
    """F2."""
    return table("customer").select(F.col("c_custkey").alias("id"), tx.escape_html(F.concat(F.lit("<"), "c_name", F.lit(" & '"), "c_mktsegment", F.lit("'>"))).alias("html"))


SEARCH_SQL = r"""
with d as (select doc_id, source, trim(regexp_replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')) as s from documents)
select doc_id, source from d where contains(s, 'cion') and source = 'src1'
"""


@query(SEARCH_SQL)
def text_search(table, spark):
    """Contains without accents, case or punctuation, in one section."""
    found = tx.contains_form([F.col("text")], "Ción", F.col("source"), "src1")
    return table("documents").where(found).select("doc_id", "source")


TOKENS_SQL = r"""
with w as (select doc_id, unnest(string_split(trim(regexp_replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')), ' ')) as token from documents)
select doc_id, count(*) as score from w where token in ('the', 'and', 'of') group by doc_id having count(distinct token) = 3
"""


@query(TOKENS_SQL)
def token_search(table, spark):
    """Documents with all tokens, by hits."""
    return search.search(search.token_index(table("documents"), "doc_id", "text"), "doc_id", ["The and", "OF"])


GROUPS_SQL = """
with g as (select n_regionkey as id, lower(r_name || ' ' || string_agg(n_name, ' ' order by n_nationkey)) as s from nation join region on r_regionkey = n_regionkey group by n_regionkey, r_name)
select id from g where contains(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), 'nation 1')
"""


@query(GROUPS_SQL)
def group_search(table, spark):
    """P5: groups by their names and their members' names."""
    n = table("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("members"))
    g = n.join(table("region").select(F.col("r_regionkey").alias("id"), "r_name"), "id")
    return g.where(tx.contains_form([F.col("r_name"), F.array_join(F.transform("members", lambda m: m["n_name"]), " ")], "nation 1")).select("id")


DICE_SQL = r"""
with d as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_quantity::int || 'D' when 1 then ' ' || l_quantity::int || 'd + ' || (l_partkey % 4) || ' ' when 2 then 'x' || l_quantity::int || 'D' else (l_partkey * 7)::varchar || 'D+1' end as v from lineitem)
select v as raw, cast(regexp_extract(v, '^\s*([0-9]{1,3})[dD](\s*\+\s*([012]))?\s*$', 1) as bigint) as dice, count(*) as n,
    cast(3 * cast(regexp_extract(v, '^\s*([0-9]{1,3})[dD](\s*\+\s*([012]))?\s*$', 1) as int) + coalesce(try_cast(regexp_extract(v, '^\s*([0-9]{1,3})[dD](\s*\+\s*([012]))?\s*$', 3) as int), 0) as bigint) as total_pips
from d where regexp_matches(v, '^\s*([0-9]{1,3})[dD](\s*\+\s*([012]))?\s*$') group by v
"""


@query(DICE_SQL)
def dice_values(table, spark):
    """dice codes, and what isn't one left out."""
    q, p = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey")
    line = F.col("l_linenumber") % 4
    v = F.when(line == 0, F.concat(q, F.lit("D"))).when(line == 1, F.concat(F.lit(" "), q, F.lit("d + "), (p % 4).cast("string"), F.lit(" "))).when(line == 2, F.concat(F.lit("x"), q, F.lit("D"))).otherwise(F.concat((p * 7).cast("string"), F.lit("D+1")))
    rows = table("lineitem").select(tx.dice(v).alias("d")).where("d is not null")
    return rows.groupBy(F.col("d.raw").alias("raw"), F.col("d.dice").cast("long").alias("dice"), F.col("d.total_pips").cast("long").alias("total_pips")).agg(F.count("*").alias("n"))


HOURS_SQL = """
with p as (select p_partkey, case when p_partkey % 10 = 0 then null else p_size * 0.75 end as lo, case when p_partkey % 10 = 0 then null else p_size * 0.75 + (p_partkey % 3) * 1.5 end as hi from part),
m as (select p_partkey, lo, hi, cast(floor(lo * 2 * 60 + 0.5) as bigint) as a, cast(floor(hi * 2 * 60 + 0.5) as bigint) as b from p),
s as (select p_partkey, lo, hi, coalesce(nullif(concat_ws(' ', case when a >= 1440 then (a // 1440) || ' j' end, case when a % 1440 >= 60 then (a % 1440 // 60) || ' h' end, case when a % 60 > 0 then (a % 60) || ' min' end), ''), '0 h') as x,
    coalesce(nullif(concat_ws(' ', case when b >= 1440 then (b // 1440) || ' j' end, case when b % 1440 >= 60 then (b % 1440 // 60) || ' h' end, case when b % 60 > 0 then (b % 60) || ' min' end), ''), '0 h') as y from m)
select p_partkey as id, case when lo is null then 'Durée inconnue' when lo = hi then x else x || ' – ' || y end as label from s
"""


@query(HOURS_SQL)
def duration_labels(table, spark):
    """F16, F17."""
    known = F.col("p_partkey") % 10 != 0
    lo = F.when(known, F.col("p_size") * 0.75)
    hi = F.when(known, F.col("p_size") * 0.75 + (F.col("p_partkey") % 3) * 1.5)
    return table("part").select(F.col("p_partkey").alias("id"), tx.duration_label(lo.cast("double"), hi.cast("double"), 2.0).alias("label"))


BOOK_SQL = """
with p as (select source, doc_id, row_number() over (partition by source order by doc_id) as n, replace('![a](../images/' || doc_id || '.png) ' || coalesce(text, ''), '../images/', 'images/') as t from documents)
select source, n as page, sha256('## Page ' || n || chr(10) || chr(10) || t) as chunk_sha256 from p
"""


@query(BOOK_SQL)
def books(table, spark):
    """A source's pages as the chunks of one book, in order, with image paths made relative to it.

    Places come from one range-partitioned sort, so that a source with a third of all pages isn't one task.
    """
    from tomeforge.operators.ordered import placed

    rows = placed(table("documents").select("source", "doc_id", "text"), "source", "doc_id", name="at")
    first = rows.groupBy("source").agg(F.min("at").alias("first"))
    t = F.replace(F.concat(F.lit("![a](../images/"), F.col("doc_id").cast("string"), F.lit(".png) "), F.coalesce("text", F.lit(""))), F.lit("../images/"), F.lit("images/"))
    page = F.col("at") - F.col("first") + 1
    chunk = F.concat(F.lit("## Page "), page.cast("string"), F.lit("\n\n"), t)
    return rows.join(first, "source").select("source", page.alias("page"), F.sha2(chunk, 256).alias("chunk_sha256"))


@query(r"select doc_id, cast(length(text) as bigint) as n_chars, sha256(text) as revision, sha256(text || '|' || source) as fingerprint from documents")
def revisions(table, spark):
    """Revisions and fingerprints."""
    return table("documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("revision"), F.sha2(F.concat_ws("|", "text", "source"), 256).alias("fingerprint"))


@query("""with v as (select doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || '}') as stored, sha256('{"lang":"' || case when doc_id % 37 = 0 then 'xx' else lang end || '","n":' || length(text) || '}') as own from documents)
select doc_id, stored = own as same, own as sha256 from v""")
def version_hashes(table, spark):
    """Stored version digests against those of the fields as they are now."""
    rows = table("documents").withColumns({"n": F.col("n_chars")}).withColumn("stored", audit.fingerprint("lang", "n"))
    now = rows.select("doc_id", "stored", F.when(F.col("doc_id") % 37 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.length("text").alias("n"))
    bad = audit.hash_mismatches(now, "stored", "lang", "n").select("doc_id").withColumn("bad", F.lit(True))
    return now.join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("same"), audit.fingerprint("lang", "n").alias("sha256"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract(props, '$.k') as bigint)) as most, count(json_extract(props, '$.missing')) as missing from events group by 1")
def parsed_props(table, spark):
    """values out of stored JSON columns."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"), F.count(F.get_json_object("props", "$.missing")).alias("missing"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as utc from events")
def timestamps(table, spark):
    """ISO timestamps with their offset."""
    return table("events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("utc"))


@query(r"""with p as (select page_id, case page_id % 4 when 0 then '../x/' || page_id when 1 then url when 2 then 'pages/' || page_id || '.md' else 'C:' || page_id end as path from pages)
select page_id, path <> '' and not regexp_matches(path, '^([A-Za-z][A-Za-z0-9+.-]*:|[/\\])|(^|[/\\])\.\.([/\\]|$)') as safe from p""")
def path_guards(table, spark):
    """relative paths only."""
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("../x/"), k.cast("string"))).when(k % 4 == 1, F.col("url")).when(k % 4 == 2, F.concat(F.lit("pages/"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("C:"), k.cast("string")))
    return table("pages").select("page_id", tx.safe_path(path).alias("safe"))


PASSAGE_SQL = r"""
with t as (select doc_id, text, strpos(text, '.') as a from documents), u as (select doc_id, text, a, case when a = 0 then 0 else strpos(substr(text, a + 1), '.') end as b from t)
select doc_id, nullif(trim(substr(text, a, b)), '') as passage from u where a > 0 and b > 0
"""


@query(PASSAGE_SQL)
def passages(table, spark):
    """F8: from one anchor to the next."""
    return table("documents").select("doc_id", tx.passage(F.col("text"), ".", ".").alias("passage")).where("passage is not null")


@query()
def quote_units(table, spark):
    """quotes of at most 1,100 UTF-16 units, cut at blanks; held against brute force in the tests."""
    return tx.quoted(table("documents"), "doc_id", "text").select("doc_id", "n", F.length("quote").alias("length"), F.sha2("quote", 256).alias("sha256"))


UNITS_SQL = r"""
with u as (select doc_id, unnest(regexp_extract_all(text, '(?s)(.+?(?:\n\s*\n|\z))', 1)) as body, unnest(range(1, len(regexp_extract_all(text, '(?s)(.+?(?:\n\s*\n|\z))', 1)) + 1)) as n from documents where text <> ''),
o as (select doc_id, n, body, cast(sum(length(body)) over (partition by doc_id order by n) as bigint) as stop from u where body <> '')
select doc_id, count(*) as units, max(stop) as total, sha256(string_agg((stop - length(body)) || ':' || stop || ':' || sha256(body), ',' order by n)) as digest from o group by 1
"""


@query(UNITS_SQL)
def unit_partition(table, spark):
    """units put together are the text, and each is the text at its offsets."""
    d = table("documents").where("text != ''").select("doc_id", "text")
    rows = tx.paragraph_rows(d, "doc_id", "text")
    told = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), F.sha2("body", 256)).alias("told")
    held = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "end", told, "body"))).alias("u"))  # one text's units
    whole = held.join(d, "doc_id").where(F.array_join("u.body", "") == F.col("text"))  # a text whose units aren't the text is missing
    return whole.select("doc_id", F.size("u").cast("long").alias("units"), F.element_at("u", -1)["end"].cast("long").alias("total"), F.sha2(F.array_join("u.told", ","), 256).alias("digest"))


CARDS = "case when doc_id % 9 = 0 then '{\"name\": \"' || source || '\",' || chr(10) || chr(10) || '\"move\": 10}' when doc_id % 4 = 0 then '# ' || source || chr(10) || chr(10) || 'Move' || chr(10) || chr(10) || doc_id % 20 || chr(10) || chr(10) || repeat('Skill: 3D+1' || chr(10) || chr(10), 1 + cast(doc_id % 300 as int)) || text else text end"
#: A text that is one JSON object or array (fixed value).
JSON_CARD = r"^[ \t\r\n]*(?:\{(?:[^\n]|\n)*\}|\[(?:[^\n]|\n)*\])[ \t\r\n]*\z"
_KIND = "case " + " ".join(f"when regexp_matches(trim(body, ' ' || chr(9) || chr(13) || chr(10)), '{p}') then '{k}'" for k, p in blocks.UNIT_KINDS) + " else 'narrative' end"
BLOCKS_SQL = rf"""
with t as (select doc_id, {CARDS} as text from documents where text <> ''),
x as (select doc_id, case when length(text) <= 1600 and regexp_matches(text, '{JSON_CARD}') then [text] else regexp_extract_all(text, '(?s)(.+?(?:\n\s*\n|\z))', 1) end as list from t),
u as (select doc_id, unnest(list) as body, unnest(range(1, len(list) + 1)) as n from x),
o as (select doc_id, n, body, sum(length(body)) over w - length(body) as start, {_KIND} as kind from u where body <> '' window w as (partition by doc_id order by n)),
b as (select *, lag(kind) over (partition by doc_id order by n) as before from o),
s as (select *, coalesce(before in ('heading', 'label'), false) as held, before is null or not case when kind = 'heading' then before = 'heading' else before in ('heading', 'label') or (before in ('value', 'pair') and kind in ('value', 'pair', 'label')) end as opens from b),
r as (select *, floor((start - max(case when opens then start end) over (partition by doc_id order by n)) / 1600) as stretch from s),
g as (select *, opens or (not held and stretch <> lag(stretch) over (partition by doc_id order by n)) as first from r),
k as (select *, sum(case when first then 1 else 0 end) over (partition by doc_id order by n) as block from g)
select doc_id, cast(block as bigint) as block, cast(min(start) as bigint) as start, cast(max(start + length(body)) as bigint) as "end", count(*) as units, sha256(string_agg(body, '' order by n)) as sha256 from k group by doc_id, block
"""


@query(BLOCKS_SQL)
def coherent_blocks(table, spark):
    """blocks of headings with content, runs of labels and values, narrative units and JSON cards."""
    d = table("documents").where("text != ''").select("doc_id", F.expr(CARDS.replace("chr(10)", "char(10)")).alias("text"))
    rows = blocks.coherent_blocks(d, "doc_id", "text", tx.paragraph_rows)
    return rows.select("doc_id", "block", "start", "end", "units", F.sha2("body", 256).alias("sha256"))


@query("select doc_id, sha256(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '<!-- native-text-supplement: pdf-text-layer; uncorrected -->' || chr(10) || chr(10) || lang || chr(10)) as sha256 from documents where n_chars < 2000")
def native_supplements(table, spark):
    """Pages of low coverage with their native layer, once however often it is added."""
    low = table("documents").where("n_chars < 2000")
    once = tx.with_native_text(F.col("text"), F.col("lang"))
    return low.select("doc_id", F.sha2(tx.with_native_text(once, F.col("lang")), 256).alias("sha256"))


PROVENANCE_SQL = r"""
with w as (select doc_id, 'Source: ' || source || case when doc_id % 5 = 0 then '; Source: lost book' else '' end as note from documents where doc_id % 3 <> 0),
c as (select doc_id, trim(unnest(regexp_extract_all(note, 'Source:\s*([^;]+)', 1))) as cited from w), k as (select distinct source from documents where source <> 'src3'),
s as (select doc_id, case when cited in (select source from k) then 'identified' else 'citation_unresolved' end as status from c union all select doc_id, 'not_stated' from documents where doc_id % 3 = 0)
select status, count(*) as n, count(distinct doc_id) as documents from s group by status
"""


@query(PROVENANCE_SQL)
def provenance(table, spark):
    """Citations resolved by exact match against the catalog only; several stay several."""
    d = table("documents")
    note = F.concat(F.lit("Source: "), F.col("source"), F.when(F.col("doc_id") % 5 == 0, "; Source: lost book").otherwise(""))
    cited = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.regexp_extract_all(note, F.lit(r"Source:\s*([^;]+)"), F.lit(1))).alias("c")).select("doc_id", F.explode_outer("c").alias("cited"))
    known = d.where("source != 'src3'").select(F.col("source").alias("cited")).distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("cited").isNull(), "not_stated").when(F.col("known"), "identified").otherwise("citation_unresolved")
    joined = cited.withColumn("cited", F.trim("cited")).join(known, "cited", "left")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query()
def markdown_pages(table, spark):
    """HTML as Markdown; held against fixtures in the tests."""
    from tomeforge.sources.html_markdown import converted

    return converted(table("pages"), "page_id", "html").select("page_id", "markdown", F.size("media").alias("n_media"), F.array_join("warnings", ",").alias("warnings"))


@query("select c_custkey as id, 'png' as suffix, sha256(c_name) as sha256 from customer where c_custkey % 3 <> 0")
def embedded_images(table, spark):
    """Data URIs decoded and named by hash; other text isn't one."""
    from tomeforge.sources.files import data_uri

    uri = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("c_name").cast("binary")))).otherwise(F.col("c_name"))
    return table("customer").select(F.col("c_custkey").alias("id"), data_uri(uri).alias("d")).where("d is not null").select("id", "d.suffix", "d.sha256")


#: Cards with rows of 47 characters, which a comma follows; blocks of 1,600 characters.
PATHS_SQL = """
with c as (select doc_id, 40 + doc_id % 200 as n, length(source) as l from documents where source is not null), r as (select doc_id, n, l, unnest(range(n)) as i from c),
b as (select doc_id, n, l, i, case when i < (1600 - 8) // 48 then 2 else 3 + (i - (1600 - 8) // 48) // (1600 // 48) end as block from r)
select doc_id, block, '/rows/' || min(i) as path, 11 + l + case when min(i) = 0 then 0 else 8 + 48 * min(i) end as start, 11 + l + 8 + 48 * (max(i) + 1) + case when max(i) = n - 1 then 1 else 0 end as "end", count(*) as units from b group by doc_id, n, l, block
union all select doc_id, 1, '/name', 0, 11 + l, 1 from c
"""


@query(PATHS_SQL)
def card_paths(table, spark):
    """long JSON cards cut between their members, with paths and offsets; together the blocks are the card."""
    d = table("documents").where("source is not null")
    row = lambda i: F.concat(F.lit('{"id":"'), F.lpad(i.cast("string"), 6, "0"), F.lit(r'","note":"a, ] \"row\" { padding"}'))
    n = (40 + F.col("doc_id") % 200).cast("int")
    rows = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), row), ",")
    d = d.select("doc_id", F.concat(F.lit('{"name":"'), "source", F.lit('","rows":['), rows, F.lit("]}")).alias("text"))
    found = blocks.coherent_blocks(d, "doc_id", "text", tx.paragraph_rows)
    joined = found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "body"))), lambda b: b["body"]), "").alias("joined"))
    same = d.join(joined, "doc_id").where("joined = text").select("doc_id")  # a card whose blocks aren't the card is missing
    return found.join(same, "doc_id").select("doc_id", "block", "path", "start", "end", "units")
