"""Queries over archives, catalogs, workbooks, exports, indexes, snapshots and job logs that are written and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeforge.operators import index
from tomeforge.operators.graph import own_folder
from tomeforge.plans.base import query
from tomeforge.sources import archives, exports, files, workbooks

#: Documents in archives of fifty; some names lead out of the folder, some members are links, long ones exceed MEMBER.
MEMBER = 8000
PACKED = f"""
m as (select 'part-' || (doc_id // 50) || '.zip' as archive, case when doc_id % 41 = 0 then '../' when doc_id % 43 = 0 then '/tmp/' else '' end || 'd' || lpad(doc_id::varchar, 9, '0') || '.txt' as member, text, doc_id % 37 = 0 as link from documents where text is not null),
r as (select archive, cast(row_number() over (partition by archive order by member) - 1 as int) as position, member, strlen(text) as bytes, sha256(text) as sha256,
    case when member like '../%' or member like '/%' then 'unsafe_path' when link then 'symlink' when strlen(text) > {MEMBER} then 'too_large' end as problem from m)
"""


def packed(table, spark) -> str:
    """A folder of archives made from `documents`."""
    d = F.col("doc_id")
    name = F.concat(F.when(d % 41 == 0, "../").when(d % 43 == 0, "/tmp/").otherwise(""), F.lit("d"), F.lpad(d.cast("string"), 9, "0"), F.lit(".txt"))
    rows = table("documents").where("text is not null").select(F.concat(F.lit("part-"), F.floor(d / 50).cast("string")).alias("archive"), name.alias("member"), F.encode("text", "UTF-8").alias("content"), (d % 37 == 0).alias("link"))
    folder = own_folder(spark, "archives")
    archives.write_archives(rows, folder)
    return folder


@query(f"with {PACKED} select archive, position, member, bytes, case when problem is null then sha256 end as sha256, problem from r")
def archive_members(table, spark):
    """Archives written and read by format name; unsafe, linked and too large members are problem rows."""
    rows = archives.members(spark, packed(table, spark), memberBytes=MEMBER, partitionBytes=1 << 20)
    return rows.select("archive", "position", "member", "bytes", "sha256", "problem")


@query(f"""
with {PACKED}, good as (select * from r where problem is null), known as (select sha256(text) as sha256, min('src-' || substr(sha256(text), 1, 16)) as id from documents where doc_id % 10 = 3 and text is not null group by 1),
f as (select *, row_number() over (partition by sha256 order by archive, position) = 1 as first from good)
select archive, position, member, 'src-' || substr(f.sha256, 1, 16) as id, f.sha256, bytes, coalesce(known.id, case when not first then 'src-' || substr(f.sha256, 1, 16) end) as duplicate_of from f left join known on known.sha256 = f.sha256
""")
def archive_duplicates(table, spark):
    """Readable members, and the source or earlier member that each repeats."""
    sha = F.sha2("text", 256)
    known = table("documents").where("doc_id % 10 = 3 and text is not null").select(F.concat(F.lit("src-"), F.substring(sha, 1, 16)).alias("id"), sha.alias("sha256"))
    return archives.catalog_of_members(archives.members(spark, packed(table, spark), memberBytes=MEMBER), known)


#: Suppliers in catalogs of a hundred, inside an object; the text of every seventh breaks off in its last entry.
CATALOG_SQL = """
with s as (select s_suppkey // 100 as part, row_number() over (partition by s_suppkey // 100 order by s_suppkey) - 1 as position, count(*) over (partition by s_suppkey // 100) as n, s_suppkey as id, s_name as name, s_nationkey as nation from supplier)
select part, cast(position as int) as position, case when part % 7 = 3 and position = n - 1 then null else id end as id, case when part % 7 = 3 and position = n - 1 then null else name end as name,
    case when part % 7 = 3 and position = n - 1 then null else nation end as nation, case when part % 7 = 3 and position = n - 1 then 'unreadable' end as problem from s
"""


def catalogs(table, spark) -> str:
    """A folder of JSON files with byte order marks, one for each hundred suppliers."""
    entry = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    part = F.floor(F.col("s_suppkey") / 100)
    rows = table("supplier").groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("include"))  # a hundred at most
    whole = F.concat(F.lit('\ufeff{"version": 1, "note": "],[", "include": '), F.to_json("include"), F.lit("}"))
    text = F.when(F.col("part") % 7 == 3, F.substring(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole)
    folder = own_folder(spark, "catalogs")
    rows.select("part", text.alias("value")).write.partitionBy("part").text(folder)
    return folder


@query(CATALOG_SQL)
def catalog_entries(table, spark):
    """JSON catalogs read by format name, entry by entry; what breaks off is a problem row after the entries before it."""
    archives.register(spark)
    rows = spark.read.format("tomeforge_json").option("field", "include").load(catalogs(table, spark))
    entry = F.from_json("entry", "id long, name string, nation int")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return rows.select(part.alias("part"), "position", entry["id"].alias("id"), entry["name"].alias("name"), entry["nation"].alias("nation"), "problem")


#: Documents before and after an update: some texts are new, a few are changed or removed.
BUCKETS = 128
FORM = "trim(regexp_replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
EDITIONS = f"""
before as (select doc_id as key, text from documents where not (doc_id % 20 = 11 and coalesce(length(text), 0) < 300)),
after as (select doc_id as key, case when doc_id % 499 = 7 then coalesce(text, '') || ' and of the ' || source else text end as text from documents where not (doc_id % 20 = 13 and coalesce(length(text), 0) < 300)),
b as (select key, string_split({FORM}, ' ') as w from before), a as (select key, string_split({FORM}, ' ') as w from after),
bt as (select key, unnest(w) as token, generate_subscripts(w, 1) - 1 as position from b), at_ as (select key, unnest(w) as token, generate_subscripts(w, 1) - 1 as position from a)
"""


def _short(n: int):
    return (F.col("key") % 20 == n) & (F.coalesce(F.length("text"), F.lit(0)) < 300)


def updated(table, spark) -> tuple[index.Index, dict[str, list[int]]]:
    """An index of the documents before, refreshed to those after; and the buckets that the refresh wrote."""
    d = table("documents").select(F.col("doc_id").alias("key"), "text", "source")
    text = F.when(F.col("key") % 499 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit(" and of the "), "source")).otherwise(F.col("text"))
    held = index.Index(spark, own_folder(spark, "index"))
    held.build(d.where(~_short(11)).select("key", "text"), BUCKETS)
    return held, held.refresh(d.where(~_short(13)).select("key", text.alias("text")))


@query(f"with {EDITIONS} select key as doc_id, count(*) as score from at_ where token in ('the', 'and', 'of') group by key having count(distinct token) = 3")
def stored_search(table, spark):
    """Documents with all words, by hits, from a stored index that was refreshed by the changed documents."""
    return updated(table, spark)[0].search(["The and", "OF"]).withColumnRenamed("key", "doc_id")


@query(f"with {EDITIONS} select a1.key as doc_id, list(cast(a1.position as int) order by a1.position)::varchar as places from at_ a1 join at_ a2 on a1.key = a2.key and a2.position = a1.position + 1 where a1.token = 'of' and a2.token = 'the' group by a1.key")
def phrase_search(table, spark):
    """Documents in which words stand one after the other, and where."""
    found = updated(table, spark)[0].phrase("of the")
    return found.select(F.col("key").alias("doc_id"), F.concat(F.lit("["), F.array_join(F.col("places").cast("array<string>"), ", "), F.lit("]")).alias("places"))


@query(f"""
with {EDITIONS}, old as (select key, token, list(position order by position) as places from (select key, token, position from bt) group by all), new as (select key, token, list(position order by position) as places from at_ group by all),
tokens as (select coalesce(old.token, new.token) as token from old full join new on old.key = new.key and old.token = new.token where old.places is distinct from new.places),
touched as (select distinct ('0x' || substr(md5(token), 1, 8))::bigint % {BUCKETS} as bucket from tokens where token <> ''),
held as (select ('0x' || substr(md5(token), 1, 8))::bigint % {BUCKETS} as bucket, count(*) as hits, count(distinct token) as words from at_ where token <> '' group by 1)
select bucket::int as bucket, hits, words, bucket in (select bucket from touched) as refreshed from held
""")
def index_refresh(table, spark):
    """What each bucket of the index holds after a refresh, and whether the refresh wrote it."""
    held, parts = updated(table, spark)
    rows = held.store.read("postings").groupBy(F.col("part").alias("bucket")).agg(F.sum(F.size("positions")).alias("hits"), F.count_distinct("token").alias("words"))
    return rows.withColumn("refreshed", F.col("bucket").isin(parts["postings"]))


@query(f"with {EDITIONS}, active as (select key from after where key % 5 <> 0 union all select 10000000 + doc_id from documents where doc_id % 97 = 0) select active.key as key, 'missing' as error from active where key not in (select key from after) union all select key, 'extra' from after where key not in (select key from active)")
def stored_index_audit(table, spark):
    """Active records that the stored index hasn't exactly once, and others that it has."""
    active = table("documents").select(F.col("doc_id").alias("key"), "text").where(~_short(13) & (F.col("key") % 5 != 0)).select("key")
    lost = table("documents").where("doc_id % 97 = 0").select((F.col("doc_id") + 10_000_000).alias("key"))
    return updated(table, spark)[0].errors(active.union(lost))


#: Customers in workbooks of two hundred, a sheet for each segment; the last sheet of every ninth workbook breaks off.
BOOKS = """
c as (select c_custkey // 200 as book, dense_rank() over (order by c_mktsegment) as sheet, c_mktsegment as name, c_custkey, c_name, c_acctbal from customer),
n as (select *, row_number() over (partition by book, sheet order by c_custkey) as row from c),
r as (select 'book-' || book || '.xlsx' as file, dense_rank() over (partition by book order by sheet) as sheet, name, row, '["' || c_name || ' & co <' || row || '>", "' || c_custkey || '", "=B' || row || '*2&''<>''", null, "' || name || '"]' as cells, null as problem, book % 9 = 4 as broken from n)
"""


def books(table, spark) -> str:
    """A folder of workbooks made from `customer`."""
    c = table("customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a handful of segments
    book = F.floor(F.col("c_custkey") / 200)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment"))
    row = F.row_number().over(Window.partitionBy(book, place).orderBy("c_custkey"))
    rows = c.select(book.alias("book"), place.alias("place"), F.col("c_mktsegment").alias("name"), row.alias("row"), "c_custkey", "c_name")
    rows = rows.withColumn("sheet", F.dense_rank().over(Window.partitionBy("book").orderBy("place")))
    number = F.col("row").cast("string")
    cells = F.array(F.concat("c_name", F.lit(" & co <"), number, F.lit(">")), F.col("c_custkey").cast("string"), F.concat(F.lit("=B"), number, F.lit("*2&'<>'")), F.lit(None).cast("string"), F.col("name"))
    parts = workbooks.members_of_workbooks(rows.select(F.concat(F.lit("book-"), F.col("book").cast("string")).alias("workbook"), "sheet", "name", "row", cells.alias("cells")))
    last = F.max("member").over(Window.partitionBy("archive")) == F.col("member")
    broken = (F.regexp_extract("archive", r"(\d+)$", 1).cast("long") % 9 == 4) & last & F.col("member").startswith("xl/worksheets/")
    content = F.when(broken, F.expr(f"substring(content, 1, length(content) - {len('</sheetData></worksheet>')})")).otherwise(F.col("content"))
    folder = own_folder(spark, "workbooks")
    workbooks.write_workbooks(parts.withColumn("content", content), folder)
    return folder


@query(f"with {BOOKS} select file, sheet::int as sheet, name, row::int as row, cells, problem from r union all select file, sheet::int, name, null, null, 'unreadable' from r where broken group by file, sheet, name qualify sheet = max(sheet) over (partition by file)")
def workbook_rows(table, spark):
    """Rows of workbooks' sheets, formulas as text, and a problem row for a sheet that breaks off."""
    rows = workbooks.workbooks(spark, books(table, spark))
    quoted = F.transform("cells", lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null")))
    return rows.withColumn("cells", F.when(F.col("cells").isNotNull(), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))))


@query(f"""
with {BOOKS}, u as (select file, sheet as unit, name, string_agg('| ' || replace(replace(replace(replace(cells, '["', ''), '", null, "', ' |  | '), '", "', ' | '), '"]', '') || ' |', chr(10) order by row) as text, count(*) as n_rows from r group by all)
select file, unit::int as unit, name, sha256(text) as sha256, n_rows::int as n_rows, count(*) over (partition by file) as units from u
""")
def workbook_units(table, spark):
    """The sheets of workbooks as text units, and how many units each workbook has."""
    rows = workbooks.units(workbooks.workbooks(spark, books(table, spark)))
    return rows.select("file", "unit", "name", F.sha2("text", 256).alias("sha256"), "n_rows", F.count("*").over(Window.partitionBy("file")).alias("units"))


#: Customers as nodes, orders as their claims, lineitems as citations, nations as relations; some names change between two exports.
PARTS, ITEMS = 64, 20
EXPORTED = f"""
items as (
    select c_custkey as node, 'node' as kind, 0 as a, 0 as b, 0 as c, to_json({{'name': case when c_custkey % 701 = 5 then 'new ' || c_name else c_name end, 'type': c_mktsegment}}) as item, to_json({{'name': c_name, 'type': c_mktsegment}}) as old_item from customer
    union all select o_custkey, 'claims', o_orderkey, 0, 0, to_json({{'id': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority}}) as i, i from orders
    union all select o_custkey, 'citations', l_orderkey, l_linenumber, l_partkey, to_json({{'claim': l_orderkey, 'line': l_linenumber, 'source': l_partkey}}) as i, i from lineitem join orders on o_orderkey = l_orderkey
    union all select c_custkey, 'relations', c_nationkey, 0, 0, to_json({{'kind': 'nation', 'to': c_nationkey}}) as i, i from customer where c_custkey % 3 > 0),
n as (select *, (row_number() over (partition by node, kind order by a, b, c) - 1) // {ITEMS} as chunk from items),
head as (select node, kind, chunk, '{{"node":' || node || ',"kind":"' || kind || '","chunk":' || chunk || ',"items":[' as start, string_agg(item, ',' order by a, b, c) as items, string_agg(old_item, ',' order by a, b, c) as old_items from n group by node, kind, chunk),
export as (select node, kind, chunk, start || items || ']}}' as line, start || old_items || ']}}' as old_line, ('0x' || substr(md5(node::varchar), 1, 8))::bigint % {PARTS} as part from head)
"""


def exported(table, spark) -> tuple[exports.Export, list[int]]:
    """An export written twice, and the parts that the second time wrote."""
    c, o = table("customer"), table("orders")
    node = F.col("c_custkey").alias("node")
    claims = o.select(F.col("o_custkey").alias("node"), "o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("item"))
    owner = o.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("l_orderkey"))
    cited = table("lineitem").join(owner, "l_orderkey").select("node", "l_orderkey", "l_linenumber", "l_partkey", F.struct(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("source")).alias("item"))
    related = c.where("c_custkey % 3 > 0").select(node, "c_nationkey", F.struct(F.lit("nation").alias("kind"), F.col("c_nationkey").alias("to")).alias("item"))
    rest = [exports.chunked(claims, ["o_orderkey"], "claims", ITEMS), exports.chunked(cited, ["l_orderkey", "l_linenumber", "l_partkey"], "citations", ITEMS), exports.chunked(related, ["c_nationkey"], "relations", ITEMS)]
    head = lambda name: c.select(node, F.lit("node").alias("kind"), F.lit(0).alias("chunk"), F.array(F.struct(name.alias("name"), F.col("c_mktsegment").alias("type"))).alias("items"))
    renamed = F.when(F.col("c_custkey") % 701 == 5, F.concat(F.lit("new "), "c_name")).otherwise(F.col("c_name"))
    held = exports.Export(spark, own_folder(spark, "export"))
    held.write(exports.lines([head(F.col("c_name")), *rest], PARTS))
    return held, held.write(exports.lines([head(renamed), *rest], PARTS))


@query(f"with {EXPORTED} select node, kind, chunk::int as chunk, sha256(line) as sha256 from export")
def knowledge_export(table, spark):
    """An export of nodes with claims, citations and relations, read back line by line."""
    rows = exported(table, spark)[0].read()
    j = F.from_json("value", "node long, kind string, chunk int")
    return rows.select(j["node"].alias("node"), j["kind"].alias("kind"), j["chunk"].alias("chunk"), F.sha2("value", 256).alias("sha256"))


@query(f"""
with {EXPORTED}, s as (select part, count(*) as n_lines, sum(('0x' || substr(sha256(line), 1, 15))::hugeint)::varchar || '-' || sum(('0x' || substr(sha256(line), 16, 15))::hugeint)::varchar as digest, bool_or(line <> old_line) as rewritten from export group by part)
select part::int as part, n_lines, digest, rewritten from s
""")
def export_manifest(table, spark):
    """The manifest of the second export, and which parts it wrote anew."""
    held, changed = exported(table, spark)
    said = held.store.manifest()["digests"]
    return spark.createDataFrame([(int(p), n, d, int(p) in changed) for p, (n, d) in said.items()], "part int, n_lines long, digest string, rewritten boolean")


#: Parts as small images of four formats; some are cut off, declared as another type, or no image.
IMAGES = """
i as (select p_partkey as id, p_size + 1 as w, p_partkey % 50 + 1 as h, case when p_partkey % 23 = 5 then 'none' else ['png', 'gif', 'jpeg', 'webp'][p_partkey % 4 + 1] end as form, p_partkey % 17 = 0 and p_partkey % 4 = 0 as cut, p_partkey % 19 = 0 as declared from part),
b as (select *, unhex(case form when 'png' then '89504E470D0A1A0A0000000D49484452' || printf('%08X', w) || printf('%08X', h) || '08020000000000000000000000494441540000000000000000' || '49454E44' || case when cut then '' else '00000000' end
    when 'gif' then '474946383961' || printf('%02X', w) || '00' || printf('%02X', h) || '00' when 'jpeg' then 'FFD8FFC0001108' || printf('%04X', h) || printf('%04X', w) || '0301' when 'webp' then '524946460000000057454250565038580000000000000000' || printf('%02X', w - 1) || '0000' || printf('%02X', h - 1) || '0000' else '00' || printf('%08X', id) end) as content from i),
r as (select id, content, case when form <> 'none' and not cut then 'image/' || form end as type, case when form <> 'none' and not cut then w end as width, case when form <> 'none' and not cut then h end as height, case when form = 'none' then 'unknown' when cut then 'damaged' when declared and form <> 'gif' then 'declared_type' end as problem from b)
"""


def images(table):
    """(id, content, declared)."""
    k, w, h = F.col("p_partkey"), F.col("p_size") + 1, F.col("p_partkey") % 50 + 1
    hexed = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    cut = F.when((k % 17 == 0) & (k % 4 == 0), "").otherwise("00000000")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8), F.lit("0802000000000000000000000049444154000000000000000049454E44"), cut)
    gif = F.concat(F.lit("474946383961"), hexed(w, 2), F.lit("00"), hexed(h, 2), F.lit("00"))
    jpeg = F.concat(F.lit("FFD8FFC0001108"), hexed(h, 4), hexed(w, 4), F.lit("0301"))
    webp = F.concat(F.lit("524946460000000057454250565038580000000000000000"), hexed(w - 1, 2), F.lit("0000"), hexed(h - 1, 2), F.lit("0000"))
    form = F.when(k % 23 == 5, F.concat(F.lit("00"), hexed(k, 8))).when(k % 4 == 0, png).when(k % 4 == 1, gif).when(k % 4 == 2, jpeg).otherwise(webp)
    return table("part").select(k.alias("id"), F.unhex(form).alias("content"), F.when(k % 19 == 0, "image/gif").alias("declared"))


@query(f"with {IMAGES} select id, type, width, height, problem from r")
def image_types(table, spark):
    """Type and size of images by their bytes, and what is wrong with them."""
    rows = images(table).withColumn("info", files.image_info("content", "declared"))
    return rows.select("id", "info.type", "info.width", "info.height", "info.problem")


@query(f"with {IMAGES} select sha256(content) as sha256, count(*) as origins, min('part-' || id) as first_origin, null::varchar as warning from r where problem is null group by content union all select null, 1, 'part-' || id, problem from r where problem is not null")
def image_copies(table, spark):
    """Equal images once with their origins; unreadable ones as warnings."""
    rows = images(table).select(F.concat(F.lit("part-"), F.col("id").cast("string")).alias("locator"), "content", files.image_info("content", "declared")["problem"].alias("problem"))
    found = files.equal_images(rows)
    return found.select("sha256", F.size("origins").cast("long").alias("origins"), F.col("origins")[0].alias("first_origin"), "warning")


@query("""
select 'campaign' as part, n_name as id, sha256('{"format":"tomeforge-export","version":1,"part":"campaign","data":{"id":"' || n_name || '","region":' || n_regionkey || '}}') as sha256 from nation where n_nationkey = 7
union all select 'entity', s_name, sha256('{"format":"tomeforge-export","version":1,"part":"entity","data":{"id":"' || s_name || '","nation":' || s_nationkey || case when s_suppkey % 4 = 0 then '' else ',"weight":' || (s_suppkey % 4)::varchar || '.5' end || '}}') from supplier
""")
def export_bundle(table, spark):
    """The bundle's lines as they are written; numbers that JSON doesn't have are left out."""
    folder = own_folder(spark, "bundle")
    s = F.col("s_suppkey")
    weight = F.when(s % 8 == 0, float("nan")).when(s % 4 == 0, float("-inf")).otherwise((s % 4).cast("double") + 0.5)
    campaign = table("nation").where("n_nationkey = 7").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("region"))
    entities = table("supplier").select(F.col("s_name").alias("id"), F.col("s_nationkey").alias("nation"), files.finite(weight).alias("weight"))
    files.export_bundle(campaign, entities, folder)
    lines = spark.read.text(folder)
    return lines.select(F.get_json_object("value", "$.part").alias("part"), F.get_json_object("value", "$.data.id").alias("id"), F.sha2("value", 256).alias("sha256"))
