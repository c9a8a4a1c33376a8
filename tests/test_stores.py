import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeforge.operators import hashtree, index, pilot
from tomeforge.sources import archives, exports, workbooks
from tomeforge.sources.versions import Conflict, Versions


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)


def test_archive_source(spark, tmp_path):
    many = [(f"m{i:03}.txt", random.Random(i).randbytes(200 + i)) for i in range(300)]
    zipped(tmp_path / "a.zip", many)
    zipped(tmp_path / "b.ZIP", [("ok", b""), ("../up", b"x"), ("C:/x", b"x"), ("/abs", b"x"), ("in\\..\\..\\up", b"x"), ("big", b"y" * 5000)])
    link = zipfile.ZipInfo("link")
    link.external_attr = archives.LINK
    (tmp_path / "deep").mkdir()
    zipped(tmp_path / "deep/c.zip", [(link, b"target"), ("d/", b""), ("d/é.txt", "é".encode())])
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "_hidden.zip").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    damaged = bytearray((tmp_path / "a.zip").read_bytes())
    damaged[200] ^= 255
    (tmp_path / "z.zip").write_bytes(damaged)
    for partition_bytes in (1 << 26, 7000):  # one partition, and runs of members
        rows = archives.members(spark, str(tmp_path), memberBytes=4000, partitionBytes=partition_bytes)
        assert (rows.rdd.getNumPartitions() > 10) == (partition_bytes == 7000)
        got = rows.collect()
        own = {r.member: r for r in got if r.archive == "a.zip"}
        assert {n: (r.sha256, r.bytes, bytes(r.content), r.problem) for n, r in own.items()} == {n: (hashlib.sha256(c).hexdigest(), len(c), c, None) for n, c in many}
        assert sorted(r.position for r in own.values()) == list(range(300))
        assert {r.member: r.problem for r in got if r.archive == "b.ZIP"} == {"ok": None, "../up": "unsafe_path", "C:/x": "unsafe_path", "/abs": "unsafe_path", "in\\..\\..\\up": "unsafe_path", "big": "too_large"}
        assert [(r.member, r.problem) for r in got if r.archive == "c.zip"] == [("link", "symlink"), ("d/é.txt", None)]
        assert sorted((r.archive, r.problem) for r in got if r.member is None) == [("bad.zip", "unreadable"), ("empty.zip", "unreadable")]
        assert [r.problem for r in got if r.archive == "z.zip"].count("unreadable_member") == 1
    whole = archives.members(spark, str(tmp_path), archiveBytes=20_000).where("archive = 'a.zip'").collect()
    assert {r.problem for r in whole} == {"too_large"} and all(r.content is None for r in whole)


def test_archive_columns(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("x", b"123")])
    archives.register(spark)
    load = lambda schema: spark.read.format("tomeforge_archives").schema(schema).load(str(tmp_path))
    assert [tuple(r) for r in load("member string, archive string").collect()] == [("x", "a.zip")]
    with pytest.raises(Exception, match="no column"):
        load("member string, owner string").collect()
    with pytest.raises(Exception, match="missing scope"):
        spark.read.format("tomeforge_archives").load(str(tmp_path / "none")).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("tomeforge_archives").load(str(tmp_path / "none")).count() == 0


def test_archives_are_written_whole_or_not(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 3}", f"m{i:02}", bytes([i]) * i) for i in range(30)] + [("a0", "null", None)], "archive string, member string, content binary")
    archives.write_archives(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a0.zip", "a1.zip", "a2.zip"]
    got = {(r.archive, r.member): bytes(r.content) for r in archives.members(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"{r.archive}.zip", r.member): bytes(r.content or b"") for r in rows.collect()}
    first = (tmp_path / "out/a1.zip").read_bytes()
    archives.write_archives(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/a1.zip").read_bytes() == first
    with pytest.raises(Exception, match="more than one task"):
        rows.repartition(5, "member").sortWithinPartitions("archive").write.format("tomeforge_archives").mode("append").save(str(tmp_path / "two"))
    with pytest.raises(Exception, match="not a name"):
        archives.write_archives(spark.createDataFrame([("../a", "m", b"")], rows.schema), str(tmp_path / "two"))
    assert not [p for p in (tmp_path / "two").rglob("*") if p.is_file()]


def test_members_of_known_sources(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1, "11", None), ("a", 1, "y", 1, "11", None), ("b", 0, "z", 1, "22", None), ("b", 1, "w", 1, None, "symlink")], "archive string, position int, member string, bytes long, sha256 string, problem string")
    got = archives.catalog_of_members(rows, spark.createDataFrame([("src-9", "22"), ("src-8", "22")], "id string, sha256 string")).orderBy("archive", "position").collect()
    assert [(r.member, r.id, r.duplicate_of) for r in got] == [("x", "src-11", None), ("y", "src-11", "src-11"), ("z", "src-22", "src-8")]


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize(
    "text, field, found",
    [
        ('[1, 22 ,"a]\\"", {"b": [1]}, null]', None, ["1", "22", '"a]\\""', '{"b": [1]}', "null"]),
        (" [ ] ", None, []),
        ('{"a": 1}', None, ['{"a": 1}']),
        ("17", None, ["17"]),
        ('{"v": {"x": [1,2]}, "x": [3, 4], "y": 5}', "x", ["3", "4"]),
        ('{"x": []}', "x", []),
        ("[1, 2", None, ["1", "2", "!unreadable"]),
        ("[1, 2,", None, ["1", "2", "!unreadable"]),
        ("[1 2]", None, ["1", "!unreadable"]),
        ("[1, tru]", None, ["1", "!unreadable"]),
        ("", None, ["!unreadable"]),
        ("{} {}", None, ["!unreadable"]),
        ("[1]", "x", ["!no_object"]),
        ('{"y": 1}', "x", ["!no_field"]),
        ('{"x": 1}', "x", ["!no_array"]),
        ('{"y": 1', "x", ["!unreadable"]),
    ],
)
def test_json_entries(monkeypatch, text, field, found, size):
    monkeypatch.setattr(archives, "CHUNK", size)
    got = archives.entries(iter([text[i : i + size] for i in range(0, len(text), size)]), field)
    assert [e if p is None else f"!{p}" for e, p in got] == found


def test_json_source(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps([{"n": i, "t": "é" * 50} for i in range(5000)], ensure_ascii=False))
    (tmp_path / "b.json").write_bytes(b'["ok", "\xff"]')
    (tmp_path / "c.md").write_text("[1]")
    got = spark.read.format("tomeforge_json").load(str(tmp_path)).orderBy("file", "position").collect()
    assert [json.loads(r.entry)["n"] for r in got[:5000]] == list(range(5000)) and got[4999].position == 4999
    assert [(r.file, r.problem) for r in got[5000:]] == [("b.json", "not_utf8")]


TEXTS = {1: "The ship, the Ship.", 2: "A base", 3: None, 4: "", 5: "Éa the base the ship", 6: "x " * 500}


def index_rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "key long, text string")


def test_index_equals_a_scan_after_each_refresh(spark, tmp_path):
    held = index.Index(spark, str(tmp_path / "i"))
    held.build(index_rows(spark, TEXTS), 16)
    assert [tuple(r) for r in held.search(["THE ship"]).orderBy("key").collect()] == [(1, 4), (5, 3)]
    assert [tuple(r) for r in held.search(["the", "ship"], limit=1).collect()] == [(1, 4)]
    assert [(r.key, r.places) for r in held.phrase("the ship").orderBy("key").collect()] == [(1, [0, 2]), (5, [3])]
    assert [(r.key, r.places) for r in held.phrase("x x").collect()] == [(6, list(range(499)))]
    assert held.search(["nowhere"]).count() == held.search([" "]).count() == held.phrase("!").count() == 0
    before = held.store.manifest()["tables"]["postings"]["parts"]
    assert held.refresh(index_rows(spark, TEXTS)) == {"postings": [], "documents": []} and held.store.number() == 1
    after = {**TEXTS, 2: "A base, ship", 7: "new", 4: "x"}
    del after[1]
    parts = held.refresh(index_rows(spark, after))
    wanted = {index.bucket_of(t, 16) for t in "the ship new x".split()}  # 2 keeps its postings of a and base
    assert set(parts["postings"]) == wanted and held.store.number() == 2
    now = held.store.manifest()["tables"]["postings"]["parts"]
    assert {p: v for p, v in now.items() if int(p) not in wanted} == {p: v for p, v in before.items() if int(p) not in wanted}
    assert [tuple(r) for r in held.search(["ship"]).orderBy("key").collect()] == [(2, 1), (5, 1)]
    fresh = index.Index(spark, str(tmp_path / "j"))
    fresh.build(index_rows(spark, after), 16)
    rows = lambda i, t: sorted(tuple(r) for r in i.store.read(t).collect())
    assert rows(held, "postings") == rows(fresh, "postings") and rows(held, "documents") == rows(fresh, "documents")
    assert {tuple(r) for r in held.store.read("postings", version=1).where("token = 'ship'").select("key").collect()} == {(1,), (5,)}


def test_export_makes_chunks_once_and_moves_no_lines(spark, tmp_path):
    rows = export_lines(spark, {1: 25, 2: 1, 3: 10})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    held = exports.Export(spark, str(tmp_path / "e"))
    held.write(rows)
    assert sorted(r.value for r in held.read().collect()) == sorted(r.value for r in rows.collect()) and held.errors().count() == 0


def test_forms_of_tasks_are_those_of_columns(spark):
    from tomeforge.functions.text import form_of, search_form

    texts = [None, "", " ", *("a%sb" % chr(i) for i in range(1, 0x250)), "Ça, NON — l’été à Ÿ", "é" * 3 + " Ω x1"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search_form(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: form_of(t) for i, t in enumerate(texts)}


def test_index_moves_no_postings(spark, tmp_path):
    held = index.Index(spark, str(tmp_path / "i"))
    rows = spark.range(400).select(F.col("id").alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"), (F.col("id") % 7).cast("string")))).alias("text"))
    plan = index.postings(rows, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    held.build(rows, 8)
    assert held.store.read("postings").count() == 400 * 61
    held.refresh(rows.withColumn("text", F.when(F.col("key") == 3, "w03 w03 new").otherwise(F.col("text"))))
    found = {(r.token, r.key): r.positions for r in held.store.read("postings").where("key in (3, 4)").collect()}
    assert len(found) == 2 + 61 and found["w03", 3] == [0, 1] and found["new", 3] == [2] and found["w04", 4] == [0]


def test_index_errors(spark, tmp_path):
    held = index.Index(spark, str(tmp_path / "i"))
    held.build(index_rows(spark, TEXTS), 8)
    active = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key long")
    assert held.errors(active(*TEXTS)).count() == 0
    assert {tuple(r) for r in held.errors(active(1, 2, 3, 4, 5, 9)).collect()} == {(9, "missing"), (6, "extra")}
    part = index.bucket_of("ship", 8)
    rows = held.store.read("postings", [part]).where("token != 'ship'")
    documents = held.store.read("documents")
    held.store.commit({"postings": (rows, [part], ["token"]), "documents": (documents.union(documents.where("key = 2")), None, ["key"])}, 1, {"buckets": 8})
    assert {tuple(r) for r in held.errors(active(*TEXTS)).collect()} == {(1, "postings"), (5, "postings"), (2, "repeated")}


def test_versions_are_whole(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    rows = lambda *r: spark.createDataFrame(r, "x long, part int")
    assert store.commit({"t": (rows((1, 0), (2, 1), (3, 1)), None, ["x"])}, 0) == 1
    assert store.commit({"t": (rows((4, 1)), [1, 2], ["x"])}, 1) == 2
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, 0), (4, 1)]
    assert sorted(tuple(r) for r in store.read("t", version=1).collect()) == [(1, 0), (2, 1), (3, 1)]
    assert store.read("t", [7]).count() == 0
    with pytest.raises(Conflict):
        store.commit({"t": (rows((5, 0)), [0], ["x"])}, 1)
    with pytest.raises(Conflict):  # two writers that start at once: the second one's manifest is there already
        store.number = lambda: 1
        store.commit({"t": (rows((5, 0)), [0], ["x"])}, 1)
    del store.number
    with pytest.raises(ValueError):
        store.commit({"t": (rows((5, 0)), [1], ["x"])}, 2)
    assert store.number() == 2 and store.commit({"t": (rows(), [0, 1], ["x"])}, 2) == 3 and store.read("t").count() == 0
    assert not [p for p in (tmp_path / "v/manifest").iterdir() if "waiting" in p.name]


def sheet_xml(body):
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def workbook(path, sheets, strings=None, relations=True):
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="n{i}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        if relations:
            z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + f'<Relationship Id="s" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst>{strings or ''}</sst>")
        for i, body in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", body)


def test_workbooks(spark, tmp_path):
    strings = '<si><t>one</t></si><si><r><t>rich </t></r><r><t xml:space="preserve"> text</t></r><rPh><t>no</t></rPh></si><si/>'
    first = sheet_xml('<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><f>SUM(A1:B2)</f><v>7</v></c><c t="b"><v>1</v></c></row><row/><row><c t="inlineStr"><is><t>in</t></is></c><c r="AB4" t="s"><v>1</v></c><c t="n"><v>1.50</v></c><c t="e"><v>#REF!</v></c></row>')
    workbook(tmp_path / "a.xlsx", [first, sheet_xml(""), sheet_xml('<row><c t="s"><v>9</v></c></row>'), sheet_xml('<row><c><v>1</v></c></row>')[:-9], "<!DOCTYPE x [<!ENTITY a 'b'>]>" + sheet_xml(""), sheet_xml('<row><c r="ZZZZ1"><v>1</v></c></row>')], strings)
    workbook(tmp_path / "b.xlsx", [sheet_xml("")], relations=False)
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    got = workbooks.workbooks(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got if r.file == "a.xlsx"] == [
        ("a.xlsx", 1, "n0", 2, [None, "one", None, "=SUM(A1:B2)", "TRUE"], None),
        ("a.xlsx", 1, "n0", 4, ["in", *[None] * 26, "rich  text", "1.50", "#REF!"], None),
        ("a.xlsx", 3, "n2", None, None, "unknown_string"),
        ("a.xlsx", 4, "n3", 1, ["1"], None),
        ("a.xlsx", 4, "n3", None, None, "unreadable"),
        ("a.xlsx", 5, "n4", None, None, "unsafe_xml"),
        ("a.xlsx", 6, "n5", None, None, "bad_reference"),
    ]
    assert [(r.file, r.sheet, r.problem) for r in got if r.file != "a.xlsx"] == [("b.xlsx", None, "missing xl/_rels/workbook.xml.rels"), ("c.xlsx", None, "unreadable")]
    assert {r.problem for r in workbooks.workbooks(spark, str(tmp_path), memberBytes=80).where("file = 'a.xlsx'").collect()} == {"too_large"}
    found = workbooks.units(workbooks.workbooks(spark, str(tmp_path))).orderBy("unit").collect()
    assert [(r.unit, r.n_rows) for r in found] == [(1, 2), (4, 1)] and found[0].text.split("\n")[0] == "|  | one |  | =SUM(A1:B2) | TRUE |"


def test_written_workbooks_are_read_as_they_were(spark, tmp_path):
    rng = random.Random(5)
    values = ["", "a & b", "<x>", "=1+2", "=A1&\"<\"", "-0.5", "007", "é 🙂", "  two  blanks ", "12", None, "=="]
    rows = [(f"w{w}", s, f"s{s} & co", r, [rng.choice(values) for _ in range(rng.randrange(1, 40))]) for w in range(3) for s in range(1, 4) for r in range(1, 30, 2)]
    frame = spark.createDataFrame(rows, "workbook string, sheet int, name string, row int, cells array<string>")
    workbooks.write_workbooks(workbooks.members_of_workbooks(frame), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in workbooks.workbooks(spark, str(tmp_path / "out")).collect())

    def trimmed(cells):
        while cells and cells[-1] is None:
            cells = cells[:-1]
        return cells

    assert got == sorted((f"{w}.xlsx", s, name, r, trimmed(cells), None) for w, s, name, r, cells in rows if trimmed(cells))


def export_lines(spark, nodes, parts=4):
    """nodes: node -> number of items."""
    rows = [(n, i, {"i": i}) for n, count in nodes.items() for i in range(count)]
    items = spark.createDataFrame(rows, "node long, i int, item struct<i:int>").repartition(3)
    return exports.lines([exports.chunked(items, ["i"], "claims", 10)], parts)


def test_exports(spark, tmp_path):
    held = exports.Export(spark, str(tmp_path / "e"))
    assert held.write(export_lines(spark, {1: 25, 2: 1, 3: 10, 4: 400}))
    got = [json.loads(r.value) for r in held.read().collect()]
    assert all(len(x["items"]) <= 10 for x in got)
    whole = {}
    for x in sorted(got, key=lambda x: x["chunk"]):
        whole.setdefault(x["node"], []).extend(i["i"] for i in x["items"])
    assert whole == {1: list(range(25)), 2: [0], 3: list(range(10)), 4: list(range(400))}
    assert held.errors().count() == 0 and held.write(export_lines(spark, {1: 25, 2: 1, 3: 10, 4: 400})) == [] and held.store.number() == 1
    before = held.store.manifest()["tables"]["lines"]["parts"]
    assert held.write(export_lines(spark, {1: 25, 2: 1, 3: 10, 4: 401})) == [index.bucket_of("4", 4)]
    now = held.store.manifest()["tables"]["lines"]["parts"]
    assert [p for p in now if now[p] != before.get(p)] == [str(index.bucket_of("4", 4))]
    assert set(held.write(export_lines(spark, {1: 25, 3: 10, 4: 401}))) == {index.bucket_of("2", 4)} and '"node":2' not in "".join(r.value for r in held.read().collect())
    for path in (tmp_path / "e/lines").rglob(f"part={index.bucket_of('3', 4)}/part-*.txt"):
        path.write_text(path.read_text().replace('{"i":9}', '{"i":8}'))
        (path.parent / f".{path.name}.crc").unlink()
    assert [tuple(r) for r in held.errors().collect()] == [(index.bucket_of("3", 4), "digest")]


def leaves(spark, n, changed=()):
    rows = [(f"s{i // 20}", i % 20, "markdown", f"{i}-{'x' if i in changed else ''}") for i in range(n)]
    return spark.createDataFrame(rows, "source string, unit int, kind string, sha256 string")


def test_hash_trees_read_only_what_differs(spark, tmp_path, monkeypatch):
    a = hashtree.HashTree(spark, str(tmp_path / "a")).write(leaves(spark, 1000))
    b = hashtree.HashTree(spark, str(tmp_path / "b")).write(leaves(spark, 1000).repartition(3))
    assert hashtree.differing(a, b) == [] and hashtree.drift(a, b).count() == 0
    b.write(leaves(spark, 990, changed=(5, 6, 333)))
    before = a.store.manifest()
    assert a.write(leaves(spark, 1000)).store.manifest() == before, "the same leaves make no version"
    parts = {index.bucket_of(s, hashtree.BUCKETS) for s in ("s0", "s16", "s49")}
    assert set(hashtree.differing(a, b)) == parts
    read, given = [], Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, table, some=None, version=None: (read.append(some), given(self, table, some, version))[1])
    got = sorted((r.source, r.unit, r.status) for r in hashtree.drift(a, b).collect())
    assert got == [("s0", 5, "changed"), ("s0", 6, "changed"), ("s16", 13, "changed"), *(("s49", i, "missing") for i in range(10, 20))]
    assert all(set(some) == parts for some in read)
    assert {r.status for r in hashtree.drift(b, a).collect()} == {"changed", "extra"}


def pilot_tables(spark):
    rows = spark.createDataFrame([(str(i), f"s{i % 3}", f"n{i}", "u", f"body {i}") for i in range(12)], "source_key string, source_id string, name string, universe string, body string")
    rows = rows.withColumn("id", pilot.record_id(F.col("source_key"))).withColumn("current_version", pilot.version_of(F.col("name"), F.col("universe"), F.col("body")))
    ids = {r.source_key: r.id for r in rows.collect()}
    made = spark.createDataFrame([("t", ids[str(i)], ids[str(i + 1)] if i % 2 else None, float(i), "pending" if i else "stale") for i in range(10)], "task string, a string, b string, score double, status string")
    sources = spark.createDataFrame([(f"s{i}", f"title {i}") for i in range(9)], "source_id string, title string")
    profiles = rows.select(F.col("current_version").alias("version_id"), F.lit("{}").alias("stats"))
    return made.withColumn("id", pilot.job_id(F.col("task"), F.col("a"), F.col("b"))), rows, sources, profiles


def test_pilot_snapshots(spark, tmp_path):
    tables = pilot_tables(spark)
    held = pilot.Pilot(spark, str(tmp_path / "p"))
    assert held.create(*tables, limit=3) == {"jobs": 3, "records": 4, "sources": 3, "profiles": 4}
    assert sorted(r.score for r in held.open()["jobs"].collect()) == [7.0, 8.0, 9.0]
    with pytest.raises(FileExistsError):
        pilot.Pilot(spark, str(tmp_path / "p")).create(*tables, limit=3)
    with pytest.raises(ValueError):
        pilot.Pilot(spark, str(tmp_path / "q")).create(*tables, limit=0)
    with pytest.raises(pilot.Refused, match="not finished"):
        pilot.Pilot(spark, str(tmp_path / "none")).open()
    file = next((tmp_path / "p/jobs").rglob("*.parquet"))
    data = file.read_bytes()
    file.unlink()
    with pytest.raises(pilot.Refused):
        held.open()
    file.write_bytes(data)
    assert len(held.open()) == 4
    more = next((tmp_path / "p/records").rglob("*.parquet"))
    (more.parent / f"again-{more.name}").write_bytes(more.read_bytes())
    with pytest.raises(pilot.Refused, match="records has changed"):
        held.open()


@pytest.mark.parametrize("change, error", [(("records", "source_key", "'x'"), "identity"), (("records", "body", "'other'"), "version"), (("jobs", "task", "'u'"), "job")])
def test_pilot_copies_that_do_not_hold_together(spark, tmp_path, change, error):
    proposals, records, sources, profiles = pilot_tables(spark)
    table, column, value = change
    if table == "records":
        records = records.withColumn(column, F.expr(value))
    else:
        proposals = proposals.withColumn(column, F.expr(value))
    held = pilot.Pilot(spark, str(tmp_path / "p"))
    with pytest.raises(pilot.Refused, match=error):
        held.create(proposals, records, sources, profiles, 5)
    assert {r.error for r in held.errors().collect()} == {error}


def test_pilot_jobs_whose_record_is_missing(spark, tmp_path):
    proposals, records, sources, profiles = pilot_tables(spark)
    with pytest.raises(pilot.Refused, match="record"):
        pilot.Pilot(spark, str(tmp_path / "p")).create(proposals, records.where("source_key != '9'"), sources, profiles, 5)
