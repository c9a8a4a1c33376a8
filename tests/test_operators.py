import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tomeforge.functions.text import paragraph_rows
from tomeforge.operators import audit, blocks, catalog, coverage, curation, graph, progress
from tomeforge.sources import files
from tomeforge.sources.html_markdown import to_markdown
from tomeforge.streaming import jobs


def test_redirect_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "missing"), ("e", "e"), ("f", None), ("g", "f")], "id string, redirect_to string")
    assert {r.id for r in graph.redirects_into_cycles(rows).collect()} == {"a", "b", "c", "e"}
    assert graph.redirects_into_cycles(rows.where("id = 'f'")).count() == 0


def test_descendants(spark):
    rows = spark.createDataFrame([(1, 99), (2, 1), (3, 2), (4, 99)], "id int, parent int")
    assert {r.id for r in graph.descendants(rows, 1).collect()} == {1, 2, 3}


def test_itinerary(spark):
    schema = "id string, a string, b string, kind string, hours_min double, hours_max double"
    rows = spark.createDataFrame([("ab", "A", "B", "trade", 1.0, 9.0), ("bc", "B", "C", "rift", 1.0, 9.0), ("ac", "A", "C", "trade", 3.0, 3.0), ("cd", "C", "D", "trade", None, None)], schema)
    found = graph.itinerary(rows, "A", "C", factor=2.0).first()
    assert (found.nodes, found.routes, found.hours_min, found.hours_max, found.contains_rift) == (["A", "B", "C"], ["ab", "bc"], 4.0, 36.0, True)
    assert graph.itinerary(rows, "A", "C", rift=False).first().routes == ["ac"]
    assert graph.itinerary(rows, "A", "A").first().routes == []
    assert graph.itinerary(rows, "A", "D").count() == 0 and graph.itinerary(rows, "X", "A").count() == 0
    with pytest.raises(ValueError):
        graph.itinerary(rows, "A", "B", factor=0)


def covered(spark, *docs):
    rows = [("e", d[0], n, d[1], d[2] if len(d) > 2 else None, d[3] if len(d) > 3 else False, d[4] if len(d) > 4 else None) for n, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "entity string, document string, position int, body string, profile string, has_image boolean, answers string")
    return {r.document: r for r in coverage.coverage(frame).collect()}


def test_coverage_is_cumulative(spark):
    got = covered(spark, ("a", "Has a base.\n\nOwns a ship."), ("b", "Unrelated artifact."), ("c", "Owns a ship.\n\nUnrelated artifact."))
    assert got["b"].selection == "retain" and got["c"].reason == "exact_unit_coverage" and got["c"].covered_by == ["a", "b"]
    assert covered(spark, ("a", "Lives there. Has a ship."), ("b", "Lives there.\n\nHas a ship."))["b"].reason == "exact_normalized_text"


def test_coverage_protects(spark):
    assert covered(spark, ("a", "Hull 4D."), ("b", "Hull 5D."))["b"].reason == "new_numeric_or_dice_information"
    got = covered(spark, ("a", "Same.", '{"hull":"4D"}'), ("b", "Same.", '{"hull":"5D"}'), ("c", "", None, True))
    assert got["b"].selection == got["c"].selection == "retain"
    two = "Commands the base.\n\nHas an unusual ship."
    for answers, expected in [({"commands the base.": 0.99, "has an unusual ship.": 0.1}, "retain"), ({"commands the base.": 0.99}, "retain"), ({"*": 0.99}, "exclude_redundant"), ({"*": 0.8}, "retain"), ({"*": 0.8001}, "exclude_redundant")]:
        assert covered(spark, ("a", "The pilot."), ("b", two, None, False, json.dumps(answers)))["b"].selection == expected


def tiles(spark, *fragments):
    rows = [(1, "abcdefghi", 0, 9, a, b, body) for a, b, body in fragments]
    found = curation.tiling_errors(spark.createDataFrame(rows, "p int, body string, offset_start int, offset_end int, fragment_start int, fragment_end int, fragment_body string"), "p").collect()
    return [r.reason for r in found]


def test_tiling(spark):
    assert tiles(spark, (0, 5, "abcde"), (5, 9, "fghi")) == []
    assert tiles(spark, (0, 5, "abcde"), (6, 9, "ghi")) == ["gap"]
    assert tiles(spark, (0, 5, "abcde"), (4, 9, "efghi")) == ["overlap"]
    assert tiles(spark, (0, 5, "abcdX"), (5, 9, "fghi")) == ["body"]
    assert tiles(spark, (0, 5, "abcde")) == ["missing_tail"]


def test_catalog_and_units(spark):
    rows = spark.createDataFrame([("h1", "b", "b/1", 1, 5), ("h1", "a", "z/2", 0, 5), ("h1", "a", "z/3", 0, 5), ("h2", "a", "z/1", 0, 1)], "sha256 string, collection string, path string, scope int, bytes int")
    got = {r.sha256: r for r in catalog.catalog(rows).collect()}
    assert (got["h1"].path, got["h1"].copies, got["h1"].collections) == ("z/2", ["z/3", "b/1"], ["a", "b"]) and got["h2"].copies == []
    assert {(r.sha256, r.path, r.n_copies, tuple(r.collections)) for r in catalog.firsts(rows).collect()} == {(h, r.path, len(r.copies), tuple(r.collections)) for h, r in got.items()}
    assert {(r.path, r.copy_of) for r in catalog.copies(rows).collect()} == {("z/3", "z/2"), ("b/1", "z/2")}
    missing = catalog.missing_units(spark.createDataFrame([("s", 3), ("t", 0)], "source string, pages int"), spark.createDataFrame([("s", 2)], "source string, page int"))
    assert {r.page for r in missing.collect()} == {1, 3}


def test_audit(spark):
    rows = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "id int, ref string")
    parents = spark.createDataFrame([("x",)], "k string")
    assert [(r.id, r.rows) for r in audit.duplicates(rows, "id").collect()] == [(1, 2)]
    assert [r.id for r in audit.orphans(rows, "ref", parents, "k").collect()] == [2]


def test_progress(spark):
    seen = spark.createDataFrame([(10,)], "milestone int")
    done = spark.createDataFrame([(35,)], "done int")
    assert {r.milestone for r in progress.milestones(done, "done", 10, seen).collect()} == {20, 30}
    samples = spark.createDataFrame([("s", 1, "r", 26), ("s", 2, None, 0), ("s", 3, "r", 26), ("s", 4, "r", 26), ("t", 1, "r", 100)], "k string, n int, reason string, mib int")
    got = {(r.k, r.n) for r in progress.confirmed(samples, "k", "n", "reason", "mib").where("confirmed").collect()}
    assert got == {("s", 4), ("t", 1)}


def test_yield_reason(spark):
    def reason(rows, own=(), **kw):
        p = spark.createDataFrame(rows, "pid int, name string, dedicated_bytes long, engine_percent int")
        return progress.yield_reason(p, spark.createDataFrame([(x,) for x in own], "pid int"), kw.pop("used", 27540), kw.pop("free", 5000), **kw).first().reason

    mib = 1 << 20
    assert reason([(1, "python.exe", 27500 * mib, 90), (2, "dwm.exe", 80 * mib, 3), (3, "LockApp.exe", 18 * mib, 2)], {1}, baseline_mib=27540) is None
    assert reason([(3, "x", 64 * mib, 0)], {1}) == reason([(4, "x", 0, 1)], {1}) == "foreign_5090_process"
    assert reason([], {1}, used=28000, baseline_mib=27540) == "additional_5090_memory_use"
    assert reason([], free=20000, need_mib=27000) == "5090_not_available"


def test_markdown():
    page = '<script>NOT_THIS</script><h1>Titre</h1><a href="other.html"><img src="test.png" alt="Plan"></a><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><img src="https://example.invalid/x.png"><img src="../../outside.png">'
    got = to_markdown(page, {"test.png"})
    assert "NOT_THIS" not in got["markdown"] and "# Titre" in got["markdown"] and "[![Plan](../images/" in got["markdown"] and ")](other.html)" in got["markdown"] and "| A | B |" in got["markdown"]
    assert got["media"] == ["test.png"] and set(got["warnings"]) == {"remote-image-not-fetched", "missing-local-image"}


def png(width=2, height=3):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def test_images(spark):
    rows = [(png(), "image/png"), (png(), "image/gif"), (png()[:-4], "image/png"), (b"GIF89a" + struct.pack("<HH", 7, 8), None), (b"", None), (None, None), (b"zzzz", None)]
    got = spark.createDataFrame(rows, "c binary, t string").select(files.image_info("c", "t").alias("i")).select("i.*").collect()
    assert [(r.type, r.width, r.problem) for r in got] == [("image/png", 2, None), ("image/png", 2, "declared_type"), (None, None, "damaged"), ("image/gif", 7, None), (None, None, "size"), (None, None, "size"), (None, None, "unknown")]


def test_archives(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("../b.txt", "no")
    got = {r.member: r for r in files.archive_members(spark.createDataFrame([("x.zip", held.getvalue()), ("bad.zip", b"no")], "path string, content binary")).collect()}
    assert got["a.txt"].bytes == 5 and got["../b.txt"].problem == "unsafe_path" and got[None].problem == "unreadable"


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src-1/pages").mkdir(parents=True)
    (tmp_path / "src-1/pages/0001.md").write_text("one")
    (tmp_path / "src-1/pages/0002.md").write_text("two")
    pages = files.markdown_pages(spark, str(tmp_path))
    assert {(r.source, r.page, r.text) for r in pages.collect()} == {("src-1", 1, "one"), ("src-1", 2, "two")}
    listed = files.inventory(spark, [("c", str(tmp_path))]).collect()
    assert len(listed) == 2 and all(r.kind == "document" and r.id == f"src-{r.sha256[:16]}" for r in listed)
    files.publish(pages, spark.createDataFrame([("src-1",)], "source string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    files.export_bundle(spark.createDataFrame([("n",)], "name string"), spark.createDataFrame([(1,)], "id int"), str(tmp_path / "bundle"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "bundle")).collect()]
    assert {x["part"] for x in lines} == {"campaign", "entity"}
    assert spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(files.finite(F.col("x")).alias("x")).collect()[0].x is None


def test_streams(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.arriving(spark, str(tmp_path / "in"), "id long", files_a_batch=1)
    jobs.run_available(stream, jobs.progress_sink(str(tmp_path / "out"), 12), str(tmp_path / "check"))
    jobs.run_available(jobs.arriving(spark, str(tmp_path / "in"), "id long", 1), jobs.progress_sink(str(tmp_path / "out"), 12), str(tmp_path / "check"))
    assert {r.milestone for r in spark.read.parquet(str(tmp_path / "out/milestones")).collect()} == {12, 24}
    assert spark.read.parquet(str(tmp_path / "out/counts")).agg(F.sum("documents")).first()[0] == 30


def test_gate_stream(spark, tmp_path):
    rows = [("s", 1, "r", 26), ("s", 2, None, 0), ("s", 3, "r", 26), ("s", 4, "r", 26), ("t", 1, "r", 100)]
    spark.createDataFrame(rows, "stream string, seq long, reason string, dedicated_mib int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.arriving(spark, str(tmp_path / "in"), "stream string, seq long, reason string, dedicated_mib int")
    query = jobs.gate(stream).writeStream.format("memory").queryName("gate_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.stream, r.seq) for r in spark.table("gate_out").collect()} == {("s", 4), ("t", 1)}


def test_unit_counts(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name in ("xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/worksheets/_rels/sheet1.xml.rels"):
            z.writestr(name, "<x/>")
    rows = spark.createDataFrame([("a.XLSX", held.getvalue()), ("b.html", b"x"), ("c.xlsx", b"no"), (None, None)], "path string, content binary")
    assert [r.n for r in rows.select(files.unit_count("path", "content").alias("n")).collect()] == [2, 1, None, 1]


def test_places_in_order(spark):
    from tomeforge.operators.ordered import placed

    rows = [("b", 2), ("a", 9), ("b", 1), (None, 5), ("a", 3)] + [("c", i) for i in range(200)]
    got = placed(spark.createDataFrame(rows, "k string, n int"), "k", "n").collect()
    assert [(r.k, r.n) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[0] is not None, r)) and sorted(r.place for r in got) == list(range(1, 206))


def test_optimistic_writes(spark):
    import hashlib

    from tomeforge.operators import records

    rev = lambda x: hashlib.sha256(x.encode()).hexdigest()
    now = spark.createDataFrame([(1, "one"), (2, "two")], "id int, body string")
    writes = spark.createDataFrame([(1, 1, rev("one"), "uno"), (1, 2, rev("one"), "eins"), (1, 3, rev("uno"), "un"), (2, 1, rev("two"), ""), (2, 2, None, "zwei"), (3, 1, rev("x"), "y")], "id int, seq int, expected string, body string")
    done = records.optimistic_writes(now, writes, F.col("body") != "")
    assert [(r.id, r.seq, r.status) for r in done.orderBy("id", "seq").collect()] == [(1, 1, "saved"), (1, 2, "conflict"), (1, 3, "conflict"), (2, 1, "invalid"), (2, 2, "conflict"), (3, 1, "unknown")]
    after, backup, unclear = records.saved_rows(now, writes, done)
    assert unclear.count() == 0
    assert {(r.id, r.body) for r in after.collect()} == {(1, "uno"), (2, "two")} and [(r.id, r.body) for r in backup.collect()] == [(1, "one")]
    twice = now.union(now.where("id = 1"))
    assert [r.id for r in records.saved_rows(twice, writes, done)[2].collect()] == [1] and records.saved_rows(twice, writes, done)[1].count() == 0


def test_coherent_blocks(spark):
    told = "He rolls 3D and moves on. Then he stops."
    texts = {
        1: ["# Title\n\n## Part\n\n" + told + "\n\n", told + "\n\n", "Move\n\n10\n\nSkill: 3D+1\nDodge: 4D\n\nReach\n\n\n2D"],
        2: ['{"name": "x",\n\n"move": 10}'],
        3: ["Skill: 1D\n\n" * 3, "Skill: 1D\n\n" * 3, "Skill: 1D\n\nMove\n\n10\n\n"],
        4: ["short"],
    }
    rows = [(k, "".join(v)) for k, v in texts.items()] + [(5, ""), (6, None)]
    made = blocks.coherent_blocks(spark.createDataFrame(rows, "key long, text string"), "key", "text", paragraph_rows, target=33)
    got = {}
    for r in made.orderBy("key", "block").collect():
        got.setdefault(r.key, []).append(r.body)
        assert dict(rows)[r.key][r.start : r.end] == r.body
    assert got[2] == texts[2] and got[4] == texts[4] and got[3] == texts[3] and set(got) == {1, 2, 3, 4}
    assert "".join(got[1]) == dict(rows)[1] and got[1][:2] == texts[1][:2] and got[1][2].startswith("Move\n\n10\n\nSkill")


def test_paragraph_additions(spark):
    rows = [
        ("e", 1, 0, 1, "A  ship.", True, None, 10), ("e", 2, 1, 1, "a ship.", False, [0.1], 10), ("e", 2, 1, 2, "Previous page", False, [0.9], 10), ("e", 2, 1, 3, "New.", False, [0.95, 0.8], 10),
        ("e", 3, 2, 1, "Told.", False, [0.9, 0.81], 10), ("e", 3, 2, 2, "Told.", False, [0.2], 10), ("e", 3, 2, 3, "Told.", False, [0.9], 10), ("e", 3, 2, 4, "Long.", False, [0.9], 2049), ("e", 3, 2, 5, "Half.", False, [0.9, None], 10), ("e", 3, 2, 6, "None.", False, [], None), ("f", 4, 0, 1, "New.", False, [0.99], 10),
    ]
    frame = spark.createDataFrame(rows, "entity string, document int, rank int, position int, text string, is_reference boolean, scores array<double>, context_tokens int")
    got = curation.paragraph_additions(frame, F.lower("text") == "previous page").orderBy("entity", "document", "position").collect()
    assert [(r.number, r.status, r.reason) for r in got] == [
        ("P00001", "reference", "reference"), ("P00001", "skip_redundant", "exact_copy"), ("P00002", "metadata", "metadata"), ("P00003", "add", "adds"), ("P00001", "skip_redundant", "scored"), ("P00002", "add", "adds"),
        ("P00003", "skip_redundant", "exact_copy"), ("P00004", "add_uncertain", "context_too_long"), ("P00005", "add_uncertain", "unanswered"), ("P00006", "add_uncertain", "unanswered"), ("P00001", "skip_redundant", "scored"),
    ]
    assert tuple(got[1].covered_by) == (1, 1) and tuple(got[6].covered_by) == (3, 2)


def test_milestones_of_many_events(spark):
    from tomeforge.plans import curating

    events = spark.range(2_102_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10_000 != 0, "a").alias("event_type"))  # 211 without a type
    got = {r.milestone for r in curating.milestones(lambda name: events, spark).collect()}
    assert got == {m for m in range(700, 2_102_000 - 211 + 1, 700) if m % 2100}
