import json
import random

import pytest
from pyspark.sql import functions as F

from tomeforge.functions import json_paths
from tomeforge.functions import records as rec
from tomeforge.functions import text as tx


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" if v is None or isinstance(v, str) else f"{n} double" for n, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,expected", [("  Éà-Ção! ", "ea cao"), (None, ""), ("A--b", "a b"), ("ﬁ", ""), ("é", "e")])
def test_search_form(spark, text, expected):
    assert one(spark, tx.search_form(F.col("t")), t=text) == expected


def test_escape(spark):
    assert one(spark, tx.escape_html(F.col("t")), t="<a & \"b\" 'c'>") == "&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt;"
    assert one(spark, tx.escape_html(F.col("t")), t=None) == ""


@pytest.mark.parametrize("text,expected", [("3D", (3, 0, 9)), (" 3d + 1 ", (3, 1, 10)), ("3D+3", None), ("1000D", None), ("x3D", None), ("3D\nx", None), (None, None)])
def test_dice(spark, text, expected):
    found = one(spark, tx.dice(F.col("t")), t=text)
    assert (tuple(found)[:3] if found else None) == expected


@pytest.mark.parametrize("hours,expected", [(None, "inconnue"), (0.0, "0 h"), (25.5, "1 j 1 h 30 min"), (1.0, "1 h"), (0.0084, "1 min")])
def test_format_hours(spark, hours, expected):
    assert spark.createDataFrame([(hours,)], "h double").select(tx.format_hours(F.col("h")).alias("x")).first().x == expected


def test_duration_label(spark):
    frame = spark.createDataFrame([(2.0, 2.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r.x for r in frame.select(tx.duration_label(F.col("a"), F.col("b"), 2.0).alias("x")).collect()] == ["4 h", "2 h – 4 h", "Durée inconnue"]


def test_passage(spark):
    page = "<!-- source: s; pdf_page: 4 --> Hello START one END two"
    assert one(spark, tx.passage(F.col("t"), "START", "END"), t=page) == "START one"
    assert one(spark, tx.passage(F.col("t"), None, None), t=page) == "Hello START one END two"
    assert one(spark, tx.passage(F.col("t"), None, None), t="abcdef") == "cdef"
    assert one(spark, tx.passage(F.col("t"), "MISSING", None), t=page) is None
    assert one(spark, tx.passage(F.col("t"), "START", "NOWHERE"), t=page) is None
    assert tuple(one(spark, tx.page_header(F.col("t")), t=page)) == ("s", "pdf_page", 4)


def test_quote_pieces():
    assert tx.quote_pieces("x" * 1100) == ["x" * 1100]
    text = "word " * 500
    pieces = tx.quote_pieces(text)
    assert all(len(p) <= 1100 and not p.startswith(" ") for p in pieces) and " ".join(pieces) == text.strip()
    assert tx.quote_pieces(None) == [] and tx.quote_pieces("   ") == []
    assert [len(p) for p in tx.quote_pieces("é" * 2300)] == [1100, 1100, 100]


def test_units_partition(spark):
    text = "A long sentence. " * 250 + "\n\nSecond paragraph.\n \n\n third"
    units = tx.paragraph_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("n").collect()
    assert "".join(u.body for u in units) == text and len(units) == 3
    assert all(text[u.start : u.end] == u.body for u in units)


def test_native_text_once(spark):
    twice = tx.with_native_text(tx.with_native_text(F.col("t"), F.col("n")), F.col("n"))
    found = one(spark, twice, t="Page \n\n", n="  a  \n b ")
    assert found.count(tx.NATIVE_TEXT_MARKER) == 1 and found.startswith("Page\n\n<!--") and found.endswith("a\n b\n")


def test_links_and_paths(spark):
    assert one(spark, tx.image_links(F.col("t")), t="![a](x.png) ![b](http://h/y.png) ![c](data:x)") == ["x.png"]
    for path, ok in [("a/b.md", True), ("../x", False), ("/etc", False), ("C:x", False), ("http://x", False), ("a/../b", False), ("", False)]:
        assert one(spark, tx.safe_path(F.col("t")), t=path) is ok


def test_stat_fields(spark):
    got = one(spark, rec.stat_fields(F.col("t")), t=json.dumps({"stats": {"DEX": "3D"}, "a/b": 1, "weapons": {"damage": "4D"}}))
    assert [(r.field, r.source_path, r.unit, r.total_pips) for r in got] == [("attribute.dexterity", "/stats/DEX", "dice", 9)]
    assert one(spark, rec.stat_fields(F.col("t")), t="not json") == []
    deep = {"hull": 1}
    for _ in range(7):
        deep = {"stats": deep}
    assert one(spark, rec.stat_fields(F.col("t")), t=json.dumps(deep)) == []
    for _ in range(2):
        deep = deep["stats"]
    whole = {"Force": {"Hull ": None, "zz": 1, "~a/Cost": [1], "S p a c e": 2.5, "Data": deep}, "hull": "x", "Stats": "3D", "attrs": {"Dextérité": "10d + 2", "STRENGTH": True, "str": {"hull": 1}}, "é": 1, "~/Price": "4D+1"}
    got = [(r.field, r.source_path, r.unit, r.value_raw, r.total_pips) for r in one(spark, rec.stat_fields(F.col("t")), t=json.dumps(whole))]
    assert got == [
        ("hull", "/Force/Hull ", "source_value", "null", None), ("speed.space", "/Force/S p a c e", "source_value", "2.5", None), ("hull", "/hull", "source_value", "x", None),
        ("attribute.strength", "/attrs/STRENGTH", "source_value", "true", None), ("cost", "/~0~1Price", "dice", "4D+1", 13),
    ]
    assert one(spark, rec.stat_fields(F.col("t")), t=json.dumps({"data": {"system": {"hull": 7}}}))[0].source_path == "/data/system/hull"
    for t in ('[{"hull": 1}]', '"hull"', "", '{"hull": 1, "hull": 2}', "null", None):
        assert one(spark, rec.stat_fields(F.col("t")), t=t) == []


def test_category_kind(spark):
    kind = lambda *c: spark.range(1).select(rec.category_kind(F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")).alias("x")).first().x
    assert kind("Relationships") == "unknown" and kind("VÉHICULES volés") == "craft_model" and kind("People", "Droids") == "droid_model" and kind() == "unknown"


def test_section(spark):
    row = spark.createDataFrame([(None, "Category: X", 0, "import", "person", None), ("source", "Category: X", 0, "import", "person", None), (None, "x", None, "phase3_extraction", "event", "addons"), (None, "x", None, None, "event", "addons")], "s string, n string, ns int, o string, k string, c string")
    found = [r.x.section for r in row.select(rec.section(*map(F.col, ("s", "n", "ns", "o", "k", "c"))).alias("x")).collect()]
    assert found == ["metadata", "source", "scenario", "reference"]


def test_usage_cost(spark):
    rows = spark.createDataFrame([(100_000, 0, 0, 0, 0, False), (100_001, 0, 0, 0, 0, False), (100_000, 0, 0, 0, 0, True), (1, 1, 1, 5, 6, False)], "i long, o long, r long, w long, h long, b boolean")
    found = [r.x for r in rows.select(rec.usage_cost(*map(F.col, "iorwhb")).alias("x")).collect()]
    assert [float(x) if x is not None else None for x in found] == [0.01, 0.0500005, 0.005, None]


def test_polygon(spark):
    points = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],), ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], f"p {points}")
    assert [r.x for r in rows.select(rec.is_polygon(F.col("p")).alias("x")).collect()] == [True, False, False]


class TestProfiles:
    def test_provenance_makes_no_variant(self):
        a = {"Name": "Pilot", "id": "old", "URL": "https://a", "Source": "Book", "Sheet Index": 3, "HTML": "<p>", "DEX": " 3d + 1 ", "description": "Quiet."}
        b = {"name": "Captain", "id": "new", "url": "https://b", "source": "B", "Entry Index": 7, "dexterity": "3D+1", "description": "Old."}
        assert rec.profile(a) == rec.profile(b) == {"attribute.dexterity": {"dice": 3, "pips": 1}}

    def test_mechanics_are_kept(self):
        assert rec.profile({"STR": "3D"}) != rec.profile({"strength": "3D+1"})
        gun = lambda name, n: rec.profile({"weapons": [{"name": name, "damage": "4D", "quantity": n}]})
        assert gun("pistol", 1) != gun("rifle", 1) != gun("rifle", 2) and gun("pistol", 1)["weapons"][0]["name"] == "pistol"
        made = rec.profile({"experimental rule": {"charges": 7}, "skills": {"Starship gunnery": "5d+2"}, "special abilities": {"Aquatic": {"description": "Can breathe."}}})
        assert made["experimentalrule"]["charges"] == 7 and made["skills"]["starshipgunnery"] == {"dice": 5, "pips": 2}
        assert made["specialabilities"]["aquatic"]["description"] == "Can breathe."
        assert "description" in rec.profile({"Description": "Adds +1D to damage."}) and rec.profile({"Description": "Silver."}) == {}

    def test_conflicts_idempotence_and_bad_input(self):
        value = {"DEX": "3D", "Dexterity": "4D", "cover": "+1D", "model": "Heavy"}
        made = rec.profile(value)
        assert len(made["attribute.dexterity"]["$conflicting_values"]) == 2 and rec.profile(made) == made
        assert rec.profile({"Dexterity": "4D", "DEX": "3D"})["attribute.dexterity"] == made["attribute.dexterity"]
        assert "cover" in made and rec.profile({"cover": "https://x/art.png"}) == {}
        assert rec.profile('{"DEX":"3D"}') == rec.profile({"DEX": "3D"}) and rec.profile(None) == {} and rec.profile("not JSON") == {"unparsed_profile": "not JSON"}


@pytest.mark.parametrize(
    "candidate,retained,expected",
    [
        ((None, "REPUBLIC", None), [(None, " republic ", None)], []),
        ((None, "Empire", None), [(None, "Republic", None)], ["new_epoch"]),
        ((None, None, "Legends"), [(None, None, "LEGENDS")], []),
        ((None, None, "Modern canon"), [(None, None, "Legends")], ["distinct_profile"]),
        (("1e", "new", None), [("1E", "Old", None), ("2E", "New", None)], ["distinct_profile"]),
        (("2E", "Empire", None), [(None, None, None)], ["new_edition", "new_epoch"]),
        ((None, None, None), [("2E", None, None)], []),
    ],
)
def test_preserve_reasons(spark, candidate, retained, expected):
    schema = "k int, edition string, epoch string, continuity string"
    rows = rec.preserve_reasons(spark.createDataFrame([(1, *candidate)], schema), spark.createDataFrame([(1, *r) for r in retained], schema), "k")
    assert rows.first().reasons == expected


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, -2.5, True, None, "", 'a "quote" \\ / ~ é', "x, ] } {[" * rng.randrange(5), "long " * rng.choice([1, 80])])
    if rng.random() < 0.5:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(9))]
    return {rng.choice(["a/b", "m~n", "é", 'q"', "key"]) + str(i): nested(rng, depth - 1) for i in range(rng.randrange(9))}


def at_path(value, path):
    for step in path.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("target", [1, 60, 1600])
def test_card_blocks_are_the_card(seed, target):
    rng = random.Random(seed)
    card = [nested(rng, 4) for _ in range(8)]
    text = rng.choice(["", " \n"]) + json.dumps(card, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])
    found = json_paths.card_blocks(text, target)
    assert "".join(text[a:b] for _, a, b, _ in found) == text and all(a == b for (_, _, a, _), (_, b, _, _) in zip(found, found[1:], strict=False))
    for path, a, b, n in found:
        value = at_path(card, path)
        assert n == 1 or b - a <= target
        own = json.dumps(value, ensure_ascii=False) if not isinstance(value, (dict, list)) else None
        if own is not None:  # a scalar is whole in its block
            assert own in text[a:b] or json.dumps(value) in text[a:b]
    assert len({path for path, *_ in found}) == len(found)


def test_a_card_of_a_megabyte():
    card = {"rows": [{"id": i, "name": "n" * (i % 50), "stats": {"hull": f"{i % 9}D", "move": i % 20}} for i in range(16_000)], "end": []}
    text = json.dumps(card)
    assert len(text) > 1_000_000
    found = json_paths.card_blocks(text, 1600)
    assert "".join(text[a:b] for _, a, b, _ in found) == text and max(b - a for _, a, b, _ in found) <= 1600 and len(found) < 1000
    assert all(at_path(card, path)["id"] == int(path.split("/")[2]) for path, *_ in found if path.startswith("/rows/"))
    assert json_paths.card_blocks(text[:-1], 1600) is None and json_paths.card_blocks("[" * 100_000, 10) is None


def test_blocks_of_cards_and_other_texts(spark):
    from tomeforge.functions.text import paragraph_rows
    from tomeforge.operators.blocks import coherent_blocks

    long = '{"a": [' + ", ".join(["1000"] * 50) + '], "b": "x"}'
    rows = [(1, long), (2, '{"a": 1}'), (3, long[:-1] + ",}"), (4, "# Head\n\nMove\n\n10\n\nA sentence here."), (5, None), (6, "")]
    got = {}
    for r in coherent_blocks(spark.createDataFrame(rows, "id int, text string"), "id", "text", paragraph_rows, 100).orderBy("id", "block").collect():
        got.setdefault(r.id, []).append(r)
    assert {k: "".join(r.body for r in v) for k, v in got.items()} == {k: t for k, t in rows if t}
    assert [r.path for r in got[1]] == ["/a/0", "/a/15", "/a/31", "/a/47", "/b"] and [r.path for r in got[2]] == [None]
    assert {r.path for r in got[3] + got[4]} == {None}
