"""Near duplicates, lines, benchmark passages and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomeforge.llm import components, decontaminate, line_dedup, near_duplicates

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOW))


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    sets = Sets()
    for a, b in links:
        sets.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = []
    for x in tokens(text):
        size = len(x.encode())
        w += list(x) if size > near_duplicates.LONG and 2 * sum(len(c.encode()) for c in x if ord(c) > 127) > size else [x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_classes(rows):
    sets, held = Sets(), {d: shingles(t) for d, t in rows}
    for a, x in held.items():
        for b, y in held.items():
            if a < b and x and y and len(x & y) >= 0.8 * len(x | y):
                sets.join(a, b)
    return {d: sets.find(d) for d in held}


def test_near_duplicates(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 150]))]
        for copy in range(rng.choice([1, 2, 3, 25])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((base * 100 + copy, " ".join(own)))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)


def test_long_runs_without_blanks(spark):
    rng = random.Random(8)
    letters = "".join(rng.choice("abcdefgh") for _ in range(8192))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(800))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(800))
    rows = [(1, letters), (2, letters[4096:] + letters[:4096]), (3, han), (4, han[:400] + "字" + han[400:]), (5, other), (6, "new words here: " + other)]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda x: " ".join(["other", *x[1:]])
    rows = [(2, " ".join(a)), (2, " ".join(b)), (3, near(b)), (4, near(a)), (5, " ".join(c)), (1, " ".join(b)), (6, near(c)), (6, near(c)), (None, " ".join(c))]
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.copy_of) for r in got) == [(0, 5, 5), (1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 5, 5), (6, 5, 6), (6, 5, 6)]
    assert sorted(r.doc_id or 0 for r in near_duplicates.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1, 5]


def test_one_row_stays_of_each_class(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text + " more"), (2, text), (1, "something else"), (3, "alone here"), (3, "alone here"), (None, "x"), (None, "x"), (None, "y")]
    kept = near_duplicates.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "x"), (0, "y"), (1, "something else"), (3, "alone here")]


def test_op3_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = near_duplicates.op3_near_duplicates(spark, sf).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == near_classes(rows)
    words = {d: tuple(tokens(t)) for d, t in rows}
    assert all(r.copy_of == (min(d for d, w in words.items() if w == words[r.doc_id]) if words[r.doc_id] else r.doc_id) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.class_id) for r in near_duplicates.classes(odd).collect()]
    assert len(got) == odd.count() and dict(got)[8] == 7 and dict(got)[7] == 7 and {(1, 1), (2, 2), (3, 3)} <= set(got) and (None, None) in got
    kept = near_duplicates.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert near_duplicates.classes(none).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    universe = near_duplicates.mix(np.arange(1, 400, dtype=np.uint64))
    a, b = {int(x): float(w) for x, w in zip(universe[:300], rng.uniform(1, 3, 300), strict=True)}, {}
    for x, w in a.items():
        b[x] = w
    for x in list(b)[:40]:
        del b[x]
    for x in universe[300:340]:
        b[int(x)] = 2.0
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in a if x in b)
    owner = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    held = near_duplicates.registers(2, owner, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 4000)
    assert abs((held[0] == held[1]).mean() - exact) < 0.03


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(1500):
        a = [rng.choice("abé") for _ in range(rng.randint(4, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in rows.select("a", "b", line_dedup.banded_distance(F.split("a", ""), F.split("b", ""), threshold).alias("d")).collect():
        assert r.d == min(distance(r.a, r.b), threshold + 1), r


def kept_lines(rows, least=line_dedup.MIN_CHARS):
    sets, at = Sets(), {}
    lines = [(x.strip(" \t\r"), d, n) for d, t in rows if t is not None and d is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[0]) >= least]
    distinct = sorted({x for x, _, _ in lines if len(x) >= line_dedup.MIN_CHARS})
    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1:
                sets.join(x, y)
    for x, d, n in lines:
        at[sets.find(x)] = min(at.get(sets.find(x), (d, n)), (d, n))
    same = lambda d, n, x: len(x.strip(" \t\r")) < least or at[sets.find(x.strip(" \t\r"))] == (d, n)
    return {d: t if t is None or d is None else "\n".join(x for n, x in enumerate(t.split("\n")) if same(d, n, x)) for d, t in rows}


@pytest.mark.parametrize("small,block", [(32, 64), (1, 64), (1, 5)])
def test_lines(spark, monkeypatch, small, block):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(34)).strip() + "xxxx" for _ in range(8)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(line))
                line[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
            text.append("".join(line))
        rows.append((d, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "short\n\nshort")] + [(200 + i, f"page number {i} of the whole document that repeats") for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_lines(rows)


def test_short_lines_are_compared_for_equality(spark):
    rows = [(1, "Les.\n\n And ornd. \nLes.\nx"), (2, "And ornd.\n\nLed.\nx\ny"), (3, "Les.")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.ALL_LINES).collect()}
    assert got == {1: "Les.\n\n And ornd. \nx", 2: "\nLed.\ny", 3: ""}


def test_lines_of_repeated_ids(spark):
    x, y = "a line that is long enough to be compared " * 2, "some other line, also long enough to be compared"
    rows = [(1, x), (2, y), (2, x), (3, f"{x}\n{y}"), (3, f"{x}\n{y}\nz"), (-4, "w"), (5, "w\nw")]
    got = sorted(tuple(r) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.ALL_LINES).select("doc_id", "text").collect())
    assert got == sorted([(1, x), (2, y), (2, ""), (3, ""), (3, "z"), (-4, "w"), (5, "")])


def test_many_lines_in_a_text(spark):
    text = "\n".join(f"line {i % 150_000}" for i in range(200_000))
    (r,) = line_dedup.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string"), line_dedup.ALL_LINES).collect()
    assert r.n_lines == 200_000 and r.text == "\n".join(f"line {i}" for i in range(150_000))


def test_op9_leaves_no_repeated_line(spark):
    left = [x.strip(" \t\r") for r in line_dedup.op9_line_dedup(spark, "/root/testdata/sf0.001").collect() for x in (r.text or "").split("\n")]
    left = [x for x in left if x]
    assert len(left) == len(set(left))


def test_lines_of_odd_rows(spark, odd, none):
    got = line_dedup.deduplicated(odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[8] == "" and texts[7].startswith("The same") and texts[None].startswith("A row")
    assert line_dedup.deduplicated(none).count() == 0


def test_no_python_in_line_dedup(spark):
    plan = line_dedup.near_lines(spark.createDataFrame([(1, "a line that is long enough to be compared")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def hits(text, items):
    w = tokens(text)
    hit, found = set(), set()
    for i, item in items:
        b = tokens(item)
        n = min(10, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("block", "most"), [(1_000_000, 4_000_000), (5, 4_000_000), (5, 0)])
def test_decontamination(spark, odd, none, block, most):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 14])))) for i in range(12)] + [(50, None), (51, ""), (3, "again the same id with other words"), (None, "no id here at all"), (0, "A, b.")]
    rows = [(i, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 20))), rng.choice(items)[1] or "", "tail!"])) for i in range(60)]
    documents, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(documents, benchmark, ["doc_id", "text"], clean=True, block_windows=block, most_windows=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == hits(r.text, items)
        assert len(tokens(r.clean_text)) == r.n_words - r.n_hit
    assert decontaminate.scan(odd.select("doc_id", "text"), benchmark, ["doc_id"], block_windows=block, most_windows=most).count() == odd.count()
    assert decontaminate.scan(odd, benchmark, odd.columns, names={"n_words": "words_", "n_hit": "hit_", "items": "items_"}, most_windows=most).columns == [*odd.columns, "words_", "hit_", "items_"]
    assert decontaminate.scan(none, benchmark, ["doc_id"], most_windows=most).count() == 0
    assert decontaminate.scan(documents, benchmark.limit(0), ["doc_id"], most_windows=most).where("n_hit > 0").count() == 0
