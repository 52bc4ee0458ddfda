"""Hand-made cases and brute force for the ordered operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.functions import labels as L
from screenloom.functions import markup as M
from screenloom.functions import urls as U
from screenloom.functions.text import own_text, truncate
from screenloom.operators import dedupe, filters, hierarchy, metrics, model_io, suppression, validate
from screenloom.sources import readers

BOX = "screen int, seq long, x int, y int, w int, h int"


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter) if inter else 0.0


def random_boxes(n, seed, screens=3, span=300):
    r = random.Random(seed)
    return [(r.randrange(screens), i, r.randrange(span), r.randrange(span), r.randrange(2, 120), r.randrange(2, 120)) for i in range(n)]


def test_overlapping_is_every_pair_once(spark):
    data = random_boxes(120, 1) + [(0, 900 + i, 250, 250, 20, 20) for i in range(3)] + [(0, 950, 10, 10, 0, 5)]
    df = spark.createDataFrame(data, BOX)
    got = [(r.a_seq, r.b_seq) for r in metrics.overlapping(df, df, ["screen"], cell=64).collect()]
    want = {(a[1], b[1]) for a in data for b in data if a[0] == b[0] and iou(a[2:], b[2:]) > 0}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("url,want", [
    ("https://a.b/c?utm_source=x&b=2&a=1#top", "https://a.b/c?a=1&b=2"), ("HTTP://A.b/c;p?q", "http://A.b/c;p?q="), ("https://a.b/?x=a+b&x=&UTM_c=1", "https://a.b/?x=&x=a+b"),
    ("https://a.b/é?k=é&z=~*", "https://a.b/é?k=%C3%A9&z=~%2A"), ("", ""), ("https://a.b", "https://a.b"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical(F.lit(url))) == want


def test_split_needs_ratios_of_one():
    with pytest.raises(ValueError):
        U.split_of(F.col("x"), 0.5, 0.2, 0.1)


@pytest.mark.parametrize("text,children,want", [
    ("", [("a", "b")], ""), ("Hello", [], "Hello"), ("A B", [("A", "p"), ("B", "p")], ""), ("see the manual for more of it", [("manual", "a")], "see the manual for more of it"),
    ("see manual", [("manual", "a")], "see"), ("Price: 5", [("price: 5", "b")], ""), ("x y x", [("x", "b")], "y x"), ("a.b (c)", [("(c)", "i")], "a.b"), ("go !", [("go", "b")], ""), ("one", [(None, "b"), (" ", "i")], "one"),
])
def test_own_text(text, children, want):
    assert own_text(text, children) == want


def test_truncate(spark):
    assert one(spark, truncate(F.lit("a" * 30 + "b" * 30))) == "a" * 20 + "..." + "b" * 15
    assert one(spark, truncate(F.lit("a" * 50))) == "a" * 50


def test_markup_round_trip():
    rows = [dict(idx=0, parent=None, y=0, x=0, head="<loc_0><loc_0><loc_500><loc_500>", tag="Window", text="w"), dict(idx=1, parent=0, y=5, x=9, head="<loc_1><loc_2><loc_3><loc_4>", tag="Window", text=""), dict(idx=2, parent=0, y=5, x=1, head="<loc_1><loc_2><loc_3><loc_4>", tag="Link", text="l"), dict(idx=3, parent=4, y=0, x=0, head="", tag="c", text=""), dict(idx=4, parent=3, y=0, x=0, head="", tag="c", text="")]
    m = M.write(rows)
    nodes = M.read(m)
    assert [(n["tag"], n["depth"], n["parent_id"], n["text"]) for n in nodes] == [("Window", 0, None, "w"), ("Link", 1, 0, "l"), ("Window", 1, 0, "")]
    assert [(n["tag"], n["l"]) for n in M.read_strict(m, 1000, 500)] == [("Window", 0), ("Link", 2), ("Window", 2)]
    assert M.tree_text(nodes).split("\n")[1:] == ['└── Window [0,0,500,500] "w"', '    ├── Link [1,2,3,4] "l"', "    └── Window [1,2,3,4]"]
    assert M.write([]) == "<screentag></screentag>" and M.read("") == [] and M.read(None) == []


def test_markup_tolerance():
    nodes = M.read("junk<a>x<b>y</a>z</b>w</a>tail<c")
    assert [(n["tag"], n["text"], n["depth"]) for n in nodes] == [("a", "xw", 0), ("b", "y</a>z", 1)]
    assert [n["text"] for n in M.read("<p><loc_1><loc_2>hi")] == ["hi"]


def naive_suppress(rows, thr):
    order = sorted(range(len(rows)), key=lambda i: -rows[i]["w"] * rows[i]["h"])
    kept = []
    for i in order:
        box = lambda r: (r["x"], r["y"], r["w"], r["h"])
        verdict = "keep"
        for j in kept:
            v = iou(box(rows[i]), box(rows[j]))
            if v > thr:
                verdict = ("swap", j) if rows[i]["protected"] and not rows[j]["protected"] else "drop"
                break
            if rows[i]["klass"] == rows[j]["klass"] and v > 0.65 * thr:
                verdict = "drop"
                break
        if verdict == "drop":
            continue
        if verdict != "keep":
            kept.remove(verdict[1])
        kept.append(i)
    return kept


def test_suppression_order():
    r = random.Random(3)
    for _ in range(20):
        rows = [dict(seq=i, x=r.randrange(6), y=r.randrange(6), w=r.randrange(20, 24), h=r.randrange(20, 24), protected=r.random() < 0.5, klass=r.choice("ab")) for i in range(25)]
        assert filters.suppressed(rows, 0.8) == naive_suppress(rows, 0.8)


def test_clean_and_fuse(spark):
    data = [(1, 0, 7, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 7, 1.0, 0.0, 11.0, 10.0, 0.9), (1, 2, 7, 50.0, 50.0, 60.0, 60.0, 0.2), (1, 3, 8, 0.0, 0.0, 10.0, 10.0, 0.4)]
    df = spark.createDataFrame(data, "screen int, seq long, cls int, x1 double, y1 double, x2 double, y2 double, score double").withColumns({"container": F.lit(False), "non_nestable": F.lit(True)})
    assert {r.seq for r in suppression.clean_boxes(df, ["screen"]).collect()} == {0, 2, 3}
    fused = {(r.cls, r.cluster): r for r in suppression.fuse(df, ["screen"]).collect()}
    assert fused[7, 0].n == 2 and fused[7, 0].score == 0.9 and abs(fused[7, 0].x1 - 0.9 / 1.400001) < 1e-9 and fused[8, 0].x2 == 10.0


def test_parents_ties_and_cycles(spark):
    data = [(0, 0, 0, 0, 100, 100), (0, 1, 0, 0, 100, 100), (0, 2, 10, 10, 20, 20), (0, 3, 3, 0, 100, 100), (0, 4, 5, 5, 0, 9)]
    df = spark.createDataFrame(data, BOX).withColumn("klass", F.lit(None).cast("string"))
    got = {r.seq: r.parent for r in hierarchy.parents(df, ["screen"]).collect()}
    assert got == {0: 3, 1: 3, 2: 0, 3: 0, 4: None}
    strict = {r.seq: r.parent for r in hierarchy.parents(df, ["screen"], strict=True).collect()}
    assert strict == {0: None, 1: None, 2: 0, 3: 0, 4: None}
    depth = {r.seq: r.depth for r in hierarchy.depths(hierarchy.parents(df, ["screen"]), ["screen"]).collect()}
    assert depth == {0: 2, 1: 3, 2: 3, 3: 2, 4: 0}


def test_radius_join_and_groups(spark):
    r = random.Random(5)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(30)]
    for h in list(hashes):
        for k in (3, 8, 9):
            x = h
            for b in r.sample(range(64), k):
                x ^= (1 << b) - (1 << 64) if b == 63 else 1 << b
            hashes.append(x)
    hashes += hashes[:5]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    d = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(set(hashes), 2) if d(a, b) <= 8}
    assert {(x.hash_a, x.hash_b) for x in dedupe.within_radius(df, "id").collect()} == want
    group = {i: i for i in range(len(hashes))}
    for _ in range(10):
        for i, j in itertools.combinations(range(len(hashes)), 2):
            if d(hashes[i], hashes[j]) <= 8:
                group[i] = group[j] = min(group[i], group[j])
    sizes = {g: sum(v == g for v in group.values()) for g in group.values()}
    assert {(x.id, x.group_id) for x in dedupe.duplicate_groups(df, "id").collect()} == {(i, g) for i, g in group.items() if sizes[g] > 1}


@pytest.mark.parametrize("radius,block,held", [(8, 64, 256), (4, 64, 256), (63, 1 << 16, 1 << 20)])
def test_radius_join_by_index_and_blocks(spark, monkeypatch, radius, block, held):
    """Small limits make buckets be dealt out as blocks and looked up by index; each pair comes once."""
    monkeypatch.setattr(dedupe, "BLOCK", block)
    monkeypatch.setattr(dedupe, "HELD", held)
    r = random.Random(3)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    for h in list(hashes):
        for k in range(0, 14, 2):
            x = h & (1 << 64) - 1
            for b in r.sample(range(64), k):
                x ^= 1 << b
            hashes.append(x - (1 << 64) if x >> 63 else x)
    got = [tuple(x) for x in dedupe.within_radius(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long"), "id", radius=radius).collect()]
    all_ = np.unique(np.array(hashes, np.int64))
    v = np.bitwise_count((all_[:, None] ^ all_[None, :]).view(np.uint64))  # of a negative number it counts the absolute value's
    i, j = np.nonzero(np.triu(v <= radius, 1))
    assert len(got) == len(set(got)) and set(got) == set(zip(all_[i].tolist(), all_[j].tolist(), v[i, j].tolist(), strict=True))


def test_radius_join_compares_few_pairs(monkeypatch):
    """A look-up compares a small share of a bucket's pairs, and holds some of them at a time."""
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64))
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (seen.append(x.size), count(x))[1])
    mask = sum(1 << i for i in range(14))
    got = {tuple(sorted(p)) for x, y in dedupe._near(h, h, list(range(14)), 2, 18) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert sum(seen) < len(h) ** 2 / 200 and max(seen) <= dedupe.HELD
    v = h[:300, None] ^ h[None, :]
    i, j = np.nonzero((count(v) <= 18) & (count(v & np.uint64(mask)) <= 2) & (v > 0))
    assert {tuple(sorted((int(h[a]), int(h[b])))) for a, b in zip(i, j, strict=True)} == {p for p in got if p[0] in set(h[:300].tolist()) or p[1] in set(h[:300].tolist())}


def test_long_chain_is_one_component(spark):
    got = dedupe.connected(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "a", "b")
    assert {r.component for r in got.collect()} == {0} and got.count() == 61


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n in range(1, 7):
        c = r.integers(0, 5, (n, n)) / 4
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(c[np.arange(n), metrics.assignment(c)].sum() - best) < 1e-9


def test_grid_equals_bitmap(spark):
    gt, pr = [spark.createDataFrame([(s, i, x, y, w, h, str(i % 3)) for s, i, x, y, w, h in random_boxes(20, k, 2, 90)], BOX + ", label string") for k in (1, 2)]
    got = {r.screen: r for r in metrics.page_cells(gt, pr, ["screen"], 100, 80).collect()}
    lab = {r.screen: r for r in metrics.label_cells(gt, pr, ["screen"], 100, 80).collect()}
    for s in (0, 1):
        maps, names = [], []
        for df in (gt, pr):
            m, n, area = np.zeros((80, 100), bool), np.full((80, 100), -1), np.full((80, 100), np.inf)
            for r in sorted((r for r in df.collect() if r.screen == s), key=lambda r: r.seq):
                x2, y2 = min(100, r.x + r.w), min(80, r.y + r.h)
                m[r.y : y2, r.x : x2] = True
                a = max(0, x2 - r.x) * max(0, y2 - r.y)
                part = area[r.y : y2, r.x : x2]
                n[r.y : y2, r.x : x2][a < part] = int(r.label)
                part[a < part] = a
            maps.append(m)
            names.append(n)
        assert (got[s].inter, got[s].n_gt, got[s].n_union) == ((maps[0] & maps[1]).sum(), maps[0].sum(), (maps[0] | maps[1]).sum())
        assert lab[s].match == ((names[0] == names[1]) & (names[0] >= 0)).sum()


def test_matching_ties_and_nulls(spark):
    gt = spark.createDataFrame([(0, 0, 0, 0, 10, 10, "A"), (0, 1, 0, 0, 10, 10, "A"), (0, 2, 50, 50, 10, 10, "B")], BOX + ", label string")
    pr = spark.createDataFrame([(0, 0, 0, 0, 10, 10, "A", 0.5), (0, 1, 0, 0, 10, 10, "A", None), (0, 2, 0, 0, 10, 10, "A", 0.9), (0, 3, 50, 50, 10, 10, "C", 0.9)], BOX + ", label string, score double")
    got = {r.seq: r.tp for r in metrics.matches(gt, pr, ["screen"]).collect()}
    assert got == {1: True, 2: True, 0: False, 3: False}
    r = metrics.recall(gt, pr, ["screen"], by_label=False).first()
    assert (r.tp, r.n_gt) == (3, 3)
    ap = metrics.average_precision(metrics.matches(gt, pr, ["screen"]), gt.groupBy("label").agg(F.count("*").alias("n_gt")), ["label"], ["screen", "seq"])
    assert {(r.label, r.n_gt, round(r.ap, 3)) for r in ap.collect()} == {("A", 2, 1.0), ("B", 1, 0.0), ("C", 0, 1.0)}


def test_own_text_makes_no_patterns_of_plain_texts(monkeypatch):
    """A pattern for each text costs most of the time."""
    monkeypatch.setattr("screenloom.functions.text.re.search", lambda *a: 1 / 0)
    monkeypatch.setattr("screenloom.functions.text.re.sub", lambda *a, **k: 1 / 0)
    assert own_text("Pay  NOW or later", [("now", "p"), ("gone", "p")]) == "Pay or later"
    assert own_text("a  B", [("A", "p"), ("b", "p")]) == ""


def test_groups_that_lie_by_key_are_not_dealt_out_again(spark):
    from pyspark.sql import Window

    from screenloom.operators.grouped import per_group

    df = spark.range(1000, numPartitions=3).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("j"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    ranked = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    got = per_group(ranked, ["k", "j"], ["n"], lambda rows: [{"m": len(rows), "nulls": sum(r["v"] is None for r in rows), "sorted": [r["n"] for r in rows] == sorted(r["n"] for r in rows)}], "m bigint, nulls bigint, sorted boolean")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = {(k, j): [i for i in range(1000) if i % 7 == k and i % 3 == j] for k in range(7) for j in range(3)}
    assert {(r.k, r.j): (r.m, r.nulls, r.sorted) for r in got.collect()} == {kj: (len(v), sum(i % 5 == 0 for i in v), True) for kj, v in want.items()}


def test_matching_few_boxes_needs_no_arrays(monkeypatch):
    """Most groups have a few boxes, and an array for each prediction costs most of the time; results are the same."""
    r = random.Random(4)
    cases = [[dict(seq=i, g=r.random() < 0.5, x=float(r.randrange(30)), y=float(r.randrange(30)), w=float(r.randrange(40)), h=float(r.randrange(1, 40)), score=r.choice([None, 0.5, r.random()])) for i in range(r.randrange(1, 12))] for _ in range(200)]
    get = lambda: [[(p["seq"], bool(hit)) for p, hit in metrics.greedy(rows, 0.3)] for rows in cases]
    with monkeypatch.context() as m:
        m.setattr(metrics, "FEW", -1, raising=False)
        want = get()
    monkeypatch.setattr(metrics, "_ious", lambda *a: 1 / 0)
    assert get() == want and any(hit for rows in want for _, hit in rows)


def test_suppression_compares_rows_in_bands(monkeypatch):
    """A screen's boxes are compared some hundred at a time, not one; what stays is the same as one by one."""
    r = random.Random(6)
    calls, ious = [], filters._ious
    monkeypatch.setattr(filters, "_ious", lambda a, b: (calls.append(1), ious(a, b))[1])
    for n in (1, 40, 300):
        rows = [dict(seq=i, x=r.randrange(60), y=r.randrange(60), w=r.randrange(1, 50), h=r.randrange(1, 50), protected=r.random() < 0.4, klass=r.choice([None, "", "a", "A", "b"])) for i in range(n)]
        calls.clear()
        got = filters.suppressed(rows, 0.5)
        assert len(calls) <= 2
        box = lambda k: (rows[k]["x"], rows[k]["y"], rows[k]["w"], rows[k]["h"])
        kept = []
        for i in sorted(range(n), key=lambda k: -rows[k]["w"] * rows[k]["h"]):
            alike = lambda j: (rows[i]["klass"] or "").lower() == (rows[j]["klass"] or "").lower() != ""  # noqa: B023, E731
            hit = next((j for j in kept if (v := iou(box(i), box(j))) > 0.5 or alike(j) and v > 0.325), None)
            if hit is not None:
                if not (iou(box(i), box(hit)) > 0.5 and rows[i]["protected"] and not rows[hit]["protected"]):
                    continue
                kept.remove(hit)
            kept.append(i)
        assert got == kept


def test_clusters_of_few_and_many(monkeypatch):
    """Clusters are the same whether boxes are compared one by one, all at once or in rows; few need no arrays."""
    r = random.Random(8)
    boxes = [np.array([(x, y, x + r.choice([0, 9, 20]), y + r.choice([9, 20])) for x, y in ((r.randrange(20), r.randrange(20)) for _ in range(r.randrange(1, 8)))], float) for _ in range(150)]
    get = lambda: [[c.tolist() for c in suppression.clusters(b, 0.5, cover)] for b in boxes for cover in (None, 0.65)]
    with monkeypatch.context() as m:
        m.setattr(suppression, "_alike", lambda *a: 1 / 0, raising=True)
        few = get()
    monkeypatch.setattr(suppression, "FEW", 0)
    once = get()
    monkeypatch.setattr(suppression, "MATRIX", 0)
    assert few == once == get() and any(len(c) > 1 for x in few for c in x)


def test_parse_holds_some_nodes_at_a_time(spark, monkeypatch):
    """Nodes leave by and by, not a batch of markups at once, and all come."""
    import pandas as pd

    sizes, frame = [], pd.DataFrame
    rows = [[dict(idx=i, parent=None, x=0, y=i, head="<loc_1><loc_2><loc_3><loc_4>", tag="a", text="t") for i in range(30)] for _ in range(50)]
    df = pd.DataFrame({"k": range(50), "markup": [M.write(r) for r in rows]})

    class Frame:
        schema = spark.createDataFrame([(1, "")], "k long, markup string").schema

        def __getitem__(self, k):
            return self.schema[k]

        def select(self, *a):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            sizes.extend(len(x) for x in run([df]))
            return frame({"n": sizes})

    monkeypatch.setattr(hierarchy, "NODES_AT_ONCE", 100, raising=False)
    for strict in (False, True):
        sizes.clear()
        hierarchy.parse(Frame(), "k", strict=strict)
        assert sum(sizes) == 1500 and max(sizes) < 130


def test_own_texts_carry_columns(spark):
    """Markup of own texts computes its rows once, without a join with them."""
    df = spark.createDataFrame([(0, 0, None, "div", "a b", 5, None), (0, 1, 0, "p", "b", None, "x"), (1, 7, None, "p", " c ", 9, "y")], "screen int, seq long, parent long, tag string, inner_text string, w int, label string")
    got = hierarchy.own_texts(df, ["screen"], ("parent", "w", "label"))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("screen", "int"), ("seq", "bigint"), ("own_text", "string"), ("parent", "bigint"), ("w", "int"), ("label", "string")]
    assert sorted(map(tuple, got.collect())) == [(0, 0, "a", None, 5, None), (0, 1, "b", 0, None, "x"), (1, 7, "c", None, 9, "y")]


def test_average_precision_over_ranges(spark):
    """A label's predictions lie in several ranges; ties, nulls and a null label are ranked as one by one."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]) if i % 50 else "d", r.choice([None, 0.1, 0.5, 0.9]) if i % 3 else r.random(), i % 17, i, r.random() < 0.3) for i in range(900)]
    n_gt = {"a": 400, "b": 300, None: 200, "z": 5}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ap = metrics.average_precision(spark.createDataFrame(rows, "label string, score double, screen long, seq long, tp boolean"), spark.createDataFrame(list(n_gt.items()), "label string, n_gt long"), ["label"], ["screen", "seq"])
        got = {x.label: (x.n_gt, round(x.ap, 9)) for x in ap.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for label in (*n_gt, "d"):
        own = sorted((x for x in rows if x[0] == label), key=lambda x: (x[1] is None, -(x[1] or 0), x[2], x[3]))
        tps = np.cumsum([x[4] for x in own]) if own else np.zeros(0)
        env = np.maximum.accumulate((tps / np.arange(1, len(own) + 1))[::-1])[::-1]
        n = n_gt.get(label, 0)
        want[label] = (n, round(float(sum(v for v, x in zip(env, own, strict=True) if x[4])) / n, 9) if n else 1.0)
    assert got == want


def test_edit_distance_counts_missing_but_not_spare(spark):
    t = BOX + ", text string"
    gt = spark.createDataFrame([(0, 0, 0, 0, 9, 9, "Abc"), (0, 1, 0, 0, 9, 9, "xyz"), (1, 0, 0, 0, 9, 9, "q"), (2, 0, 0, 0, 9, 9, " ")], t)
    pr = spark.createDataFrame([(0, 0, 0, 0, 9, 9, "abd"), (1, 0, 0, 0, 9, 9, "q"), (1, 1, 0, 0, 9, 9, "spare"), (2, 0, 0, 0, 9, 9, "z")], t)
    got = {r.screen: (r.n_gt, r.n_pred, round(r.cost, 6)) for r in metrics.edit_distances(gt, pr, ["screen"]).collect()}
    assert got == {0: (2, 1, round(1 / 3 + 1, 6)), 1: (1, 2, 0.0)}


def test_answers():
    ok = 'sure [{"label":["","Button"],"bbox_ltrb":[0,0,500,1000],"score":"0.5","text":["a "," b"]},{"label":"x"},{"type":"t","bbox_xywh":[900,0,200,10]}]'
    a, b = model_io.read_elements(ok, 200, 100)
    assert (a["label"], a["text"], a["score"], a["w"], a["h"]) == ("Button", "a b", 0.5, 100.0, 100.0)
    assert (b["label"], b["x"], b["w"]) == ("t", 180.0, 20.0)
    for bad in ("", None, "none", "[1]", '[{"bbox":[1,2,3]}]', "[{"):
        assert model_io.read_elements(bad, 10, 10) == []
    assert model_io.balanced_object('```json\n{"a": {"b": 1}} {"c": 2}\n```') == {"a": {"b": 1}}
    assert model_io.balanced_object("[1]") is None and model_io.balanced_object('{"a": ') is None and model_io.balanced_object(None) is None


def test_failing_predictor_keeps_rows(spark):
    class Bad(model_io.Predictor):
        schema = "label string"

        def predict(self, batch):
            raise RuntimeError("no model")

    got = model_io.predicted(spark.range(3), ["id"], Bad()).collect()
    assert len(got) == 3 and all(r.label is None and "no model" in r.error for r in got)


@pytest.mark.parametrize("raw,want", [("-", "Table"), ("Progress-Bar", "Progress bar"), ("radio button", "Radiobox"), ("BUTTON", "Button"), (None, None), ("", None)])
def test_normalize_label(spark, raw, want):
    assert one(spark, L.normalize_label(F.lit(raw).cast("string"))) == want


def test_label_file_issues(spark):
    df = spark.createDataFrame([("train", "a", "0 .5 .5 .1 .1\r\n\n1 2 3 4\n54 0 1 1 1\n-1 .5 .5 .1 .1\n3 1.0001 .5 .1 .1\n3 a .5 .1 .1"), ("train", "b", "")], "split string, stem string, text string")
    assert [r.issue for r in validate.checked(df).orderBy("line_no").collect()] == ["none", "values", "none", "class", "box", "parse"]


def test_dom_walk():
    rows = readers.walk('<html><head><title>t</title></head><body><div hidden><p>x</p></div><ul><li>a<li>b</ul><img><br/></body>')
    by = [(r["tag"], r["depth"], r["visible"]) for r in rows]
    assert ("p", 3, False) in by and ("img", 2, True) in by and rows[0]["inner_text"].startswith("t")
    assert readers.walk(None) == [] and readers.walk("") == []


def test_filter_elements_on_edge_cases(spark):
    schema = BOX + ", parent long, tag string, role string, type string, attrs map<string,string>, aria_hidden string, inner_text string"
    rows = [
        (0, 0, 0, 0, 700, 500, None, "div", None, "text", {}, None, None), (0, 1, 0, 0, 300, 40, 0, "p", None, "text", {}, None, "a long enough text and more"),
        (0, 2, 0, 0, 300, 40, 1, "a", None, "link", {}, None, "more"), (0, 3, 10, 100, 1, 50, 0, "a", None, "link", {}, None, None), (0, 4, 2000, 0, 50, 50, 0, "p", None, "text", {}, None, None),
        (0, 5, 10, 300, 30, 30, 0, None, None, None, None, "TRUE", None), (0, 6, 10, 300, 10, 10, 0, "path", None, None, None, None, None), (0, 7, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.seq: r.parent for r in filters.filter_elements(spark.createDataFrame(rows, schema), ["screen"]).collect()}
    assert got == {1: None}  # 0 is a wrapper, 2 lies on 1, 3 is a pixel wide, 4 out of sight, 5 hidden, 6 a small path, 7 has no box
    assert filters.filter_elements(spark.createDataFrame([], schema), ["screen"]).count() == 0
