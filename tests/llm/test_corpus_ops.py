"""Near-duplicates, substring dedup, decontamination, LM scoring, quality rules and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from screenloom.llm import attention_lm, components, decontaminate, quality, queries, simhash, substrings


def words(n, seed, vocab=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w)] if 0 < len(w) < n else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_simhash(got, pairs):
    f = {k: fingerprint(t) for k, t in pairs}
    ids = sorted(f)
    want = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(f[a] ^ f[b]).count("1") <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{f[k]:016x}", want[k]) for k in ids}


def test_simhash_equals_all_pairs(spark, small):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_simhash(simhash.op3_simhash(spark, small).collect(), pairs)


def test_simhash_dense_groups(spark, docs_of):
    """Many fingerprints a bit or two apart, more than a bucket holds."""
    base = words(300, 1)
    pairs = []
    for i in range(150):
        w = list(base)
        w[random.Random(i).randrange(300)] = f"x{i}"
        pairs.append((i + 1, " ".join(w)))
    pairs += [(1000 + i, " ".join(words(60, 50 + i))) for i in range(40)] + [(2000, ""), (2001, None), (2002, "one"), (2003, "ONE"), (2004, " \n")]
    check_simhash(simhash.near_duplicates(docs_of(pairs)).collect(), pairs)


def test_simhash_edges(spark, docs_of, empty):
    got = simhash.near_duplicates(docs_of([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "q r s t u")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["7", "7", "7", "None"]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_keep_every_component(spark, radius):
    r = random.Random(radius)
    seen = set()
    while len(seen) < 400:
        h = r.getrandbits(64)
        seen.add(h)
        for _ in range(r.randrange(4)):
            for b in r.sample(range(64), r.randrange(1, 4)):
                h ^= 1 << b
            seen.add(h)
    ids = {i: h for i, h in enumerate(sorted(seen))}
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in ids.items()], "id long, f0 long")
    linked = [(x.a, x.b) for x in simhash.links(df, radius).collect()]
    assert all(bin(ids[a] ^ ids[b]).count("1") <= radius for a, b in linked)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and bin(ids[a] ^ ids[b]).count("1") <= radius])
    assert groups(ids, linked) == want


def test_plan_guarantees_the_radius(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(r.integers(-(2**63), 2**63, 500, dtype=np.int64))], "id long, f0 long")
    p = simhash.plan(df, 2)
    assert p.guarantees() >= 2 and sorted(b for part in p.parts for b in part) == list(range(64))
    assert simhash.allocate([32, 32], [[5.0, 9.0, 9.0]] * 2, 10, 9)[0] == math.inf  # two partitions of up to 2 can't promise 9


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (3, 1), (None, 4), (20, 21)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}


def test_near_dedup_keeps_one_of_each_group(spark, docs_of, empty):
    base, other = words(400, 9), words(400, 10)
    pairs = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(base[:390] + words(10, 11))), (4, " ".join(other)), (1, " ".join(base[:200] + other[200:])), (8, None), (7, ""), (None, "a b c"), (10, "a b c d e f")]
    got = {r.doc_id for r in simhash.keep_first(docs_of(pairs)).collect()}
    assert got == {3, 4, 1, 8, 7, None, 10}
    assert simhash.keep_first(empty).count() == 0


def similar_links(docs, n=5, least=0.8):
    """Pairs of texts at a Jaccard similarity of ``least`` or more, by an inverted index of their shingles."""
    sh, by = {}, {}
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sh[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        for x in sh[k]:
            by.setdefault(x, []).append(k)
    out = set()
    for k, own in sh.items():
        common = Counter(j for x in own for j in by[x] if j > k)
        out |= {(k, j) for j, c in common.items() if c >= least * (len(own) + len(sh[j]) - c)}
    return out


def test_near_dedup_finds_all_links_of_the_table(spark):
    """Ids divisible by 20 of sf0.01, and all of its links, against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    linked = similar_links(texts)
    want = groups(texts, linked)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert all(got.get(k, k) == want[k] for k in texts if k % 20 == 0)
    held = sum(got[a] == got[b] for a, b in linked)
    assert held >= 0.98 * len(linked) and all(want[a] == want[c] for a, c in got.items())


def test_near_dedup_in_large_buckets(spark, docs_of, monkeypatch):
    """More members than a bucket's list or its leads hold, chains of edits among them, and strays around."""
    monkeypatch.setattr(simhash, "WIDE_BUCKET", 8)
    monkeypatch.setattr(simhash, "LEADS", 4)
    r = random.Random(3)
    base, pairs = words(300, 1), []
    for i in range(120):  # near copies
        w = list(base)
        for _ in range(3):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        pairs.append((i, " ".join(w)))
    w = list(base)
    for i in range(60):  # a chain, each a few words from the one before
        for _ in range(4):
            w[r.randrange(300)] = f"y{r.randrange(10**6)}"
        pairs.append((1000 + i, " ".join(w)))
    for i in range(30):  # near in bits, but not similar enough
        w = list(base)
        for k in range(0, 300, 24):
            w[k + r.randrange(5)] = f"z{r.randrange(10**6)}"
        pairs.append((2000 + i, " ".join(w)))
    pairs = [p for _, p in sorted((r.random(), p) for p in pairs)]
    texts = dict(pairs)
    want = groups(texts, similar_links(texts))
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs_of(pairs)).collect()}
    assert got == want and 1 < len(set(want.values())) < 60


def test_near_dedup_loses_no_link_at_the_threshold(spark, docs_of):
    """Pairs at a similarity of 0.806, where fingerprints differ by more bits than meet for sure."""
    pairs = []
    for i in range(400):
        w = words(200, 50 + i)
        pairs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:90] + words(17, 5000 + i, 10**6) + w[107:]))]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs_of(pairs)).collect()}
    assert got == {k: k // 2 * 2 for k, _ in pairs}


def test_near_dedup_verifies_all_pairs_and_stores_no_sets(spark):
    """Texts that are in many pairs, on either side; sets of shingles are as large as the texts and aren't written."""
    from screenloom.llm import _common

    base = words(120, 1)
    texts = {i: " ".join(base[: 120 - 2 * i] + words(2 * i, 70 + i)) for i in range(14)} | {20: None, 21: "a b", 22: "A  b"}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    before = list(_common._written)
    got = simhash.verified(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(pairs, "a long, b long"), 5, 0.8).collect()
    assert _common._written == before
    assert sorted(map(tuple, got)) == sorted(similar_links(texts)) and 10 < len(got) < len(pairs)


def test_near_dedup_verifies_many_pairs_in_parts(spark, docs_of, monkeypatch):
    """Pairs that are more than the bound are shared out, and none is left out."""
    monkeypatch.setattr(simhash, "PAIRS", 30)
    asked, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda texts, pairs, *a: asked.append(pairs.count()) or verified(texts, pairs, *a))
    pairs = [(100 * g + i, " ".join(words(100 - 2 * i, 7 + g) + words(2 * i, 900 + i + 50 * g))) for g in range(30) for i in range(3)]
    texts = dict(pairs)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs_of(pairs), rounds=1).collect()}
    assert got == groups(texts, similar_links(texts)) and len(asked) > 2 and max(asked) <= 45


def test_near_dedup_meets_by_rare_shingles(spark, docs_of):
    """A passage that very many unrelated texts begin with brings few of them together; order and sketches lose no pair."""
    head = words(40, 1)
    pairs = [(i, " ".join(head + words(60, 100 + i))) for i in range(600)] + [(1000 + i, " ".join(head + words(57, 100 + i) + ["a", "b", "c"])) for i in range(9)]
    texts = spark.createDataFrame(pairs, "id long, text string")
    for common in (simhash.commonness(texts, 5), np.zeros(8, np.int32)):
        met = simhash._meeting(simhash.prefixes(texts, common, 5, 0.8))
        assert common.any() <= (met.count() < 600)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs_of(pairs)).collect()}
    assert got == {k: k % 1000 if k < 1009 else k for k, _ in pairs}


def check_substrings(got, pairs, length=50):
    ws = {k: (t or "").encode().split() for k, t in pairs}
    first = {}
    for k in sorted(ws):
        for i in range(len(ws[k]) - length + 1):
            first.setdefault(tuple(ws[k][i : i + length]), k)
    for r in got:
        w = ws[r.doc_id]
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < r.doc_id for j in range(i, i + length)}
        left = [x for j, x in enumerate(w) if j not in gone]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()), r.doc_id
    assert len(got) == len(pairs)


def test_substrings_equal_sql(spark, small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(c.sql("SELECT doc_id, n_words, n_removed, kept_sha256 FROM (" + queries.SQL["op6_substrings"] + ")").fetchall())
    assert sorted(tuple(r) for r in substrings.op6_substrings(spark, small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want


def test_substrings_on_planted_passages(spark, docs_of):
    p, q = words(120, 1), words(50, 2)
    pairs = [(10, " ".join(words(30, 3) + p + words(20, 4))), (11, " ".join(p)), (12, " ".join(words(9, 5) + p[10:70] + words(9, 6) + q + p[:49])), (2, " ".join(q + q)), (13, " ".join(["same"] * 130)), (14, " ".join(["same"] * 60)), (15, None), (16, ""), (17, " ".join(p[:49])), (18, "\t".join(p) + "\n"), (1, " ".join(words(49, 7))), (19, "x" * 300_000)]
    out = substrings.drop_repeats(docs_of(pairs).withColumn("kept_text", F.lit("old")))
    check_substrings(out.select("doc_id", "n_words", "n_removed", substrings.words_sha256("kept_text").alias("kept_sha256")).collect(), pairs)


def test_substrings_many_sharing_documents(spark, docs_of):
    """A passage in very many documents, in runs of different lengths around it."""
    p = words(90, 8)
    pairs = [(i, " ".join(words(i % 7, i) + p[i % 11 : 60 + i % 30] + words(5, 99 + i))) for i in range(120)]
    out = substrings.drop_repeats(docs_of(pairs))
    check_substrings(out.select("doc_id", "n_words", "n_removed", substrings.words_sha256("kept_text").alias("kept_sha256")).collect(), pairs)


def test_substrings_edges(spark, docs_of, empty):
    p = " ".join(words(60, 1))
    got = substrings.drop_repeats(docs_of([(1, p), (1, p), (None, p), (2, p)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]
    assert substrings.drop_repeats(empty).count() == 0 and substrings.keep_new(empty).count() == 0
    assert {r.doc_id for r in substrings.keep_new(docs_of([(1, p), (2, p), (3, ""), (4, None)])).collect()} == {1, 3, 4}


@pytest.fixture(scope="module")
def planted(spark, docs_of):
    item = {0: words(40, 1, 10**6), 1: words(25, 2, 10**6), 2: words(60, 3, 10**6)}
    loose = [w for i, w in enumerate(item[2]) if i % 9 != 4]  # a paraphrase without a word in nine
    pairs = [(1, " ".join(words(200, 20) + item[0] + words(150, 21))), (2, " ".join(words(300, 22))), (3, " ".join(words(20, 23) + loose + words(20, 24))), (4, " ".join(item[1]).upper() + "."), (5, None), (6, ""), (7, " ".join(words(100, 25) + item[0][:8] + words(100, 26)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()] + [(3, None), (4, ""), (None, "a b c")], "item_id long, text string")
    return docs_of(pairs), bench


def test_decontamination_finds_planted_passages(planted):
    docs, bench = planted
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0), (3, 2), (4, 1)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {2, 5, 6, 7}


def test_decontamination_edges(planted, empty):
    docs, bench = planted
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, bench, most_bytes=10)


def test_decontamination_equals_exact_containment(spark, small):
    """Whole passages in a text are all found; what is found shares most words with its passage."""
    docs = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_decontaminate(spark, small).collect()}
    assert {(d, i) for d, t in docs.items() for i, p in items.items() if p in t} <= got
    assert all(len(set(items[i].split()) & set(docs[d].split())) > 0.5 * len(set(items[i].split())) for d, i in got)


@pytest.mark.parametrize("n", [10**4, 6 * 10**5, 6 * 10**6])
def test_decontamination_recall_holds_as_the_corpus_grows(n):
    """Passages of ordinary words, a quarter replaced by unseen ones, among unseen words."""
    items = [(i, " ".join(words(38, i)).encode()) for i in range(60)]
    vocabulary = decontaminate.Vocabulary({w for _, t in items for w in decontaminate.terms(t)})
    index = decontaminate.Index(items, n, np.full(len(vocabulary.ids), n // 20), vocabulary)
    whole = np.zeros((60, decontaminate.DIMS))
    for row, (_, t) in zip(whole, items, strict=True):
        np.add.at(row, *decontaminate.weigh(decontaminate.terms(t), index.idf_of)[:2])
    index.project(np.linalg.svd(whole, full_matrices=False)[2].T.astype(np.float32))
    for i, t in items:
        changed = [w if k % 4 else b"new%d" % k for k, w in enumerate(t.split())]
        text = b" ".join([b"before%d" % k for k in range(100)] + changed + [b"after%d" % k for k in range(100)])
        assert i in {x[0] for x in index.search(text, 0.35, 0.6, 0.5)}


def test_decontamination_finds_copies_beyond_the_rank_and_the_window(spark, docs_of, monkeypatch):
    """More passages than a block and a pass hold, and passages of several windows; each stands in a text of its own."""
    monkeypatch.setattr(decontaminate, "BLOCKS", 4, raising=False)
    items = {i: words(38, 1000 + i) for i in range(200)} | {200: words(600, 7), 201: words(2000, 8)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = docs_of([(i, " ".join(words(100, 5000 + i) + w + words(100, 9000 + i))) for i, w in items.items()])
    got = [(r.doc_id, r.item_id, r.lcs_share) for r in decontaminate.contaminated(docs, bench, rank=16).collect()]
    assert sorted(got) == [(i, i, 1.0) for i in items]


def test_lcs_is_exact():
    r = random.Random(1)
    for _ in range(40):
        a, b = [np.array([r.randrange(5) for _ in range(r.randrange(1, 15))]) for _ in range(2)]
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert decontaminate.lcs(a, b) == d[-1, -1]


def test_lm_base_columns(spark, small):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    toks = {k: [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in t.split()] + ["end"] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    counts = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in attention_lm.op5_attention_lm(spark, small).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[k])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(toks[k]), sum(counts[w] > 0 for w in toks[k]), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_lm_edges(spark, docs_of, empty):
    got = attention_lm.score(docs_of([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "a b c " * 50), (4, "é \U0001f600")])).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 1), ("2", 1), ("2", 1), ("3", 151), ("4", 3), ("None", 3)]
    assert all(math.isfinite(r.score) for r in got) and attention_lm.score(empty).count() == 0


def lm_block(texts, subs):
    """A block of texts (lists of words' numbers), all in slice 1; ``subs``: each word's subwords."""
    none = attention_lm.packed(np.zeros(0, np.int32))
    return {"sizes": np.array(list(map(len, texts)), np.int32).tobytes(), "slices": np.ones(len(texts), np.int16).tobytes(), "subs": np.array([x for y in subs for x in y], np.int16).tobytes(), "sub_sizes": np.array(list(map(len, subs)), np.int32).tobytes()} | {f"at{r}": none for r in range(attention_lm.ROUNDS + 1)} | {"at1": attention_lm.packed(np.array([x for t in texts for x in t], np.int32))}


def test_lm_windows_are_causal_and_cover_each_target_once():
    block = attention_lm.Block(lm_block([[0, 1], [], [0]], [[5, 6], [7]]))
    flat, places, goal = block.targets()
    assert goal.tolist() == [0, 1, -1, -1, 0, -1]
    w = attention_lm.windows(flat, places)
    s = attention_lm.START
    assert w[:3].T.tolist() == [[s, s, s], [6, 5, s], [7, 6, 5], [s, s, s], [s, s, s], [6, 5, s]]


def test_lm_gradient():
    rng = np.random.default_rng(0)
    n = attention_lm.EXPERTS + 1
    w = {k: x.astype(np.float64) + 0.1 * rng.standard_normal(x.shape) for k, x in attention_lm.start_weights(rng.random((n - 1, attention_lm.VOCAB)) * 20, np.full(n, 1 / n)).items()}
    ids = rng.integers(0, attention_lm.SUBWORDS, (attention_lm.WINDOW, 6))
    ids[5:, 0] = attention_lm.START
    likely = rng.random((6, n))
    loss = lambda: -np.log((np.exp(attention_lm.forward(w, ids, attention_lm.pair_scores(w))[0]) * likely).sum(1)).sum()
    g = attention_lm.gradient(w, ids, likely, attention_lm.pair_scores(w))
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = w[k][at], 1e-4
        w[k][at] = old + eps
        up = loss()
        w[k][at] = old - eps
        down = loss()
        w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 * max(abs(g[k][at]), 1e-2), k


def test_lm_scores_equal_a_plain_loop():
    """Attention, experts and mixture, one target and one subword at a time."""
    rng = np.random.default_rng(4)
    m, s = attention_lm, attention_lm.START
    experts = m.Experts(rng.integers(0, 3, (m.EXPERTS, m.VOCAB, m.VOCAB)).ravel().astype(float))
    w = m.start_weights(experts.use, rng.dirichlet(np.ones(m.EXPERTS + 1)))
    w = {k: (x + 0.2 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in w.items()}
    subs = [rng.integers(0, m.SUBWORDS, n).tolist() for n in (1, 3, 2, 1, 5)]
    texts = [[0, 1, 2, 2, 4, 3, 1, 0, 4], [], [3], [1, 1, 4]]
    b = m.Block(lm_block(texts, subs))
    logs, unseen = experts.word_logs(b, np.arange(5))
    got = m.target_scores(w, *b.targets(), unseen, some=5)

    def spell(k, word):
        if len(word) == 1:
            return math.log(m.SHORT) + experts.logs[k, m.END, word[0]]
        return math.log(1 - m.SHORT) + sum(float(experts.logs[k, x, y]) for x, y in zip([s, *word], [*word, m.END], strict=True))

    assert np.allclose(unseen, [[spell(k, x) for x in subs] for k in range(m.EXPERTS)])
    assert np.allclose(np.exp(experts.logs).sum(2), 1, atol=1e-4)
    w = {k: x.astype(float) for k, x in w.items()}
    want = []
    for text in texts:
        past = []
        for word in [*text, None]:
            near = (past[::-1] + [s] * m.WINDOW)[: m.WINDOW]
            x = w["e"][near[0]]
            q = x @ w["q"] * m.DIM**-0.5 + w["b"][0]
            score = [(w["e"][i] @ w["k"] + w["pos"][at] @ w["k"]) @ q if at == 0 or i != s else -math.inf for at, i in enumerate(near)]
            a = np.exp(np.array(score) - max(score))
            a /= a.sum()
            c = sum(p * (w["e"][i] @ w["v"]) for p, i in zip(a, near, strict=True)) * sum(i != s for i in near) / m.WINDOW
            z = np.maximum(x @ w["w1"] + c @ w["w2"], 0) @ w["o"] + c @ w["g"] + w["ob"][0]
            p = np.exp(z) / np.exp(z).sum()
            want.append(math.log(p[-1] if word is None else sum(p[k] * math.exp(spell(k, subs[word])) for k in range(m.EXPERTS))))
            past += [] if word is None else subs[word]
    assert np.allclose(got, want, atol=1e-3)


def test_lm_scores_texts_in_parts_of_a_block():
    """The same as over the whole block, at a part of its memory; texts without words, and longer than a part."""
    import tracemalloc

    rng = np.random.default_rng(6)
    m = attention_lm
    experts = m.Experts(rng.integers(0, 3, (m.EXPERTS, m.VOCAB, m.VOCAB)).ravel().astype(float))
    w = m.start_weights(experts.use, rng.dirichlet(np.ones(m.EXPERTS + 1)))
    subs = [rng.integers(0, m.SUBWORDS, 1 + i % 4).tolist() for i in range(300)]
    texts = [rng.integers(0, 300, n) for n in (0, 700, 0, 30_000, *[500] * 1200, 0)]
    b, c, tokens = m.Block(lm_block(texts, subs)), rng.integers(0, 3, 300), np.full(m.EXPERTS, 9.0)
    assert [x for lo, hi, _ in b.parts(10_000) for x in range(lo, hi)] == list(range(len(texts)))

    def held(f):
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    per_word = m.word_scores(experts, b, c, tokens, 0.01)
    each, whole = held(lambda: m.target_scores(w, *b.targets(), per_word))
    (base, known, own), parts = held(lambda: m.text_scores(w, b, c, per_word, most=10_000))
    of = np.repeat(np.arange(len(texts)), b.sizes + 1)
    assert np.allclose(own, np.bincount(of, weights=each, minlength=len(texts)), rtol=1e-5)
    assert np.allclose(base, [np.log10(c[t] + 0.5).sum() for t in texts]) and known.tolist() == [(c[t] > 0).sum() for t in texts]
    assert parts < 0.5 * whole


def test_lm_scores_do_not_depend_on_partitions(spark, docs_of):
    r = random.Random(5)
    docs = docs_of([(i, " ".join(f"{r.choice('abcd')}{r.choice('xyz') if i % 2 else r.choice('uvw')}{r.randrange(30)}" for _ in range(80))) for i in range(120)])
    a, b = ({x.doc_id: x.score for x in attention_lm.score(docs.repartition(n, "doc_id"), block_bytes=size).collect()} for n, size in ((1, 1 << 20), (5, 4000)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * abs(a[k]) for k in a)


def test_lm_refuses_keys_that_are_no_integers(docs_of):
    with pytest.raises(TypeError):
        attention_lm.score(docs_of([(1, "a b")]).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_lm_beats_the_base_on_held_out_texts(spark, docs_of):
    """Two languages without a common word: context tells which one comes next."""
    r = random.Random(3)
    vocab = [[f"{a}{b}" for a in "ka ri mo tu se".split() for b in "na lo pe".split()], [f"{a}{b}" for a in "gx zw qy jh vv".split() for b in "bb dd ff".split()]]
    docs = docs_of([(i, " ".join(r.choice(vocab[i % 2]) for _ in range(150))) for i in range(200)])
    got = [x for x in attention_lm.score(docs).collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.15 * sum(x.n_tokens for x in got)


def test_lm_corpus_counts_move_as_arrays(spark, small):
    """Counts of all blocks are those of a plain count, and no step of the query makes a row of each word."""
    r = random.Random(5)
    rows = [(b, sorted(r.sample(range(-40, 40), r.randrange(0, 40)))) for b in range(30)]
    rows = [(b, h, [r.randrange(0, 2) for _ in h]) for b, h in rows]
    want = Counter()
    for _, h, n in rows:
        want.update(dict(zip(h, n, strict=True)))
    of = {b: h for b, h, _ in rows}
    got = attention_lm.corpus_counts(spark.createDataFrame(rows, "block long, words array<long>, counts array<int>"), 4).collect()
    seen = [(x.block, of[x.block][i], int(c)) for x in got for i, c in zip(np.frombuffer(x.i, np.int32), np.frombuffer(x.c, np.int64), strict=True)]
    assert sorted(seen) == sorted((b, h, want[h]) for b in of for h in of[b])
    assert [sum(x[k] for x in got) for k in ("n_tokens", "n_words", "n_once")] == [sum(want.values()), sum(n > 0 for n in want.values()), sum(n == 1 for n in want.values())]
    assert "Generate" not in attention_lm.op5_attention_lm(spark, small)._jdf.queryExecution().toString()


def brute_quality(text):
    b = (text or "").encode()
    w = b.split()
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), chars, sum(c in b"#*$%&|<>" for c in b), dup, len(hit), failed


def test_quality_counts(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in quality.op10_quality(spark, small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(docs[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark, docs_of, empty):
    cases = [(1, None), (2, ""), (3, "a\u00a0b " * 30), (4, "x\ny\nx\n \n \nx"), (5, " ".join(["r"] * 40)), (5, "q" * 200_000), (None, "é " * 25)]
    got = sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs_of(cases)).collect()))
    assert got == sorted((str(k), *brute_quality(t)) for k, t in cases)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    own = docs_of([(1, "one two three " * 3), (2, " ".join(words(60, 1)))]).withColumns({c: F.lit("old") for c in ("kept", "n_words", "low", "doc", "th", "_raw")})
    assert [(r.doc_id, r.kept, r.n_words, r.low, r._raw) for r in quality.keep(own).collect()] == [(2, "old", "old", "old", "old")]
    for op in (simhash.keep_first, substrings.keep_new, lambda d: decontaminate.keep_clean(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0))):
        out = op(own)
        assert out.columns == own.columns and out.count() == 2


def test_quality_rejects_gibberish_by_its_language(spark):
    r = random.Random(7)
    good = lambda: " ".join("".join(r.choice(["ba", "no", "ri", "ta"]) for _ in range(3)) for _ in range(80))
    odd = lambda: " ".join("".join(r.choice("qxzjkvwg") for _ in range(6)) for _ in range(80))
    rows = [(i, good() if i % 30 else odd(), "en" if i % 2 else None) for i in range(300)]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == bool(i % 30) for i in range(300))


def test_quality_follows_the_labels(spark):
    at = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    of = {0: [], 1: []}
    for r in quality.op10_quality(spark, at).collect():
        if not r.base_failed and r.doc_id in labels:
            of[labels[r.doc_id]].append(r.kept)
    assert len(of[0]) > 10 and sum(of[0]) < 0.6 * len(of[0]) and sum(of[1]) >= 0.99 * len(of[1])


def brute_kneser_ney(texts, order):
    """p(sign, what stands before it), by the definition; n-grams count once a text."""
    seqs = [[0] * (order - 1) + [int(x) for x in quality.signs(np.array([ord(c) for c in t.lower()], np.uint32))] for t in texts]
    c = {order: Counter(g for s in seqs for g in {tuple(s[i : i + order]) for i in range(len(s) - order + 1)})}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {k: [0.0, *quality.discounts(*[float(sum(v == i for v in c[k].values())) for i in (1, 2, 3, 4)])] for k in c}

    def p(sign, before):
        k = len(before) + 1
        own = {g: n for g, n in c[k].items() if g[:-1] == before}
        low = p(sign, before[1:]) if k > 1 else 1 / quality.SIGNS
        if not own:
            return low
        n, total = own.get((*before, sign), 0), sum(own.values())
        return (n - d[k][min(n, 3)]) / total + sum(d[k][min(x, 3)] for x in own.values()) / total * low

    return p


def test_kneser_ney_equals_its_definition(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcd éЖ😀漢") for _ in range(r.randrange(1, 25))) for _ in range(40)]
    texts = [t for t in texts if zlib.crc32(t.encode()) % 2 == 0]  # of one half: one model
    model = quality.train(spark.createDataFrame([(t, "xx") for t in texts] + [("ab" * 9, "yy"), (None, None)], "text string, lang string"))
    lang = 2 * quality.lang_key("xx")
    codes, own, sizes = quality.ngram_codes([t.encode() for t in texts])
    one = quality.train(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string"))
    p = brute_kneser_ney(texts, quality.ORDER)
    parts = lambda c: [(int(c) >> quality.BITS * i) & (quality.SIGNS - 1) for i in range(quality.ORDER - 1, -1, -1)]
    got = one.log10(lang, codes[:150])
    assert np.allclose(got, [math.log10(p(g[-1], tuple(g[:-1]))) for g in map(parts, codes[:150])], atol=1e-5)
    assert np.allclose(quality.Lookup(one, 4).log10(lang, codes), one.log10(lang, codes), atol=1e-6)
    for m in (one, model):
        for context in (int(codes[7]) >> quality.BITS, int(codes[60]) >> quality.BITS, 0, 123456789):
            every = np.arange(quality.SIGNS, dtype=np.int64) + (context << quality.BITS)
            assert abs((10 ** m.log10(lang, every)).sum() - 1) < 1e-4
    assert sum(sizes) == len(own) == len(codes)


def test_quality_loses_no_ngram_to_a_slot(spark, small, monkeypatch):
    """With a few slots nearly all n-grams lose theirs; perplexities and verdicts stay those of the whole model."""
    docs = spark.read.parquet(f"{small}/documents.parquet").union(spark.createDataFrame([(-1, None, "xx", "s", 0), (-2, "", None, "s", 0), (-3, "one word", "xx", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long"))
    want = {r.doc_id: (r.kept, r.log_ppl) for r in quality.judge(docs).collect()}
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    whole = quality.stored
    monkeypatch.setattr(quality, "stored", lambda smoothed: whole(smoothed, 64))
    got = {r.doc_id: (r.kept, r.log_ppl) for r in quality.judge(docs).collect()}
    assert got.keys() == want.keys() and kept == {k for k, v in want.items() if v[0]} == {r.doc_id for r in quality.keep(docs).collect()}
    assert all(got[k][0] == v[0] and (v[1] is None) == (got[k][1] is None) and abs((v[1] or 0) - (got[k][1] or 0)) < 1e-5 for k, v in want.items())


def test_quality_stores_all_ngrams_that_fit_the_places_together(spark):
    """Places are those of all orders together: a model that fits them is stored whole, and leaves nothing to joins."""
    r = random.Random(4)
    texts = [("".join(r.choice("abcdefgh ") for _ in range(60)), "xx") for _ in range(60)]
    smoothed = quality._smoothed(spark.createDataFrame(texts, "text string, lang string"), "text", "lang").cache()
    n = smoothed.count() + smoothed.select("k", "lang", "context").distinct().count()
    model = quality.stored(smoothed, -(-n // (2 * quality.ORDER)))
    assert sum(map(len, model.hashes + model.context_hashes)) == n and not len(model.lost)
    codes, _, _ = quality.ngram_codes([t.encode() for t, _ in texts])
    langs = [2 * quality.lang_key("xx") + half for half in (0, 1)]
    want = [model.log10(x, codes) for x in langs]
    assert not np.isnan(want).any()
    few = quality.stored(smoothed, n // (4 * quality.ORDER))
    assert 0 < sum(map(len, few.hashes + few.context_hashes)) <= n // 2 and len(few.lost)
    got = [few.log10(x, codes) for x in langs]
    assert np.isnan(got).any() and np.allclose(np.where(np.isnan(got), want, got), want, atol=1e-6)
    smoothed.unpersist()


def test_near_dedup_stage_leaves_no_shuffle_files_and_no_large_tables(spark, small):
    import time

    from screenloom.llm import _common

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: (f := disk.getAllFiles()) and sum(f.apply(i).getName().startswith("shuffle_") for i in range(f.size()))
    files, before = shuffles(), {path for _, path in _common._written}
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{small}/documents.parquet"), small).write.format("noop").mode("overwrite").save()
    left = {path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for _, path in _common._written if path not in before}
    assert left <= {"text-keys", "distinct", "links", "edges"}
    for _ in range(40):  # files go in the background
        if shuffles() <= files:
            break
        time.sleep(0.5)
    assert shuffles() <= files


def test_quality_stage_leaves_no_model_on_disk(spark, small):
    """A model that is stored whole leaves its tables before texts are scored, and none are made to settle characters."""
    from screenloom.llm import _common

    before = {path for _, path in _common._written}
    quality.keep(spark.read.parquet(f"{small}/documents.parquet"))
    assert {path.rsplit("/", 1)[-1].split("-")[0] for _, path in _common._written if path not in before} == {"quality", "quartiles", "bands"}


def test_quality_judges_a_language_of_few_texts(spark):
    """Its band is as wide as that of other languages, about its own median."""
    r = random.Random(9)
    good = lambda a: " ".join("".join(r.choice(a) for _ in range(3)) for _ in range(80))
    rows = [(i, good(["ba", "no", "ri", "ta"]), "en") for i in range(200)] + [(1000 + i, good(["ко", "ла", "ми"]), "ru") for i in range(9)] + [(2000, " ".join("".join(r.choice("фщъэюцхжб") for _ in range(6)) for _ in range(80)), "ru")]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[2000] and sum(got.values()) >= 205


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, cols = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, small)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "quality_rules":
            assert all(not brute_quality(before[i])[-1] for i in ids) and len(ids) > 0.8 * sum(not brute_quality(t)[-1] for t in before.values())
        if name == "near_dedup":
            sh = {i: {" ".join(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in before.items()}
            link = [(a, b) for a in sh for b in sh if a < b and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
            want = groups(before, link)
            assert {i for i in before if want[i] == i} == set(ids)
        if name == "substring_dedup":
            seen = set()
            for r in sorted(rows, key=lambda r: r.doc_id):
                w = before[r.doc_id].split()
                mine = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
                assert (r.text == before[r.doc_id]) == (not (mine & seen)) and r.n_chars == len(r.text)
                seen |= mine
        if name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert {i for i, t in before.items() if any(p in " ".join(t.lower().split()) for p in items)}.isdisjoint(ids)
        if name == "tokenize":
            assert set(ids) == set(before) and all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.token_ids) for r in rows)
        else:
            assert out.columns == cols
        now = spark.createDataFrame(rows, out.schema) if rows else out
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == {r.doc_id for r in now.collect()}
