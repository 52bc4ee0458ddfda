"""HTML text, token counts, URL filter, licences and byte-level BPE: hand-made cases, brute force and round trips."""

import base64
import hashlib
import math
import random
import time

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from screenloom.llm import byte_bpe, html_text, licenses, queries, token_counts, url_filter


def test_html_cases():
    x = html_text.extract
    assert x(None) == x("") == x("<html></html>") == x("<nav>only menus here</nav>") == ""
    page = "<body><nav>Home</nav><header>Site</header><div class='cookie-notice'>We use cookies</div><article><header>By me</header><h1>A  title</h1><p>One &amp; two<br>three.<p>Four<script>var a='<p>no</p>'</script> five</p><div class='ad'>Buy</div><ul><li>six</li></ul><form><input>no</form></article><section id='comments'><p>reader says a lot of words here</p></section><aside>side</aside><footer>foot</footer></body>"
    got = x(page)
    for w in ("Home", "Site", "cookies", "Buy", "no", "reader", "side", "foot", "var"):
        assert w not in got.split()
    assert got.split("\n")[:3] == ["By me", "A title", "One & two three."] or got.split("\n")[:2] == ["A title", "One & two three."]
    assert got.endswith("Four five\nsix")


def test_html_without_article():
    words = " ".join(f"word{i}" for i in range(40))
    page = f"<div><a>Home</a> <a>News</a></div><div><p>{words}</p><p>{words}!</p></div><div><a>More</a> <a>Imprint</a></div>"
    assert html_text.extract(page) == f"{words}\n{words}!"


def brute_text(page, weights):
    """The text of the region that is best of all regions, to the ends of its blocks."""
    row = html_text.placed(html_text.events(page))
    score = [0 if k == "break" else weights[k] * (len(t.split()) if k.startswith("word") else 1) for k, t, _ in row]
    best = max([(0, 0, 0)] + [(sum(score[i:j]), -j, i) for i in range(len(row)) for j in range(i + 1, len(row) + 1)])
    lo, hi = best[2], -best[1]
    cuts = [-1] + [i for i, x in enumerate(row) if x[0] == "break"] + [len(row)]
    lo, hi = max(c for c in cuts if c < lo or c == -1) + 1, min(c for c in cuts if c >= hi)
    blocks = "".join("\0" if k == "break" else t for k, t, _ in row[lo:hi]).split("\0")
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


@pytest.mark.parametrize("rooted", [False, True])
def test_html_scan_is_the_best_region(rooted):
    """extract against all regions, with whole weights so that ties are ties."""
    r = random.Random(4)
    weights = {k: max(1, round(v)) if k.startswith("word") else min(-1, round(v)) for k, v in html_text.WEIGHTS.items()}
    parts = ["<div>", "</div>", "<p>some words here", "<a>link</a>", " more words follow ", "<b>bold</b>", "<ul><li>one</ul>"]
    some = 0
    for _ in range(60):
        page = "".join(r.choice(parts + (["<main>", "</main>", "<article>x"] if rooted else [])) for _ in range(30))
        got = html_text.extract(page, weights)
        assert got == brute_text(page, weights)
        some += got not in ("", html_text.extract(f"<p>{page}", dict.fromkeys(weights, 1)))
    assert some > 20  # the scan leaves something out


def test_html_scan_draws_the_bounds_without_known_names():
    """Menus and links in plain elements, with and without an article around the text."""
    links = "<div>" + "".join(f"<div><a>Item {i}</a></div>" for i in range(12)) + "</div>"
    prose = "<p>" + " ".join(f"word{i}" for i in range(30)) + "</p>"
    text = html_text.extract(prose)
    for page in (f"{links}<div>{prose}{prose}</div>{links}", f"{links}<article>{prose}{prose}</article>{links}", f"{links}<main>{prose}</main><article>{prose}</article>{links}"):
        assert html_text.extract(page) == f"{text}\n{text}"
    assert html_text.extract(f"{links}<article><h1>Short</h1><ul><li>a<li>b</ul></article>{links}") == "Short\na\nb"


@pytest.mark.parametrize("piece", ["<a '", '<a b="', "<!", "</", "<a<", "<!--", "<div></b>", "<a><div>", "<div>", "<span>", "<a '\"", "<a '>\" "])
def test_html_of_a_very_long_broken_page(piece):
    """Linear time: the square of this many would take hours."""
    began = time.monotonic()
    html_text.extract(piece * 100000 + "</a>" * 100000)
    assert time.monotonic() - began < 60


def test_html_tags_with_odd_quotes():
    x = html_text.extract
    assert x("<p title='a>b'>one two</p>") == "one two" and x('<p title="a>b" class=\'c"d\'>one two</p>') == "one two"
    assert x("<p>one <i x='>two three four") == "one two three four"
    assert x("<p>one < two three</p><!-- <p>no --><p>four five six") == "one < two three\nfour five six"
    assert x("<p>one two<!-- no") == x("<p>one two<![CDATA[ no") == "one two"


def test_html_table(spark, clash):
    df = clash(spark.createDataFrame([(1, "u", None), (1, "u", "<p>a b c d e f</p>")], "page_id long, url string, html string"), "text", "n_chars")
    assert sorted((r.text, r.n_chars) for r in html_text.main_text(df).collect()) == [("", 0), ("a b c d e f", 11)]
    assert html_text.main_text(df.limit(0)).count() == 0


def brute_tokens(word, pieces):
    """Fewest-cost segmentation of one word by itself."""
    byte = min(pieces.values()) - 10
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = (best[e - 1][0] + byte, best[e - 1][1] + 1)
        for s in range(e - 1, -1, -1):
            if word[s:e] in pieces and best[s][0] + pieces[word[s:e]] >= best[e][0]:
                best[e] = (best[s][0] + pieces[word[s:e]], best[s][1] + 1)
    return best[-1][1]


def test_token_counts_equal_a_search_of_each_word(spark, small):
    pieces = token_counts.load_pieces()
    for r in spark.read.parquet(f"{small}/documents.parquet").join(token_counts.op2_token_counts(spark, small), "doc_id").limit(25).collect():
        words = r.text.encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(brute_tokens(b" " + w, pieces) for w in words))


def test_token_counts_edges(spark, docs_of, empty, clash):
    df = clash(docs_of([(1, None), (2, ""), (2, " \t\n"), (3, "é\u00a0x \U0001f600"), (None, "a"), (5, "long" * 50_000)]), "n_words", "n_tokens")
    got = [(r.doc_id, r.n_words, r.n_tokens > 0) for r in token_counts.token_counts(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, False), (2, 0, False), (2, 0, False), (3, 2, True), (None, 1, True), (5, 1, True)], key=str)
    assert token_counts.token_counts(empty).count() == 0


def test_trie_shares_prefixes_and_forgets():
    pieces = {b" a": -1.0, b"b": -2.0, b" ab": -2.5}
    t = token_counts.TrieCounter(pieces, most=2)
    assert t.counts([b"ab abb", b"a b"]) == ([2, 2], [3, 3])  # " b" is a byte and a piece


def test_url_filter_equals_sql(spark, small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = {r[0]: r for r in c.sql("SELECT page_id, host, path, rule, verdict FROM (" + queries.SQL["op7_url_filter"] + ")").fetchall()}
    assert {r.page_id: (r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.op7_url_filter(spark, small).collect()} == want


def test_url_rules(spark, clash):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q#f", "http://org", "http://x.com/fr/", "http://com/de/a", "http://xcom/de/a", "ftp://bad.net/p/?b=1&utm_x=2&a", "http://bad.net:80/p?a&b=1#z", "a://b://c/d"]
    df = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "host", "rule", "verdict", "listed")
    listed = spark.createDataFrame([("bad.net/p?a&b=1",), ("bad.net/p?a&b=1",), (None,)], "u string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5] == ("org", "", None, "allow") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9][3] == got[10][3] == "block" and got[11][:2] == ("b:", "//c/d")
    none = {r.verdict for r in url_filter.filter_urls(df.where("page_id > 8"), listed.limit(0)).collect()}
    assert none == {"allow"} and url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_bloom_filter_with_one_block_is_still_exact(spark):
    keys, df = spark.range(0, 600, 2).select(F.col("id").cast("string").alias("u")), spark.range(600).select(F.col("id").cast("string").alias("k"))
    got = url_filter.listed_flag(df, keys, "k", bits_per_key=1, max_blocks=1)
    assert all(r.listed == (int(r.k) % 2 == 0) for r in got.collect()) and got.count() == 600


def brute_license(lines, model):
    best = None
    for i, line in lines:
        terms = licenses.terms_of(line)
        w = {t: terms.count(t) * model.idf.get(t, model.unseen) for t in terms}
        n = math.sqrt(sum(v * v for v in w.values()))
        for o, (name, vec) in enumerate(model.rows):
            cos = round(sum(v * vec.get(t, 0) for t, v in w.items()) / max(n, 1e-9), 9)
            if best is None or (cos, -i, -o) > best[:3]:
                best = (cos, -i, -o, name, w, n)
    if best is None:
        return None
    w, n = best[4:]
    rival = max(round(sum(v * vec.get(t, 0) for t, v in w.items()) / max(n, 1e-9), 9) for name, vec in model.rows if name != best[3])
    return best[3] if best[0] >= 0.6 and best[0] - rival >= 0.02 else None


def brute_candidates(text):
    import re

    lines = re.split(r"\r?\n", text)
    for i, line in enumerate(lines):
        if re.search(licenses.ANCHOR, line):
            yield i, line
            for j in {max(0, i - 2), max(0, i - 1), i}:
                yield j, " ".join(lines[j : j + 3])


def test_license_cosines_equal_brute_force(spark, small):
    got = {r.doc_id: r for r in licenses.op8_licenses(spark, small).collect()}
    model = licenses.Model()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert got[r.doc_id].own_license == brute_license(brute_candidates(r.text), model), r.doc_id


#: Openings as they stand in files, and what they are.
OPENINGS = [
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\r\n                       Version 3, 19 November 2007\r\n"),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("Apache-2.0", "// Licensed under the Apache License,\n// Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"),
    (None, "GNU GENERAL PUBLIC LICENSE"),
    (None, "Our rights to this domain need permission."),
]


def test_license_openings(spark):
    """Wrapped sentences and titles; a title without its version fits several licences and is none of them."""
    rows = [(f"{i}/x", text) for i, (_, text) in enumerate(OPENINGS)] + [("long/y", "word " * 200_000 + "\n" + "rights\n" * 2000 + "Released under the MIT License\n" + "code\n" * 20_000)]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"{i}/x"] for i in range(len(OPENINGS))] == [want for want, _ in OPENINGS] and got["long/y"] == "MIT"


def test_license_inheritance(spark, clash):
    rows = [("LICENSE", "Released under the MIT License"), ("a/x.txt", "code"), ("a/b/COPYING", "Licensed under CC BY 4.0"), ("a/b/c/y.txt", None), ("z.txt", ""), (None, "words " * 100), ("a/b/c/h.txt", "Licensed under the Apache License, Version 2.0\n" + "code " * 100), ("q/w.txt", "a"), ("q/w.txt", "a")]
    df = clash(spark.createDataFrame(rows, "path string, text string"), "license", "own_license")
    got = licenses.scan(df).collect()
    by = {r.path: (r.license, r.inherited_from) for r in got}
    assert len(got) == len(rows)
    assert by["LICENSE"] == ("MIT", None) and by["a/x.txt"] == ("MIT", "") and by["a/b/c/y.txt"] == ("CC-BY-4.0", "a/b") and by["q/w.txt"] == ("MIT", "")
    assert by["a/b/c/h.txt"] == ("Apache-2.0", None) and by[None] == ("MIT", "")
    assert licenses.scan(df.select("path", "text").limit(0)).count() == 0


@pytest.fixture(scope="module")
def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(spark, small, plain_encoding):
    got = {r.doc_id: r for r in byte_bpe.op9_byte_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = plain_encoding.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


@pytest.mark.parametrize("most", [1, 2, 7, 50])
def test_pieces_of_long_texts_give_the_same_ids(plain_encoding, most):
    r = random.Random(most)
    for _ in range(60):
        text = "".join(r.choice(["a", "b'll", " ", "  ", "\n", "\t", "é", "1", "!", "<|endoftext|>", "\u3000", "\u00a0", "\U0001f600", "'s", "'"]) for _ in range(r.randrange(80)))
        assert byte_bpe.encode_text(plain_encoding, text, most) == plain_encoding.encode_ordinary(text)
        assert "".join(byte_bpe.safe_pieces(text, most)) == text


def test_byte_bpe_edges(spark, docs_of, empty, clash):
    df = clash(docs_of([(1, None), (1, ""), (2, "a\x00b"), (None, "x " * 200_000)]), "token_ids", "decoded")
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df))).collect()
    assert sorted(r.n_tokens for r in got)[:2] == [0, 0] and len(got) == 4
    want = {hashlib.sha256(t.encode()).hexdigest() for t in ("", "a\x00b", "x " * 200_000)}
    assert {r.decoded_sha256 for r in got} == want
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


def test_listed_urls_against_a_set(spark):
    """A list with near misses, absent entries, repeats and nulls, and columns of the filter's own names beside the key."""
    r = random.Random(8)
    keys = [f"h{r.randrange(40)}.org/p{r.randrange(40)}" for _ in range(3000)]
    listed = r.sample(keys, 200) + [k + "/" for k in keys[:200]] + [k[:-1] for k in keys[:200]] + ["absent.org", None] + keys[:5]
    rows = [(k, i, i, i, "x", i, False) for i, k in enumerate([*keys, None, ""])]
    df = spark.createDataFrame(rows, "url string, k long, block long, w0 long, `row` string, `a.b` long, listed boolean")
    for most in (url_filter.MAX_BLOCKS, 1):  # one block: nearly every row is a possible hit
        got = url_filter.listed_flag(df, spark.createDataFrame([(x,) for x in listed], "sure string"), "url", max_blocks=most)
        assert got.columns == df.columns
        assert sorted(got.select("k", "url", "w0", "listed").collect()) == sorted((i, k, i, k in set(listed) and k is not None) for k, i, *_ in rows)
    assert url_filter.listed_flag(df, df.select("url").limit(0), "url").where("listed").count() == 0
    assert url_filter.listed_flag(df.limit(0), df.select("url"), "url").count() == 0
