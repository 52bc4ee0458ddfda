"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs before an exact join. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host labels whose pages make the query's list.
LISTED_LABELS = ("spam-farm", "cheap-pills")
#: 64-bit words in a block and the most blocks: 2**18 blocks of 64 bytes are 16 MB, however long the list is.
WORDS, MAX_BLOCKS = 8, 1 << 18


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """host + path + query: no scheme, ``www.``, default port, fragment, closing slash or ``utm_``/``ref`` parameters."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~ascii_lower(p).rlike(r"^(utm_|ref(=|$))")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; the first given among equal lengths; null if none fits."""
    rule, verdict = None, None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block and, for each word of it, a mask with one bit."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    second = F.xxhash64(key, F.lit(1))
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", second, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: (block, w0..w7), one row a block with any key, at most ``blocks`` rows."""
    block, masks = _bits(F.col(key), blocks)
    made = listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return made.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_flag(df: DataFrame, listed: DataFrame, key: str, out: str = "listed", bits_per_key: int = 16, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Adds the boolean ``out``: whether ``key`` (string) is among the values of ``listed``'s only column.

    The list goes into a blocked Bloom filter of at most ``max_blocks`` blocks, which is small enough to broadcast for
    any list; a longer list makes more false positives and no other results, for possible hits go on to an exact hash
    join. Rows that the filter turns away never shuffle. Null keys and empty lists give false; repeated listed keys count once,
    repeated rows each get a row, an empty table none, and a column named ``out`` gives way.
    """
    name = listed.columns[0]
    keys = written(listed.select(F.col(name).alias("_key")).where(F.col("_key").isNotNull()).distinct(), "listed")
    n = keys.count()
    blocks = min(max_blocks, 1 << max(4, math.ceil(math.log2(max(1, n) * bits_per_key / (64 * WORDS) + 1))))
    block, masks = _bits(F.col("k"), blocks)
    # Rows ride in a struct, so that no name of theirs meets one made here.
    probe = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("row"), F.col(key).alias("k")).withColumn("block", block)
    held = bloom_blocks(keys, "_key", blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    marked = probe.join(F.broadcast(held), "block", "left").select("row", F.when(F.coalesce(hit, F.lit(False)), F.col("k")).alias("ask"))
    # Rows turned away don't go on to the exact join, so they are sent nowhere near a hot key.
    possible = marked.where("ask IS NOT NULL")
    sure = possible.select("ask").distinct().join(keys, F.col("ask") == F.col("_key"), "left_semi").select(F.col("ask").alias("sure"))
    joined = possible.join(sure, F.col("ask") == F.col("sure"), "left").select("row", F.col("sure").isNotNull().alias("flag"))
    rest = marked.where("ask IS NULL").select("row", F.lit(False).alias("flag"))
    return joined.unionByName(rest).select("row.*", F.col("flag").alias(out))


def filter_urls(df: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, canonical_url, rule and verdict to ``df``; columns of those names in ``df`` give way.

    ``listed``: one column of canonical URLs. verdict is the longest fitting rule's, else block for a listed URL, else
    allow. Null, empty and odd URLs have empty host and path, no rule, and are allowed unless the empty URL is listed.
    """
    made = ("host", "path", "canonical_url", "rule", "verdict", "listed")
    base = df.drop(*[c for c in made if c != url])
    u = F.col(url)
    base = base.withColumns({"host": host_of(u), "path": path_of(u), "canonical_url": canonical(u)})
    flagged = listed_flag(base, listed, "canonical_url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return flagged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))})


def listed_urls(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Canonical URLs of the pages under hosts with one of the listed labels."""
    under = F.col("host").rlike(r"(^|\.)(" + "|".join(labels) + r")\.")
    return pages.select(host_of(F.col("url")).alias("host"), canonical(F.col("url")).alias("listed_url")).where(under).select("listed_url")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical_url")


_RULE_SQL = {v: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if v == 'rule' else k}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END" for v in ("rule", "verdict")}
SQL = {
    "op7_url_filter": rf"""
WITH parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|ref(=|$))'))) AS kept
  FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM parts),
listed AS (SELECT DISTINCT canonical_url FROM named WHERE regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})\.'))
SELECT page_id, host, path, {_RULE_SQL["rule"]} AS rule,
       coalesce({_RULE_SQL["verdict"]}, CASE WHEN canonical_url IN (SELECT canonical_url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       canonical_url
FROM named"""
}
QUERIES = {"op7_url_filter": op7_url_filter}
